"""A corpus cleaning pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and
read back as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontam, langid, packing, pii, simhash
from larder.llm.common import join_groups, shared_root, staged


#: Rows that a task hands to Python at once, unless the session has a number of its own.  Documents are long: with Spark's
#: default of 10,000 two tasks hold some hundred MB of texts beside an executor's heap.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _batches_of_texts(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder: rows keep their numbers, and lost executors do no harm.

    Unlike a table that is staged, Spark clears it when it is no longer referred to (where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set), so copies of the texts do not add up over the stages.
    """
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model cannot tell, and fills in the language where it is missing.

    Clean documents of any length stay, so there is no floor for the score: on a corpus in learned languages the stage
    drops little and its main work is to fill in ``lang``.  It cannot tell the language of a null text, of one without a letter, and of one without any word that is known or
    has a known n-gram of two or more characters.  Repeated rows, and rows without doc_id, are each judged on their own.
    With no labelled document nothing is known, and nothing but texts without a letter is dropped.
    """
    _batches_of_texts(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.regexp_like(F.col("text").cast("string"), F.lit(r"\p{L}")))
    if model.rest is None:
        kept = docs.withColumn("_found", langid.predictor(spark, model)(F.col("text").cast("string")))
    else:
        # More words than are broadcast: rows are judged by their numbers, and only verdicts that change a row meet the texts.
        numbered = _kept(spark, docs.withColumn("_row", F.monotonically_increasing_id()))
        found = langid.identify(numbered.select(F.col("_row").alias("doc_id"), "text"), model).withColumnRenamed("doc_id", "_row")
        found = found.join(numbered.select("_row", F.col("lang").isNull().alias("_empty")), "_row")
        changed = found.where(f"_empty or lang_pred = '{langid.UNKNOWN}' or known = 0").select("_row", F.lit(1).alias("n"), F.struct("lang_pred", "known").alias("_found"))
        kept = join_groups(numbered, staged(spark, changed, "judged"), "_row")
    kept = kept.where(f"_found is null or (_found.lang_pred <> '{langid.UNKNOWN}' and _found.known > 0)")
    return kept.withColumn("lang", F.coalesce("lang", F.col("_found.lang_pred").cast(docs.schema["lang"].dataType))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicate texts: the one with the smallest doc_id.

    Rows are told apart by their place, not by their doc_id: of repeated rows one stays, a distinct text that shares an
    id with a duplicate stays, and rows without doc_id are compared like all others (they come last in a group).
    """
    _batches_of_texts(spark)
    numbered = _kept(spark, docs.withColumn("_row", F.monotonically_increasing_id()))
    found = staged(spark, simhash.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")), "groups")
    members = found.select(F.col("doc_id").alias("_row"), "component_id").join(numbered.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row"))
    kept = members.groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    gone = staged(spark, numbered.select("_row").join(kept, "_row", "left_anti").select("_row", F.lit(1).alias("n"), F.lit(True).alias("_gone")), "gone")
    # Texts stay where they are unless the rows that go are too many to broadcast.
    return join_groups(numbered, gone, "_row").where("_gone is null").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item.

    Each row is judged on its own, also one without doc_id or with a repeated one; a null text contains nothing; with no
    item, or no document, nothing is dropped.
    """
    _batches_of_texts(spark)
    numbered = _kept(spark, docs.withColumn("_row", F.monotonically_increasing_id()))
    leaks = decontam.contaminated(numbered.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = staged(spark, leaks.select(F.col("doc_id").alias("_row")).distinct(), "leaks")
    return numbered.join(leaks, "_row", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in the text and counts its characters anew.

    All rows stay; a null text stays null, with a null count; what the model accepts is learned from all documents here.
    """
    _batches_of_texts(spark)
    found = _kept(spark, docs.withColumn("_spans", pii.finder()(F.col("text").cast("string"))))
    model = pii.fit(found.select("doc_id", F.col("_spans").alias("spans")))
    cleaned = found.withColumn("text", pii.redact(spark, model)(F.col("text").cast("string"), F.col("_spans")))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences: a row for each piece of a document.

    A null text is empty, an empty one is its end id alone; repeated rows are packed each on their own; no row, no piece.
    """
    import public_tokenizers

    _batches_of_texts(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packed),
]

#: SQL has no fingerprints, latent space, classifier or tokenizer; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
