"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module; each module has a function of the query's name.
_MODULES = {
    "op1_html_extraction": "htmltext",
    "op10_benchmark_decontamination": "decontam",
    "op11_license_scans": "licenses",
    "op12_centroid_clustering": "vafile",
    "op13_ranked_lexical_search": "lexical",
    "op2_media_columns": "media",
    "op3_packing": "packing",
    "op4_suffix_tree_scores": "lm",
    "op5_pii": "pii",
    "op6_language_id": "langid",
    "op7_simhash_near_dedup": "simhash",
    "op8_warc": "warc",
    "op9_token_file": "tokenfile",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"larder.llm.{module}"), name) for name, module in _MODULES.items()}
    pipeline = importlib.import_module("corpus_pipeline")
    return found | {"pipeline": pipeline.run}


_ORACLES = {
    "op8_warc": """
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM coalesce(keeper, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM coalesce(keeper, page_id) THEN keeper END AS refers_to
FROM (SELECT *, CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS keeper
  FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages))""",
}


_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licenses() -> str:
    from larder.llm import licenses as L

    quoted = ", ".join("({}, '{}', {}, '{}')".format(i, t.label, str(t.base).lower(), t.text.replace("'", "''")) for i, t in enumerate(L.TEMPLATES))
    return f"""
WITH templates(template, label, base, text) AS (VALUES {quoted}),
template_words AS (SELECT template, label, base, {_WORDS.format(text="text")} AS w FROM templates),
template_grams AS (SELECT *, array_to_string(w[place + 1 : place + k], ' ') AS gram FROM (
  SELECT template, label, base, w, len(w) AS length, k, unnest(range(len(w) - k + 1)) AS place
  FROM (SELECT *, CASE WHEN len(w) < {L.LONG} THEN {L.SHORT} ELSE {L.LONG} END AS k FROM template_words))),
docs AS (SELECT row_number() OVER () AS "row", doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
grams AS (SELECT "row", pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram
  FROM (SELECT "row", w, unnest(range(len(w))) AS pos FROM docs) CROSS JOIN (VALUES ({L.SHORT}), ({L.LONG})) sizes(k) WHERE pos + k <= len(w)),
hits AS (SELECT "row", pos, template, label, base, length, template_grams.k, place FROM grams JOIN template_grams USING (k, gram)),
diagonals AS (SELECT "row", template, label, base, length, k, pos - place AS diagonal, count(*) AS votes, min(pos) AS first_at, max(pos + k) AS last_at
  FROM hits GROUP BY ALL),
numbered AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY "row", template ORDER BY diagonal) AS span FROM (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY "row", template ORDER BY diagonal) > {L.SHIFT} OR length < {L.WHOLE_BELOW}, true) AS apart
  FROM diagonals)),
ends AS (SELECT "row", template, label, length, span, min(first_at) AS first_at, max(last_at) AS last_at FROM numbered GROUP BY ALL),
covers AS (SELECT "row", template, span, count(DISTINCT place + i) AS covered
  FROM numbered JOIN hits USING ("row", template) CROSS JOIN range({L.LONG}) steps(i) WHERE pos - place = diagonal AND i < hits.k GROUP BY ALL),
judged AS (SELECT "row", label, covered / length AS cover, CASE WHEN length < {L.WHOLE_BELOW} THEN covered = length
  ELSE covered / length >= {L.MIN_COVER} AND last_at - first_at <= {L.MAX_STRETCH} * length END AS accepted FROM ends JOIN covers USING ("row", template, span)),
whole AS (SELECT "row", label, diagonal FROM diagonals WHERE base AND votes = length - k + 1),
based AS (SELECT "row", count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM whole GROUP BY "row"),
labelled AS (SELECT "row", string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT "row", label FROM whole UNION ALL SELECT "row", label FROM judged WHERE accepted) GROUP BY "row"),
scored AS (SELECT "row", max(cover) AS score FROM judged GROUP BY "row")
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM docs LEFT JOIN based USING ("row") LEFT JOIN labelled USING ("row") LEFT JOIN scored USING ("row")"""


def _clusters() -> str:
    from larder.llm import vafile as V

    parts = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({V.SCALE}e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {V.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {V.DIMENSIONS})""",
        f"parts AS (SELECT r, unnest(range({V.DIMENSIONS})) AS d, unnest(v) AS x FROM kept)",
        f"""c0 AS (SELECT c, unnest(range({V.DIMENSIONS})) AS d, unnest(v) AS x FROM (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept) WHERE c < {V.CLUSTERS})""",
    ]
    for k in range(V.ROUNDS + 1):
        parts.append(
            f"""a{k} AS (SELECT r, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, c) AS o FROM (
  SELECT r, c, sum((parts.x - c{k}.x) * (parts.x - c{k}.x)) AS distance FROM parts JOIN c{k} USING (d) GROUP BY r, c)) WHERE o = 1)"""
        )
        if k < V.ROUNDS:
            parts.append(
                f"""c{k + 1} AS (SELECT c, d, CASE WHEN n IS NULL THEN x ELSE CAST(floor(total / n) AS BIGINT) END AS x FROM c{k} LEFT JOIN (
  SELECT c, d, sum(x) AS total, count(*) AS n FROM a{k} JOIN parts USING (r) GROUP BY c, d) USING (c, d))"""
            )
    last = V.ROUNDS
    return f"""WITH {", ".join(parts)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN kept USING (r) JOIN digests USING (c)"""


def _ranking() -> str:
    from larder.llm import lexical as X

    return f"""
WITH docs AS (SELECT *, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="text")} AS w FROM documents) WHERE len(w) > 0),
sizes AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM docs),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
items AS (SELECT i, item_id, unnest({_WORDS.format(text="text")}) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sizes),
scores AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {X.TOP}"""


def oracle_sql() -> dict[str, str]:
    """SQL cannot express the other operators' models, tokenizers, fingerprints and files; tests/llm has plain versions."""
    return _ORACLES | {"op11_license_scans": _licenses(), "op12_centroid_clustering": _clusters(), "op13_ranked_lexical_search": _ranking()}
