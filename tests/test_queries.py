"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from conftest import SMALL
from larder.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def text(value) -> str:
    if value is None or pd.isna(value):
        return "~"
    if isinstance(value, str):
        return value
    if hasattr(value, "isoformat"):
        return str(value)[:10]
    return repr(round(float(value), 9) + 0.0)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, duck):
    ours = registry.QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_labels_are_read_whole(spark):
    found = registry.QUERIES["parse_label"](spark, SMALL).toPandas().pivot(index="image_id", columns="key", values="value")
    size = pd.read_parquet(f"{SMALL}/part.parquet").set_index("p_partkey").p_size
    assert len(found) == len(size)
    assert (found.calories == size * 10).all()
    assert (found.fat == size + 0.5).all()
    assert (found.sugars == size.map(lambda s: float(f"0.{s}"))).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
