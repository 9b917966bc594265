"""Every registered query with SQL gives the rows that a second engine gives."""

import math

import duckdb
import pytest

import __spark_entry__
from folioscope.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return tuple(x) if hasattr(x, "__iter__") and not isinstance(x, str) else x

    return sorted((tuple(cell(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, expected = catalog.QUERIES[name](spark, data).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", ["exact_lookup_candidates"])
def test_odd_letters(spark, tmp_path, name):
    """Letters whose other case is several letters, or depends on what stands beside them."""
    texts = ["ßheit und", "enö ßgeung", "ﬁn ŉa", "İstan ΟΔΟΣ", "ǆa ᾳx", "", "one", " x", "𐐨a ß"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(catalog.ORACLE_SQL[name]).df())


def test_long_chains_of_copies(spark, tmp_path):
    """More copies of one text than a walk follows: the SQL ends each walk where its hops run out."""
    texts = [(i, "en" if i % 9 else "fr", "same" if i % 3 else f"other {i % 2}") for i in range(260)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, expected = catalog.QUERIES["redirect_closure"](spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLE_SQL["redirect_closure"]).df()
    assert rows(got) == rows(expected) and max(got["hops"]) == 50


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
