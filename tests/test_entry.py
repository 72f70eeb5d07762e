import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.queries import SQL, Q


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: "" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q = con.execute(SQL[name])
    names = [d[0] for d in q.description]
    got = Q[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    floats = lambda vs: [[float(x) if type(x).__name__ == "Decimal" else x for x in v] for v in vs]
    assert rows(got.columns, map(list, got.collect())) == rows(names, floats(q.fetchall()))


#: Queries without SQL: the table that has as many rows, or None where rows depend on rules that tests of their own cover.
ROWS = {"page_content": "pages", "page_metadata": "pages", "page_density": "pages", "refined_pages": "pages", "refined_json": "pages", "page_tables": None, "text_chunks_uax29": None, "sev1_rule_exact": None, "alerts": None, "circuit_states": None}


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_runs(spark, sf, name):
    got, keys = Q[name](spark, sf), ("page_id", "doc_id", "seq")
    n = got.count()
    if ROWS[name]:
        key = next(c for c in keys if c in got.columns)
        assert n == got.select(key).distinct().count() == spark.read.parquet(f"{sf}/{ROWS[name]}.parquet").count()
    elif name == "text_chunks_uax29":  # every document has chunks, in order and without gaps
        from pyspark.sql import functions as F

        per = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("chunk_index").alias("a"), F.max("chunk_index").alias("z"), F.min("start_index").alias("s"))
        assert per.where("a <> 0 OR z <> n - 1 OR s <> 0").isEmpty() and per.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    elif name == "page_tables":
        assert n == 0  # the pages have none; page_tables_built has
    else:
        assert 0 < n <= spark.read.parquet(f"{sf}/events.parquet").count()
