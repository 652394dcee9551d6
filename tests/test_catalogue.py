"""A sample of the registered queries against their SQL at the smallest scale."""

import math
import os

import pytest

from quillspark.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
NAMES = sorted(catalogue.oracle_sql())


def rows(table):
    table = table[sorted(table.columns)]
    show = lambda v: "" if v is None else round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(map(str, map(show, r))) for r in table.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(con.execute(catalogue.oracle_sql()[name]).fetch_df())


@pytest.mark.parametrize("name, table, asked", [("knn_embeddings", "embeddings", "vec_id % 100 = 0"), ("euclidean", "embeddings", "vec_id % 100 = 0"), ("explain_score", "benchmark", "true")])
def test_searches_ask_all_rows(spark, name, table, asked):
    ids = "vec_id" if table == "embeddings" else "item_id"
    want = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").where(asked).select(ids).collect()}
    assert {r[0] for r in catalogue.queries()[name](spark, DATA).select("query_id").distinct().collect()} == want


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
