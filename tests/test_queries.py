"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

from quillstack import plans

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if type(x).__name__ in ("bool", "bool_"):
            return str(bool(x))
        return f"{float(x):.5f}" if hasattr(x, "dtype") or isinstance(x, (int, float)) else str(x)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, db, sf_dir):
    found = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(found) > 0
        return
    expected = db.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", ["jaccard_topk", "related_precomputed", "similarity_graph", "similarity_graph_of_systems", "similarity_graph_nodes"])
def test_tags_of_very_many_titles_count(name, spark, tmp_path):
    part = [(i, f"only{i} one{i}", f"Brand#{i}", "PROMO", 7, 1.0) for i in range(1, 701)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = plans.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(found) > 0 and rows(found) == rows(con.execute(plans.ORACLE_SQL[name]).df())


def test_facet_total_is_search_total(spark, sf_dir):
    facets = plans.QUERIES["facets_all"](spark, sf_dir).toPandas()
    total = facets[facets.dim == "total"].n.sum()
    assert facets[facets.dim == "publisher"].n.sum() == total
    assert facets[facets.dim == "game_system"].n.sum() == total
