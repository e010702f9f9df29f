"""Every query with SQL, against DuckDB on the smallest fixtures."""

import math
import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixtures here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    answer = duck.execute(__spark_entry__.oracle_sql()[name])
    theirs = [c[0] for c in answer.description]
    assert sorted(theirs) == columns
    expected = sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in answer.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


WITHOUT_SQL = ["greedy_diversity_rank", "stacking_tree", "bagging_tree", "bias_concordance", "summary_ci_margin", "fuzzy_match", "stratified_sample", "stratified_split", "strip_markup", "fit_learning", "stemmed_words", "tagged_tokens"]


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
