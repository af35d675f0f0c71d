"""Every catalogue query against its SQL form in an independent engine."""

import itertools
import os
import pathlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import phrases
from assaykit.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = pathlib.Path(DATA, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


SLOW = {"relevance_classified", "word_vectors", "trained_tags", "merged_phrases", "documents_normalized"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - SLOW))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert catalogue.flagship(spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["material_strings_parsed", "compounds_split"])
def test_every_part_is_read(spark, name):
    part = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey")
    assert part.exceptAll(catalogue.QUERIES[name](spark, DATA).select("p_partkey").distinct()).count() == 0


def test_all_phrases_are_merged(spark, tmp_path):
    names = ["".join(x) for x in itertools.product("bcdfghjk", repeat=3)][:300]
    docs = [(i, f"left{n} right{n} " * 12) for i, n in enumerate(names)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.doc_id, r.n_tokens, r.n_phrases) for r in catalogue.merged_phrases(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(i, 12, 12) for i in range(300)]


def test_merge_by_table_equals_merge_by_array(spark):
    rng = random.Random(1)
    s = spark.createDataFrame([(i, [rng.choice("abcd") for _ in range(rng.randrange(9))]) for i in range(200)] + [(200, ["a_b", "c"])], "id long, tokens array<string>")
    found = [("a", "b"), ("b", "c"), ("a_b", "c"), ("d", "d")]
    got = phrases.merge_all(s, spark.createDataFrame(found, "a string, b string")).collect()
    want = s.select("id", tx.merge_phrases(F.col("tokens"), F.lit(["_".join(x) for x in found]))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
