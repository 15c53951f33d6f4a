"""Rows are told apart by themselves, not by ids; columns may have any name."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from motionframe.llm import exact_dedup, mixing, near_copies, queries, toxicity, url_filter

AT = datetime(2024, 1, 1)


def test_captures_that_repeat_a_key_or_have_none(spark):
    captures = [(1, "http://bad.com/", AT), (1, "http://good.com/", AT), (None, "http://bad.com/", AT), (None, "http://good.com/", AT), (2, "http://x.bad.com/", AT)]
    frames = (
        spark.createDataFrame([(*c, "x", 7) for c in captures], "key long, url string, fetched_at timestamp, row string, kept int"),
        spark.createDataFrame([("block", "domain", "bad.com", AT, True)], "list string, kind string, pattern string, at timestamp, listed boolean"),
    )
    made = url_filter.judge(*frames).collect()
    assert sorted((str(r.key), r.url, r.kept) for r in made) == sorted((str(k), u, "bad" not in u) for k, u, _ in captures)


def test_url_twin_agrees_on_deep_hosts_and_repeated_pages(spark, tmp_path):
    import duckdb

    deep = "a.b.c.d.e.f.g.h.i.org"
    rows = [(k % 40 if k % 7 else None, f"http://{'.'.join(deep.split('.')[k % 9:])}/{k % 3}", "x") for k in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = queries.QUERIES["op1_url_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = con.execute(queries.ORACLES["op1_url_filter"])
    names = [d[0] for d in got.description]
    assert Counter(map(str, got.fetchall())) == Counter(str(tuple(r[c] for c in names)) for r in made.collect())


def test_training_rows_keep_their_bound(spark):
    docs = spark.range(200).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(3, 1)] * 200, "doc_id long, toxic int")
    assert toxicity.sample(docs, labels).count() == 1
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    known = many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    drawn = Counter(r.toxic for r in toxicity.sample(many.union(many), known.union(known), (10, 5)).collect())
    assert drawn == {0: 10, 1: 5}


def test_rows_without_ids_are_mixed_to_their_target(spark):
    rows = [(None, f"{k} b c d e f g h i j", "a") for k in range(100)] + [(k, f"{k} b c d e f g h i j", "b") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {r.source: 10 * r["count"] for r in mixing.mixed(spark, docs, block=10).groupBy("source").count().collect()}
    assert abs(words["a"] - 2000 / 3) < 30 and abs(words["b"] - 4000 / 3) < 30


NAMES = ["_own", "_copy", "_sha", "_stay", "_stay_sha", "_times", "_time", "own", "copy", "stay", "whole", "key", "times", "time", "sha", "fp", "root"]


@pytest.mark.parametrize("stage", [exact_dedup.without_copies, near_copies.without_near_copies, mixing.mixed])
def test_stages_bear_any_column_name(spark, stage):
    docs = spark.createDataFrame([(1, "one two three four", "a"), (2, "one two three four", "b"), (3, None, None)], "doc_id long, text string, source string")
    made = stage(spark, docs.withColumns({c: F.lit("x") for c in NAMES}))
    assert made.columns == [*docs.columns, *NAMES] and made.count() > 0
    assert {r.own for r in made.collect()} == {"x"}


def test_score_of_no_rows(spark, nothing):
    assert toxicity.score(spark, nothing, toxicity.train([], [])).collect() == []
