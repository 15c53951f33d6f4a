"""Exact copies, source mix and the pipeline against plain versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motionframe.llm import exact_dedup, mixing, near_copies, toxicity
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_exact_copies(spark, which, request):
    rows = request.getfixturevalue(which)
    groups = defaultdict(list)
    for r in rows.select("doc_id", "text").collect():
        groups[r.text or ""].append(r.doc_id)
    made = exact_dedup.duplicates(spark, rows, bucket_keys=8).collect()
    assert len(made) == sum(map(len, groups.values()))
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    kept = defaultdict(int)
    for r in made:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    left = exact_dedup.without_copies(spark, rows)
    assert left.columns == rows.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted(groups)


def test_colliding_digests_are_compared(spark, monkeypatch):
    """With a digest that tells nothing apart, only the bytes do."""
    def same(docs):
        text = F.coalesce(F.col("text"), F.lit(""))
        return docs.select("doc_id", text.alias("text"), F.lit("0" * 64).alias("sha"))

    monkeypatch.setattr(exact_dedup, "digested", same)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "a")], "doc_id long, text string")
    made = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.duplicates(spark, rows).collect()}
    assert made == {1: (6, 3), 3: (6, 3), 6: (6, 3), 2: (5, 2), 5: (5, 2), 4: (4, 1)}


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("key"))
    buckets, bits = exact_dedup.directory(keys, 3000, 50)
    placed = keys.withColumn("prefix", exact_dedup._prefix(bits)).join(buckets, "prefix")
    assert placed.count() == 3000
    assert placed.groupBy("depth", "bucket").count().agg(F.max("count")).first()[0] <= 50


def targets(sizes):
    """Plain water-filling over sources in order of code points, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        rest = sum(sizes.values()) - sum(capped.values())
        found = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if found[s] >= 3 * sizes[s]]
        if not over:
            return {**capped, **found}
        capped.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_source_mix(spark, which, request):
    rows = request.getfixturevalue(which)
    own = [(r.source, len(WORD.findall(r.text or ""))) for r in rows.select("source", "text").collect()]
    sizes = defaultdict(int)
    for s, n in own:
        sizes[s] += n
    sized = rows.select("doc_id", "source", mixing.common.word_count(F.col("text")).alias("size"))
    made = mixing.taken_words(spark, sized, block=64).collect()
    assert sorted((str(r.source), r["size"]) for r in made) == sorted((str(s), n) for s, n in own)
    expected = targets(sizes) if own else {}
    taken = defaultdict(int)
    for r in made:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) < 1 + 1e-6 * expected[s] for s in taken)
    again = mixing.taken_words(spark, sized, block=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, made))


def test_schedule_is_spread(spark):
    """Every stretch of slots has every source near its share."""
    sized = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit(500).cast("long").alias("size"))
    slots, _, _, _ = mixing.mix(spark, sized, block=100)
    rows = sorted((r.slot, r.source, r["rank"]) for r in slots.collect())
    ranks = defaultdict(list)
    for _, s, k in rows:
        ranks[s].append(k)
    assert all(v == list(range(len(v))) for v in ranks.values())
    for k in range(0, 1900, 100):
        window = [s for n, s, _ in rows if k <= n < k + 100]
        assert abs(window.count("s2") - 300 / 7) < 12


def test_toxicity_learns_and_bears_awkward_rows(spark, awkward, nothing):
    """Held-out accuracy on a separable fixture, with spellings that training never showed."""
    filler = [f"w{k % 37} x{k % 41} y{k % 29} plain words go here again" for k in range(600)]
    stems = ["grobian", "grobiane", "grobians", "grobianen"]
    rows = [(k, f"{t} {stems[k % 4]} and more" if k % 4 == 0 else t, int(k % 4 == 0)) for k, t in enumerate(filler)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(spark, table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    made = {r.doc_id: r for r in toxicity.score(spark, table, model).collect()}
    assert all((made[k].predicted == 1) == (y == 1) for k, _, y in rows if made[k].held_out)
    unseen = spark.createDataFrame([(1, filler[1] + " grobianisch"), (2, filler[2])], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(spark, unseen, model).collect()}
    assert scores[1] > scores[2]
    bare = toxicity.score(spark, awkward, model).collect()
    assert len(bare) == awkward.count() and all(0 <= r.score <= 1 for r in bare)
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity.clean(spark, awkward, labels).count() == awkward.count()
    assert toxicity.clean(spark, nothing, labels).collect() == []


def test_null_and_repeated_ids_are_judged_by_row(spark, monkeypatch):
    """One toxic text takes no other row with it, and of near copies one row stays."""
    rows = [(None, "bad words"), (None, "good one"), (5, "bad words"), (5, "good two"), (None, "good one"), (6, "good three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weight = np.zeros(toxicity.BUCKETS, np.float32)
    weight[toxicity.grams(["bad"])[0]] = 1000
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.Model(weight, -5.0))
    left = toxicity.clean(spark, docs, None).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(k), t) for k, t in rows if "bad" not in t)
    left = near_copies.without_near_copies(spark, docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("5", "bad words"), ("5", "good two"), ("6", "good three"), ("None", "good one")]


def test_pipeline_stages(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = corpus_pipeline.common.written(spark, docs, "test-stage")
            assert docs.columns == columns
        if name == "exact_dedup":
            assert docs.count() == before.select("text").distinct().count()
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    for name, stage in corpus_pipeline.STAGES[1:]:
        made = stage(spark, awkward, SF).collect()
        assert len(made) > 0
