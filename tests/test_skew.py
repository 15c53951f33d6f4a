"""The split paths for hot keys give what the plain ones give."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.operators import alarms, metrics, resample, skew


def hot_rows(spark):
    """One key holds most rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("key"),
        (F.col("id") * 7919 % 3001).alias("v"),
    )


def test_positions_of_hot_keys(spark):
    df = hot_rows(spark)
    order = [F.col("v")]
    split = skew.ordered_positions(df, ["key"], order, F.floor(F.col("v") / 100), hot_rows=50)
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy("v")) - 1)
    assert split.join(plain, ["key", "v"]).filter("pos <> want").count() == 0
    assert split.count() == 3000


def test_previous_row_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_ROWS", 16)
    df = hot_rows(spark)
    got = skew.with_previous(df, ["key"], [F.col("v")], F.floor(F.col("v") / 100), ["v"], hot_rows=50)
    want = df.withColumn("want", F.lag("v").over(Window.partitionBy("key").orderBy("v")))
    assert got.join(want, ["key", "v"]).filter("not (prev_v <=> want)").count() == 0


def greedy(decisions, cooldown):
    kept, last = [], None
    for d in decisions:
        if last is None or d - last >= cooldown:
            kept.append(d)
            last = d
    return kept


def test_cooldown_chain_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(alarms, "SAMPLE_BLOCK", 100)
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, cooldown in (("a", 0), ("b", 7), ("c", 38), ("d", 250), ("e", 60)):
        density = 0.9 if key != "e" else 0.02
        decisions = [int(i) for i in range(3000) if rng.random() < density]
        rows += [(key, 3000, cooldown, d) for d in decisions]
        want[key] = greedy(decisions, cooldown)
    fired = spark.createDataFrame(rows, "key string, n long, cooldown int, decision int")
    got = {}
    for r in alarms.accept(fired, ["key"]).collect():
        got.setdefault(r.key, []).append(r.decision)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_triggers_across_position_blocks(spark, monkeypatch):
    monkeypatch.setattr(alarms, "POSITION_BLOCK", 8)
    flags = np.random.default_rng(2).random(100) < 0.5
    rows = [("r", 100, i, 50 + 13 * i, float(f), 0.5) for i, f in enumerate(flags)]
    scores = spark.createDataFrame(rows, "recording_id string, n long, pos long, end_sample int, score double, threshold double")
    policy = [("p", 2, 3, False, 0.0)]
    got = sorted(r.decision for r in alarms.triggers(scores, policy, by=()).collect())
    want = [49 + 13 * i for i in range(2, 100) if flags[i - 2 : i + 1].sum() >= 2]
    assert got == want


def test_resampling_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 10)
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.random(200) + 0.01)
    v = rng.random(200)
    series = spark.createDataFrame([("u", float(a), float(b)) for a, b in zip(t, v)], "u string, t double, v double")
    rows = resample.resample(series, ["u"], ["v"], 2.0, F.floor(F.col("t") / 10), hot_rows=20).orderBy("k").collect()
    rel = t - t[0]
    grid = np.arange(int(np.floor(rel[-1] * 2 + 1e-9)) + 1) / 2
    assert [r.k for r in rows] == list(range(len(grid)))
    assert np.allclose([r.v for r in rows], np.interp(grid, rel, v))


def test_ranking_with_ties_against_pairs(spark):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 400)
    scores = np.round(rng.random(400) * 3 - 1, 2)
    frame = spark.createDataFrame([("j", int(a), float(b)) for a, b in zip(labels, scores)], "job string, label int, score double")
    row = metrics.ranking(frame, ["job"]).first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert np.isclose(row.auroc, pairs)
    cuts = np.unique(scores)[::-1]
    recall = np.array([(pos >= c).sum() / len(pos) for c in cuts])
    precision = np.array([(pos >= c).sum() / (scores >= c).sum() for c in cuts])
    assert np.isclose(row.auprc, (np.diff(np.concatenate(([0], recall))) * precision).sum())


def test_exact_quantile(spark):
    values = np.random.default_rng(5).random(1001)
    frame = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    row = metrics.exact_quantile(frame, "v", 0.99, ["g"], "q").first()
    assert np.isclose(row.q, np.percentile(values, 99))


def test_nearest_neighbours_over_small_blocks(spark, monkeypatch):
    from motionframe.operators import neighbours

    monkeypatch.setattr(neighbours, "REFERENCE_BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 9)
    monkeypatch.setattr(neighbours, "PIVOTS", 4)
    rng = np.random.default_rng(6)
    refs, queries = rng.random((60, 3)), rng.random((20, 3))
    r = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(refs)], "r_id long, features array<double>, label int")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q_id long, features array<double>")
    got = {}
    for row in neighbours.nearest(q, r, 5).orderBy("q_id", "rank").collect():
        got.setdefault(row.q_id, []).append(row.r_id)
    far = np.linalg.norm(queries[:, None] - refs[None], axis=2)
    assert got == {i: np.argsort(far[i])[:5].tolist() for i in range(20)}


def test_closest_by_products_are_those_of_plain_distances(monkeypatch):
    """Copies, near ties far from the origin and few references: a matrix product alone would rank them wrongly."""
    import numpy as np

    from motionframe.operators import neighbours

    monkeypatch.setattr(neighbours, "CANDIDATES", 50)
    rng = np.random.default_rng(2)
    for offset, count in ((0.0, 200), (1e6, 200), (0.0, 3)):
        stored = offset + rng.normal(size=(count, 8)) * 1e-3
        stored[count // 2 :] = stored[: count - count // 2]
        ids, vectors = rng.permutation(count), offset + rng.normal(size=(40, 8)) * 1e-3
        row, place, distance = neighbours._closest(vectors, stored, (stored**2).sum(axis=1), ids, 5)
        for q, v in enumerate(vectors):
            plain = np.sqrt(((stored - v) ** 2).sum(axis=1))
            best = np.lexsort((ids, plain))[:5]
            assert ids[place[row == q]].tolist() == ids[best].tolist()
            assert distance[row == q].tolist() == plain[best].tolist()
