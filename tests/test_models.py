"""Models on window features: weights, moments and likelihoods against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.constants import BALANCED, SEED
from motionframe.operators import boosting, forest, logistic, models
from motionframe.plans import model_queries, statistics_queries

LONG = "recording_id string, win int, features array<float>, label int, weight double"


def made(n=60, width=4, seed=1):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    x = (rng.normal(size=(n, width)) * 3 + 1 + label[:, None]).astype(np.float32)
    return x, label, rng.integers(1, 4, n).astype(float)


def frame(spark, x, label, weight):
    return spark.createDataFrame([("r", k, v.tolist(), int(y), float(w)) for k, (v, y, w) in enumerate(zip(x, label, weight))], LONG)


def test_weighted_moments_are_those_of_repeated_rows(spark):
    x, label, weight = made()
    rows = models.array_standardisation(frame(spark, x, label, weight), weight="weight").orderBy("j").collect()
    repeated = np.repeat(x.astype(float), weight.astype(int), axis=0)
    assert np.allclose([r["mean"] for r in rows], repeated.mean(0))
    assert np.allclose([r["scale"] for r in rows], repeated.std(0))


def test_naive_bayes_equals_the_plain_likelihood(spark):
    x, label, weight = made()
    got = models.naive_bayes_scores(frame(spark, x, label, weight), frame(spark, x, label, weight)).orderBy("win").collect()
    count, z = weight.astype(int), x.astype(float)
    everything = np.repeat(z, count, axis=0)
    log = []
    for c in (0, 1):
        own = np.repeat(z[label == c], count[label == c], axis=0)
        mean, var = own.mean(0), own.var(0) + 1e-9 * everything.var(0).max()
        log.append(np.log(len(own) / len(everything)) + (-0.5 * np.log(2 * np.pi * var) - (z - mean) ** 2 / (2 * var)).sum(1))
    assert np.allclose([r.score for r in got], 1 / (1 + np.exp(log[0] - log[1])))


def test_naive_bayes_needs_both_classes(spark):
    x, label, weight = made()
    with pytest.raises(Exception, match="both classes"):
        models.naive_bayes_scores(frame(spark, x, label * 0, weight), frame(spark, x, label, weight)).collect()


def test_logistic_gradient_vanishes(spark):
    """At the optimum of sum(weight * loss) + |b|^2 / (2 C) the gradient is zero."""
    x, label, weight = made()
    model = models.fit_logistic(frame(spark, x, label, weight))
    b, z = model.coefficients.toArray(), x.astype(float)
    p = 1 / (1 + np.exp(-(z @ b + model.intercept)))
    assert np.abs(z.T @ (weight * (p - label)) + b / models.LOGISTIC["C"]).max() < 1e-2
    assert abs((weight * (p - label)).sum()) < 1e-2


def test_balanced_training_holds_every_draw(tables):
    rows = model_queries.training(tables, 0, BALANCED, SEED)
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    pool = statistics_queries.training_rows(tables).filter("fold = 0").count()
    assert totals == {0: pool // 2, 1: pool - pool // 2}


def test_logistic_jobs_share_their_passes(spark, monkeypatch):
    """Jobs fitted together equal plain minima on their own standardised rows, in as many passes as one job needs."""
    x, label, weight = made(200)
    x[:, 3] = 7.0  # no spread
    train = frame(spark, x, label, weight).repartition(3)
    passes, summed = [], logistic._summed
    monkeypatch.setattr(logistic, "_summed", lambda *a: passes.append(1) or summed(*a))
    jobs = [F.col("weight"), (F.col("win") < 150).cast("double"), F.when(F.col("label") == 1, 1.0).otherwise(0.0)]
    fitted = models.fit_logistic_jobs(train, jobs)
    assert len(passes) < 30
    for model, own in zip(fitted, (weight, (np.arange(200) < 150).astype(float))):
        z = x.astype(float)
        centre = np.average(z, axis=0, weights=own)
        spread = np.sqrt(np.average((z - centre) ** 2, axis=0, weights=own))
        scaled = (z - centre) / np.where(spread < models.MIN_SCALE, 1.0, spread)
        b = model["coefficients"]
        p = 1 / (1 + np.exp(-(scaled @ b + model["intercept"])))
        assert np.abs(scaled.T @ (own * (p - label)) + b / models.LOGISTIC["C"]).max() < 1e-4
        assert abs((own * (p - label)).sum()) < 1e-4
    scored = logistic.score(train, fitted, [F.lit(True)] * 3, ["win"]).filter("job = 2")
    assert {r.score for r in scored.collect()} == {1.0}  # rows of one class


def test_all_logistic_jobs_of_an_evaluation_are_one_fit(tables, monkeypatch):
    calls, fit = [], logistic.fit
    monkeypatch.setattr(logistic, "fit", lambda rows, weights, *a, **k: calls.append(len(weights)) or fit(rows, weights, *a, **k))
    assert model_queries.ml_07(tables).count() == 15
    assert calls == [15]


def test_job_weights_are_the_training_windows(tables):
    jobs = [(1, model_queries.NATURAL, SEED), (1, BALANCED, SEED)]
    rows, weights = model_queries.job_weights(tables, jobs)
    for weight, (fold, recipe, seed) in zip(weights, jobs):
        got = {(r.recording_id, r.win): r.w for r in rows.select("recording_id", "win", weight.alias("w")).filter("w > 0").collect()}
        want = {(r.recording_id, r.win): r.weight for r in model_queries.training(tables, fold, recipe, seed).collect()}
        assert got == want


def test_a_saved_logistic_model_scores_as_the_fitted_one(tables):
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(model_queries.snk_06(tables)) == rows(model_queries.ml_02(tables))


def forest_rows(spark, n=600, width=5):
    x, label, _ = made(n, width)
    x[:, 0] += 4 * label  # one feature tells much
    frame_ = frame(spark, x, label, np.ones(n)).repartition(4)
    train, asked = [F.col("win") % 3 != 0, F.col("win") % 3 != 1], [F.col("win") % 3 == 0, F.col("win") % 3 == 1]
    scored = models.forest_scores(frame_, train, asked, ["recording_id", "win"], SEED, trees=12)
    return {(r.win, r.fold): (r.label, r.score) for r in scored.collect()}


def test_forest_scores_every_held_out_row_once_and_learns(spark):
    got = forest_rows(spark)
    assert set(got) == {(k, k % 3) for k in range(600) if k % 3 < 2}
    assert np.mean([(s >= 0.5) == y for y, s in got.values()]) > 0.75
    assert len({s for _, s in got.values()}) > 5


@pytest.mark.parametrize("limit", [150, 10])
def test_forest_of_nodes_split_over_all_rows_is_the_same(spark, monkeypatch, limit):
    """Large nodes by summed histograms, a pass of few nodes at a time, give the trees grown in one task."""
    whole = forest_rows(spark)
    monkeypatch.setattr(forest, "NODE_ROWS", limit)
    monkeypatch.setattr(forest, "PASS_NODES", 50)
    assert forest_rows(spark) == whole


def test_forest_bootstrap_is_poisson_and_candidates_differ():
    key = np.arange(200_000, dtype=np.uint64)
    w = forest._weights(key, SEED, 0, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, forest._weights(key, SEED, 0, 4))[0, 1]) < 0.01
    drawn = forest._candidates(np.arange(1, 4001), 158, SEED, 0, 3)
    assert drawn.shape == (4000, 13) and (np.diff(drawn) > 0).all()
    assert abs(np.bincount(drawn.ravel(), minlength=158) / 4000 * 158 / 13 - 1).max() < 0.25


def test_forest_splits_at_the_best_gini_gain():
    """A grown stump equals the best of all cuts tried one by one."""
    rng = np.random.default_rng(3)
    bins, label, weight = rng.integers(0, 8, (300, 1)).astype(np.uint8), rng.integers(0, 2, 300), rng.integers(1, 3, 300).astype(float)
    label = np.where(bins[:, 0] > 4, 1, label)
    gini = lambda m: (lambda q: 2 * q * (1 - q) * weight[m].sum())(np.average(label[m], weights=weight[m]))
    cut = min(range(7), key=lambda b: gini(bins[:, 0] <= b) + gini(bins[:, 0] > b))
    want = [np.average(label[m], weights=weight[m]) for m in (bins[:, 0] <= cut, bins[:, 0] > cut)]
    got = forest._grow(bins, label, weight, np.ones(300, dtype=int), np.ones(300, dtype=bool), 1, 8, SEED, 0, 0)
    assert np.allclose(got, np.where(bins[:, 0] <= cut, *want))


def boosted_rows(spark, rounds, n=600, width=5):
    x, label, _ = made(n, width)
    x[:, 0] += 4 * label  # one feature tells much
    frame_ = frame(spark, x, label, np.ones(n)).repartition(4)
    train, asked = [F.col("win") % 3 != 0, F.col("win") % 3 != 1], [F.col("win") % 3 == 0, F.col("win") % 3 == 1]
    scored = models.boosting_scores(frame_, train, asked, ["recording_id", "win"], SEED, rounds=rounds)
    return {(r.win, r.fold): (r.label, r.score) for r in scored.collect()}


def test_boosting_scores_every_held_out_row_once_and_learns(spark):
    few, many = boosted_rows(spark, 2), boosted_rows(spark, 40)
    assert set(few) == set(many) == {(k, k % 3) for k in range(600) if k % 3 < 2}
    assert np.mean([(s >= 0.5) == y for y, s in many.values()]) > 0.75
    loss = [-np.mean([np.log(s if y else 1 - s) for y, s in got.values()]) for got in (few, many)]
    assert loss[1] < loss[0] < np.log(2)


def test_boosting_of_folds_summed_over_all_rows_is_the_same(spark, monkeypatch):
    whole = boosted_rows(spark, 5)
    monkeypatch.setattr(boosting, "TASK_ROWS", 10)
    monkeypatch.setattr(boosting, "RENEWED", 2)
    assert boosted_rows(spark, 5) == whole


def test_boosting_rounds_of_folds_that_fit_a_task_are_no_jobs(spark):
    context, jobs = spark.sparkContext, []
    for rounds in (2, 25):
        context.setJobGroup(f"boosting-{rounds}", "rounds")
        boosted_rows(spark, rounds)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"boosting-{rounds}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_boosting_splits_at_the_best_gain():
    rng = np.random.default_rng(3)
    bins, label = rng.integers(0, 6, (3, 200)).astype(np.uint8), rng.integers(0, 2, 200)
    g, h = boosting._slopes(np.full(200, 0.3), label)
    sums = boosting._sums(bins, np.arange(200), np.zeros(200, dtype=int), (g, h), [0, 2], 1, 6)
    (feature,), (cut,), left, right = boosting._best(sums, np.array([0, 2]))
    g, h = g / boosting.UNIT, h / boosting.UNIT
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + boosting.LAMBDA)
    gains = {(j, c): part(bins[j] <= c) + part(bins[j] > c) for j in (0, 2) for c in range(5)}
    assert gains[feature, cut] == max(gains.values())
    below = bins[feature] <= cut
    assert np.allclose([*left[0], *right[0]], [g[below].sum(), h[below].sum(), g[~below].sum(), h[~below].sum()])


def test_boosting_sums_many_rows_by_two_columns_at_a_time(monkeypatch):
    """Joint bins give the sums of single columns in half the passes, also in pieces and with a column left over."""
    rng = np.random.default_rng(4)
    bins, place = rng.integers(0, 4, (5, 3000)).astype(np.uint8), rng.integers(0, 3, 2000)
    slopes = [np.rint(rng.normal(size=3000) * boosting.UNIT) for _ in range(2)]
    rows, columns = np.sort(rng.choice(3000, 2000, replace=False)), np.array([0, 2, 4])
    want = np.zeros((3, 3, 4, 2))
    for r, node in zip(rows, place):
        for k, j in enumerate(columns):
            want[node, k, bins[j, r]] += [slopes[0][r], slopes[1][r]]
    passes, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: passes.append(1) or count(*a))
    assert (boosting._sums(bins, rows, place, slopes, columns, 3, 4) == want).all()
    assert len(passes) == 4  # two for the pair and two for the last column
    monkeypatch.setattr(boosting, "CHUNK", 300)
    assert (boosting._sums(bins, rows, place, slopes, columns, 3, 4) == want).all()


@pytest.mark.parametrize("chosen", [range(5), [0, 3]])
def test_boosting_folds_do_not_share_a_task(spark, chosen):
    blocks = spark.createDataFrame([(fold,) for fold in chosen for _ in range(3)], "fold int")
    dealt = boosting._dealt(blocks, list(chosen)).select("fold", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(dealt) == len(chosen) == len({r.task for r in dealt})


def test_forest_splits_of_few_and_of_many_rows_are_those_of_all_counts():
    """Counts by bin, also in pieces of rows, and rows sorted by bin give the first best split of plain counts."""
    rng = np.random.default_rng(6)
    bins, label = rng.integers(0, 6, (900, 7)).astype(np.uint8), rng.integers(0, 2, 900)
    place, weight = np.sort(rng.integers(0, 40, 900)), rng.integers(1, 17, 900)
    features = np.sort(np.argsort(rng.random((40, 7)), axis=1)[:, :3], axis=1)
    slot, cut = forest._best(forest._counts(bins, place, label, weight.astype(float), features, 6))
    total, ones = np.bincount(place, weight, 40), np.bincount(place, weight * label, 40)
    common = (features, total, ones, 6, 7)
    packed = weight * (1.0 + label * forest._PACK)
    for a, b in ((forest._best_by_bin, packed), (forest._best_by_row, weight * 2 + label)):
        purity, got_slot, got_cut = a(bins.ravel(), np.arange(900), place, b, *common)
        gains = purity / total - (ones**2 + (total - ones) ** 2) / total**2 > 1e-12
        assert (np.where(gains, got_slot, -1) == slot).all() and (got_cut[gains] == cut[gains]).all()


def test_forest_rows_are_copied_by_slots_not_by_trees():
    """Five folds on twelve slots: seven copies for 200 trees, and a fold of a million rows needs no copy a tree."""
    assert -(-200 // forest._chunk(200, 5, 12)) == 7
    assert 5 * -(-2000 // forest._chunk(2000, 5, 12)) <= forest.COPIES * 12
    assert forest._chunk(3, 5, 12) == 3
    assert forest.NODE_ROWS > 1_050_000


def test_naive_bayes_folds_share_their_passes(spark):
    """Folds fitted together score as each fitted alone, in as many jobs as one fold needs."""
    x, label, _ = made(200)
    rows = frame(spark, x, label, np.ones(200)).repartition(3)
    train, asked = [F.col("win") % 3 != k for k in range(3)], [F.col("win") % 3 == k for k in range(3)]
    context, jobs = spark.sparkContext, []
    for folds in (1, 3):
        context.setJobGroup(f"bayes-{folds}", "folds")
        got = models.naive_bayes_fold_scores(rows, train[:folds], asked[:folds], ["win"]).collect()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"bayes-{folds}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
    alone = {(r.win, k): r.score for k in range(3) for r in models.naive_bayes_scores(rows.filter(train[k]), rows.filter(asked[k])).collect()}
    assert {(r.win, r.fold): pytest.approx(r.score) for r in got} == alone and len(got) == 200
