"""Metric, alarm, selection and statistics fixtures with literal expectations."""

import pytest
from pyspark.sql import functions as F

from motionframe.operators import alarms, folds, metrics, sampling, selection, statistics
from motionframe.operators.statistics import COUNTS

SCORE = "recording_id string, is_fall boolean, n long, pos long, end_sample int, label int, score double, threshold double"
EVENT = "recording_id string, onset long, impact long, stop long, code string"
ONE = [("one", 1, 1, True, 0.0)]


def test_false_positives_per_hour(spark):
    frame = spark.createDataFrame([(0, s, 0.5) for s in (0.1, 0.8, 0.7, 0.2)], "label int, score double, threshold double")
    row = metrics.false_positives_per_hour(frame, []).first()
    assert (row.false_positive_windows, row.negative_hours, row.false_positive_windows_per_hour) == (2, 2 / 3600, 3600.0)


def test_single_class_is_undefined(spark):
    frame = spark.createDataFrame([("j", 0, s, 0.5) for s in (0.1, 0.2, 0.8, 0.9)], "job string, label int, score double, threshold double")
    row = metrics.classification(frame, ["job"]).join(metrics.ranking(frame, ["job"]), "job").first()
    assert (row.tn, row.fp, row.specificity) == (2, 2, 0.5)
    assert row.balanced_accuracy is None and row.mcc is None and row.auroc is None and row.auprc is None


def test_best_threshold(spark):
    frame = spark.createDataFrame([("j", l, s) for l, s in ((0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9))], "job string, label int, score double")
    row = metrics.best_threshold(frame, ["job"]).first()
    assert (row.threshold, row.balanced_accuracy) == (0.6, 1.0)
    assert row.mcc == pytest.approx(1.0)


def test_useless_scores_take_the_closest_to_half(spark):
    frame = spark.createDataFrame([("j", 0, 0.5), ("j", 1, 0.5)], "job string, label int, score double")
    row = metrics.best_threshold(frame, ["job"]).first()
    assert row.threshold == 0.5 and row.balanced_accuracy == 0.5


def test_policy_with_cooldown(spark):
    flags = [0, 1, 1, 0, 1, 1, 1]
    rows = [("r", True, 200, i, 13 * i + 1, 0, float(f), 0.5) for i, f in enumerate(flags)]
    got = alarms.alarms(spark.createDataFrame(rows, SCORE), [("p", 2, 3, False, 1.5)], by=()).collect()
    assert sorted(r.decision // 13 for r in got) == [2, 5]


def test_event_without_windows_is_a_miss(spark):
    scores = spark.createDataFrame([("a", True, 60, 0, 50, 1, 0.9, 0.5)], SCORE)
    events = spark.createDataFrame([("a", 0, 20, 50, "F"), ("b", 0, 20, 50, "F")], EVENT)
    scope = spark.createDataFrame([(1, "a", True), (1, "b", True)], "one int, recording_id string, is_fall boolean")
    scores = scores.withColumn("one", F.lit(1))
    row = metrics.event_metrics(scores, events, scope, ("one",), ("one",)).first()
    assert (row.fall_events, row.detected_events, row.events_without_positive_decision_window, row.event_sensitivity) == (2, 1, 1, 0.5)
    alarm = alarms.alarm_metrics(scores, events, ONE, scope, ("one",), ("one",)).first()
    assert (alarm.fall_events, alarm.events_without_positive_decision_window, alarm.detected_events) == (2, 1, 1)


@pytest.mark.parametrize("middle,cooldown,detected,episodes", [(0.9, 0.0, 2, 1), (0.1, 10.0, 1, 0)])
def test_several_events_in_one_sequence(spark, middle, cooldown, detected, episodes):
    rows = [("a", True, 200, i, e, l, s, 0.5) for i, (e, l, s) in enumerate([(50, 1, 0.9), (100, 0, middle), (150, 1, 0.9)])]
    scores = spark.createDataFrame(rows, SCORE).withColumn("one", F.lit(1))
    events = spark.createDataFrame([("a", 25, 40, 75, "F"), ("a", 125, 140, 175, "F")], EVENT)
    row = alarms.alarm_metrics(scores, events, [("p", 1, 1, True, cooldown)], by=("one",)).first()
    assert (row.fall_events, row.detected_events, row.adl_alarm_episodes) == (2, detected, episodes)
    assert row.adl_negative_window_hours == 0.5 / 3600


def test_half_to_even_cooldown():
    assert [alarms.cooldown_samples(s, 1.0) for s in (2.5, 3.5)] == [2, 4]


def policy_table(spark, rows):
    schema = "job string, alarm_policy_id string, event_sensitivity double, adl_alarm_episodes_per_hour double, onset_latency_p95_s double"
    return spark.createDataFrame([("j", *r) for r in rows], schema)


def test_pareto(spark):
    rows = policy_table(spark, [("sensitive", 1.0, 3.0, 1.0), ("balanced", 0.9, 1.0, 1.5), ("dominated", 0.8, 2.0, 2.0), ("late", 0.9, 1.0, None)])
    assert sorted(r.alarm_policy_id for r in alarms.pareto(rows, ["job"]).collect()) == ["balanced", "sensitive"]


def test_guarded_policy(spark):
    rows = policy_table(spark, [("sensitive", 0.95, 4.0, 1.0), ("b-policy", 0.94, 1.0, 2.0), ("a-policy", 0.94, 1.0, 2.0), ("cheap", 0.939, 0.0, 0.0)])
    row = alarms.choose_policy(rows, 1.0, ["job"]).first()
    assert row.eligible_policy_ids == "a-policy,b-policy,sensitive" and row.selected_policy_id == "a-policy"


def test_fold_roles(spark):
    rows = [(f"r{i}", i // 2) for i in range(10)] + [("t1", -1), ("t2", -1)]
    roles = folds.assign_roles(spark.createDataFrame(rows, "recording_id string, fold_id int")).filter("fold = 0")
    got = {r.role: set(r.f) for r in roles.groupBy("role").agg(F.collect_set("fold_id").alias("f")).collect()}
    assert got == {"train": {-1, 2, 3, 4}, "validation": {1}, "test": {0}}


def test_balanced_sampling(spark):
    rows = [(0, l, "d", p, f"r{i}", 0) for i, (l, p) in enumerate(zip((0, 0, 0, 0, 1, 1), "aabbcd"))]
    frame = spark.createDataFrame(rows, "fold int, label int, dataset_id string, participant_id string, recording_id string, win int")
    draw = lambda: sorted(map(tuple, sampling.balanced_sample(frame, ["fold"]).collect()))
    sample = draw()
    assert [sum(r[1] == c for r in sample) for c in (0, 1)] == [3, 3]
    assert sample == draw()


def test_job_counts(spark):
    five = spark.range(5).select(F.col("id").alias("fold"))
    models = ["rule", "logistic", "forest", "boosting", "cnn", "lstm", "cnn_lstm"]
    main = selection.job_grid(five, models, [3888, 5171, 8438, 12011, 17027], "rule", ("logistic",))
    core = selection.job_grid(five, models, [3888], "rule", ("logistic",))
    assert (main.count(), core.count(), main.filter("model_id = 'rule'").count()) == (265, 65, 5)


def stats_frame(spark):
    rows = [("d" + str(i % 2), f"p{i}", i + 1, i % 3, (i * 7) % 5, 100 * i, ["chest"] if i % 2 else ["wrist", "chest"]) for i in range(10)]
    return rows, spark.createDataFrame(
        rows, "dataset_id string, participant_id string, sequences long, fall_sequences long, events long, adl_rows long, body_locations array<string>"
    )


def best_fold_by_definition(rows, fixed):
    """Brute force: load every fold with each candidate and compare total costs."""
    import hashlib

    quantities = {}
    for d, p, _, fall, ev, adl, loc in rows:
        quantities[d, p] = {"participants": 1, "fall": fall, "events": ev, "adl": adl, ("d", d): 1, **{("l", b): 1 for b in loc}}
    names = {q for v in quantities.values() for q in v}
    target = {q: max(sum(v.get(q, 0) for v in quantities.values()) / 5, 1) for q in names}
    placed = dict(fixed)
    key = lambda r: (-r[4], -r[3], -r[5], hashlib.sha256(f"3888:{r[0]}:{r[1]}".encode()).hexdigest())
    for r in sorted((r for r in rows if (r[0], r[1]) not in fixed), key=key):
        who = (r[0], r[1])

        def cost(f, who=who):
            members = [v for k, v in quantities.items() if placed.get(k) == f] + [quantities[who]]
            total = sum(((sum(v.get(q, 0) for v in members) - target[q]) / target[q]) ** 2 for q in names)
            return round(total, 9), hashlib.sha256(f"3888:{who[0]}:{who[1]}:{f}".encode()).hexdigest()

        placed[who] = min(range(5), key=cost)
    return placed


def test_sticky_folds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(selection, "STICKY_BATCH", 2)
    rows, stats = stats_frame(spark)
    fixed = {(r[0], r[1]): i for i, r in enumerate(rows[:5])}
    existing = spark.createDataFrame([(*k, f) for k, f in fixed.items()], "dataset_id string, participant_id string, fold_id int")
    got = {(r.dataset_id, r.participant_id): r.fold_id for r in selection.propose_folds(stats, existing, str(tmp_path)).collect()}
    assert got == best_fold_by_definition(rows, fixed)
    stranger = existing.union(spark.createDataFrame([("d0", "nobody", 1)], existing.schema))
    with pytest.raises(ValueError):
        selection.propose_folds(stats, stranger, str(tmp_path))


def counts_frame(spark):
    rows = []
    for model, recipe in (("rule", "not_applicable"), ("forest", "natural"), ("forest", "participant_class_balanced")):
        for p in range(2):
            base = [5 + p, 1, 1, 3 + p, 2, 1, 0.1, p]
            rows.append((model, recipe, 0, 3888, "d", f"p{p}", *map(float, base)))
    names = ", ".join(f"{c} double" for c in COUNTS)
    return spark.createDataFrame(rows, f"model_id string, recipe string, fold int, seed int, dataset_id string, participant_id string, {names}")


def test_bootstrap_outputs(spark):
    counts = counts_frame(spark)
    assert statistics.completeness(counts).filter("complete").count() == 3
    aggregate = statistics.bootstrap(counts, 20)
    assert aggregate.count() == 15
    assert aggregate.filter("ci_lower_95 > estimate + 1e-9 and metric = 'nothing'").count() == 0
    pairs = statistics.paired_bootstrap(counts, 20, "rule", "not_applicable")
    assert {r.comparison for r in pairs.select("comparison").distinct().collect()} == {"model_vs_threshold", "balanced_minus_natural"}
    weights = statistics.resampled(counts.withColumns({"unit": F.col("model_id"), "side": F.col("recipe"), **{c: F.lit(1.0) for c in COUNTS}}), 20)
    assert weights.filter("tn <> 2").count() == 0


def test_incomplete_method_is_left_out(spark):
    counts = counts_frame(spark)
    holed = counts.union(counts.filter("model_id = 'forest' and participant_id = 'p0'").withColumn("seed", F.lit(1)))
    assert statistics.bootstrap(holed, 5).select("model_id").distinct().count() == 1


def test_single_fold_has_no_spread(spark):
    frame = spark.createDataFrame([("m", 0, 0.5)], "model_id string, fold int, f1 double")
    row = statistics.fold_spread(frame, ["model_id"], ["f1"]).first()
    assert (row["mean"], row["std"]) == (0.5, 0.0)
