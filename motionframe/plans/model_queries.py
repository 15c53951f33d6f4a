"""Models, selection, custom functions and streaming."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.constants import BALANCED, FOLD_COUNT, JOB, NATURAL, NOT_APPLICABLE, POLICIES, REFERENCE_POLICY, SEED
from motionframe.functions.exprs import r6
from motionframe.operators import alarms, custom, logistic, metrics, models, sampling, selection
from motionframe.plans import statistics_queries  # noqa: F401  (defines shared SQL parts)
from motionframe.plans.collection_queries import job_hash, scheduled, scratch, stats_of
from motionframe.plans.feature_queries import HOURLY, user_series
from motionframe.plans.metric_queries import (
    RATES,
    _ROUND,
    alarm_columns,
    fold_scope,
    job_columns,
    longs,
    rounded,
    stored_thresholds,
    test_scores,
    validation_alarms,
)
from motionframe.plans.registry import query
from motionframe.plans.sql import COUNTS, JL, J, alarms_sql, ctes, part, rates
from motionframe.streaming import processors

# -- fitted baselines over the window features ---------------------------------

WINDOW = ["recording_id", "win"]


def in_training(fold):
    """Whether a window trains the fold: it neither tests nor validates it. One without a fold always does."""
    return (F.col("fold_id") != fold) & (F.col("fold_id") != (fold + 1) % FOLD_COUNT)


def training(t, fold, recipe=NATURAL, seed=SEED):
    """Training windows of a fold with their weight: each once, or as often as the balanced recipe draws it."""
    rows = t.features.filter(in_training(fold))
    if recipe == NATURAL:
        return rows.withColumn("weight", F.lit(1.0))
    pool = statistics_queries.training_rows(t).filter(F.col("fold") == fold)
    drawn = sampling.balanced_sample(pool, ["fold"], seed)
    return rows.join(drawn.groupBy(*WINDOW).agg(F.count(F.lit(1)).cast("double").alias("weight")), WINDOW)


def job_weights(t, jobs):
    """Windows with ``draws``, and the weight of a window in each job (fold, recipe, seed).

    ``draws`` counts how often each balanced recipe draws the window; a window that none draws has none."""
    balanced = [job for job in jobs if job[1] == BALANCED]
    if not balanced:
        return t.features, [in_training(fold).cast("double") for fold, _, _ in jobs]
    pool = statistics_queries.training_rows(t)
    drawn = [sampling.balanced_sample(pool, ["fold"], seed).select("fold", F.lit(seed).alias("seed"), *WINDOW) for seed in sorted({job[2] for job in balanced})]
    drawn = reduce(DataFrame.unionByName, drawn)
    counts = [F.count(F.when((F.col("fold") == fold) & (F.col("seed") == seed), 1)).cast("double") for fold, _, seed in balanced]
    rows = t.features.join(drawn.groupBy(*WINDOW).agg(F.array(*counts).alias("draws")), WINDOW, "left")

    def weight(job):
        if job[1] == NATURAL:
            return in_training(job[0]).cast("double")
        return F.coalesce(F.col("draws")[balanced.index(job)], F.lit(0.0))

    return rows, [weight(job) for job in jobs]


def split(t, fold):
    return training(t, fold), t.features.filter(F.col("fold_id") == fold)


def scaled(train, *others):
    """All frames standardised by the weighted moments of the training windows."""
    parameters = models.array_standardisation(train, weight="weight")
    return tuple(models.standardise_array(frame, parameters) for frame in (train, *others))


def predictions(rows, *more):
    return rows.select("recording_id", *longs("win", "label"), F.round("score", 4).alias("score"), *more)


def every_fold(build):
    """Union of ``build(fold)`` over the folds, with the fold as a column.

    Fits are short jobs that follow one another, so the folds are fitted side by side.
    """
    with ThreadPoolExecutor(FOLD_COUNT) as pool:
        made = list(pool.map(build, range(FOLD_COUNT)))
    parts = [frame.withColumn("fold", F.lit(fold).cast("long")) for fold, frame in enumerate(made)]
    return reduce(DataFrame.unionByName, parts)


part("fx", """
SELECT recording_id, win, fold_id AS f, temporal_label AS label, unnest(range(0, len(v))) AS j, unnest(v::FLOAT[])::DOUBLE AS x
FROM fvec JOIN kept USING (recording_id, win) WHERE temporal_label >= 0
""", "fvec", "kept")
part("vt", "SELECT vec_id, unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS x, (label < 5)::INTEGER AS label, vec_id % 5 AS f FROM embeddings")


@query(
    "agg_24_feature_standardisation",
    ctes("fx") + "SELECT k AS fold, j, round(avg(x), 4) + 0.0 AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END, 4) AS scale FROM fx, range(5) r(k) WHERE f NOT IN (k, (k + 1) % 5) GROUP BY k, j",
)
def agg_24(t):
    rounds = [(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "scale")]
    return every_fold(lambda k: models.array_standardisation(split(t, k)[0]).select(*longs("j"), *rounds))


@query(
    "ml_01_rule_baseline",
    ctes("scored") + "SELECT fold_id::BIGINT AS fold_id, temporal_label::BIGINT AS temporal_label, count(*) AS windows, round(avg(impact_score), 6) AS mean_score, round(max(impact_score), 6) AS max_score FROM scored GROUP BY ALL",
)
def ml_01(t):
    groups = [F.col(c).cast("long").alias(c) for c in ("fold_id", "temporal_label")]
    return t.scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("windows"), r6(F.avg("impact_score")).alias("mean_score"), r6(F.max("impact_score")).alias("max_score")
    )


def logistic_folds(t):
    """A logistic regression a fold, all in the same passes over the windows."""
    return models.fit_logistic_jobs(t.features, [in_training(fold).cast("double") for fold in range(FOLD_COUNT)])


def logistic_predictions(t, fitted):
    held = logistic.score(t.features, fitted, [F.col("fold_id") == fold for fold in range(FOLD_COUNT)], [*WINDOW, "label"])
    return predictions(held, F.col("job").cast("long").alias("fold"))


@query("ml_02_logistic_regression")
def ml_02(t):
    return logistic_predictions(t, logistic_folds(t))


@query("ml_03_random_forest")
def ml_03(t):
    folds = range(FOLD_COUNT)
    scored = models.forest_scores(t.features, [in_training(k) for k in folds], [F.col("fold_id") == k for k in folds], WINDOW, SEED)
    return predictions(scored, F.col("fold").cast("long").alias("fold"))


@query("ml_04_gradient_boosting")
def ml_04(t):
    """All 200 rounds, which run one after the other, in every fold."""
    folds = range(FOLD_COUNT)
    scored = models.boosting_scores(t.features, [in_training(k) for k in folds], [F.col("fold_id") == k for k in folds], WINDOW, SEED)
    return predictions(scored, F.col("fold").cast("long").alias("fold"))


@query(
    "ml_05_gaussian_naive_bayes",
    ctes("fx") + """, tr AS (SELECT * FROM fx, range(5) r(k) WHERE f NOT IN (k, (k + 1) % 5)),
    sm AS (SELECT k, max(v) * 1e-9::DOUBLE AS e FROM (SELECT k, var_pop(x) AS v FROM tr GROUP BY k, j) GROUP BY k),
    mo AS (SELECT k, label, j, avg(x) AS m, var_pop(x) + max(e) AS v, count(*) AS c FROM tr JOIN sm USING (k) GROUP BY k, label, j),
    pr AS (SELECT k, label, ln(c::DOUBLE / sum(c) OVER (PARTITION BY k)) AS p FROM mo WHERE j = 0),
    ll AS (SELECT recording_id, win, mo.k, mo.label AS c, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) + max(p) AS s FROM fx JOIN mo ON mo.j = fx.j AND mo.k = fx.f
      JOIN pr ON pr.label = mo.label AND pr.k = mo.k GROUP BY recording_id, win, mo.k, mo.label)
    SELECT recording_id, win::BIGINT AS win, k AS fold, round(1.0::DOUBLE / (1.0::DOUBLE + exp(least(700, max(s) FILTER (c = 0) - max(s) FILTER (c = 1)))), 4) AS score FROM ll GROUP BY recording_id, win, k""",
)
def ml_05(t):
    """All folds in one pass for the moments and one for the scores."""
    folds = range(FOLD_COUNT)
    scored = models.naive_bayes_fold_scores(t.features, [in_training(k) for k in folds], [F.col("fold_id") == k for k in folds], WINDOW)
    return scored.select("recording_id", *longs("win"), F.round("score", 4).alias("score"), *longs("fold"))


@query("ml_07_batched_evaluation")
def ml_07(t):
    """One fit per fold, recipe and seed, all in the same passes over the windows; scores are written
    once, thresholds come from the validation scores, and one plan computes the metrics of all jobs."""
    path = scratch(t, "fitted_scores")
    jobs = [(fold, recipe, seed) for fold in range(FOLD_COUNT) for recipe, seed in ((NATURAL, SEED), (BALANCED, SEED), (BALANCED, SEED + 1))]
    rows, weights = job_weights(t, jobs)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows = t.spark.read.schema(rows.schema).parquet(f"{path}/rows")
    fitted = models.fit_logistic_jobs(rows, weights)
    roles = [F.col("fold_id").isin(fold, (fold + 1) % FOLD_COUNT) for fold, _, _ in jobs]
    scored = logistic.score(rows, fitted, roles, [*WINDOW, "label", "fold_id"])
    names = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(JOB, ("logistic", recipe, fold, seed), strict=True)]) for fold, recipe, seed in jobs])
    part_of = F.when(F.col("fold_id") == F.col("_j.fold"), "test").otherwise("validation").alias("split")
    shards = scored.withColumn("_j", names[F.col("job")]).select(*[F.col(f"_j.{c}").alias(c) for c in JOB], part_of, *WINDOW, "label", "score")
    shards.write.mode("overwrite").parquet(f"{path}/scores")
    scores = t.spark.read.schema(shards.schema).parquet(f"{path}/scores")
    test = scores.filter("split = 'test'")
    limits = metrics.best_threshold(scores.filter("split = 'validation'"))
    table = metrics.classification(metrics.apply_threshold(test, limits)).join(metrics.ranking(test), list(JOB))
    return table.select(*job_columns(), *metrics.COUNTS, *[F.round(m, 3).alias(m) for m in ("accuracy", "balanced_accuracy", "auroc", "auprc")])


@query("snk_06_fitted_model")
def snk_06(t):
    """A model saved and loaded again gives the scores it was saved with."""
    path = scratch(t, "logistic_model")
    rows = [
        (fold, *([float(v) for v in model[c]] for c in ("centre", "scale", "coefficients")), model["intercept"])
        for fold, model in enumerate(logistic_folds(t))
    ]
    schema = "fold int, centre array<double>, scale array<double>, coefficients array<double>, intercept double"
    t.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return logistic_predictions(t, [r.asDict() for r in t.spark.read.schema(schema).parquet(path).orderBy("fold").collect()])


# -- selection ----------------------------------------------------------------


@query(
    "sel_04_guarded_policy",
    ctes("valm") + f"""SELECT {JL}, round(max(mx), 6) AS maximum_event_sensitivity, round(max(mx) - 0.01, 6) AS eligibility_cutoff, string_agg(alarm_policy_id, ',' ORDER BY alarm_policy_id) AS eligible_policy_ids,
    arg_min(alarm_policy_id, {{'a': episodes_per_hour, 'b': coalesce(lat95, 'infinity'::DOUBLE), 'c': alarm_policy_id}}) AS selected_policy_id
    FROM (SELECT *, max(event_sensitivity) OVER (PARTITION BY {J}) AS mx FROM valm) WHERE event_sensitivity >= mx - 0.01::DOUBLE - 1e-12 GROUP BY {J}""",
)
def sel_04(t):
    table = alarms.choose_policy(validation_alarms(t), 1.0, JOB)
    return table.select(*job_columns(), *rounded("maximum_event_sensitivity", "eligibility_cutoff"), "eligible_policy_ids", "selected_policy_id")


@query(
    "top_02_cheapest_policy",
    ctes("alm") + f"""SELECT {JL}, arg_min(alarm_policy_id, {{'a': episodes_per_hour, 'b': coalesce(lat95, 'infinity'::DOUBLE), 'c': alarm_policy_id}}) AS policy FROM alm GROUP BY {J}""",
)
def top_02(t):
    from motionframe.plans.metric_queries import ALL_POLICIES

    rows = alarms.alarm_metrics(test_scores(t), t.events, ALL_POLICIES, fold_scope(t))
    latency = F.coalesce("onset_latency_p95_s", F.lit(float("inf")))
    best = F.min(F.struct("adl_alarm_episodes_per_hour", latency.alias("l"), "alarm_policy_id"))["alarm_policy_id"]
    return rows.groupBy(*JOB).agg(best.alias("policy")).select(*job_columns(), "policy")


@query(
    "jn_06_dominated_policies",
    ctes("valm", "par") + f"SELECT {JL}, count(*) AS policies, count(*) - count(p.alarm_policy_id) AS dominated FROM valm LEFT JOIN par p USING ({J}, alarm_policy_id) GROUP BY {J}",
)
def jn_06(t):
    rows = validation_alarms(t)
    front = alarms.pareto(rows).groupBy(*JOB).agg(F.count(F.lit(1)).alias("front"))
    total = stored_thresholds(t).select(*JOB, F.lit(len(POLICIES)).cast("long").alias("policies"))
    return total.join(front, list(JOB)).select(*job_columns(), "policies", (F.col("policies") - F.col("front")).alias("dominated"))


part("pool", f"""
SELECT * EXCLUDE (label), label, score >= th AS alert, end_sample - 1 AS decision FROM (SELECT * FROM scores WHERE split = 'validation' AND seed = {SEED} AND recipe <> '{BALANCED}' AND start_sample % 25 = 0)
JOIN (SELECT model_id, arg_min(t, {{'a': abs(t - 0.5), 'b': t}}) AS th FROM (
  SELECT *, max(bacc) OVER (PARTITION BY model_id) AS best FROM (
    SELECT model_id, t, (sum(pos_n) OVER w / sum(pos_n) OVER (PARTITION BY model_id) + (1.0::DOUBLE - sum(neg_n) OVER w / sum(neg_n) OVER (PARTITION BY model_id))) / 2.0::DOUBLE AS bacc FROM (
      SELECT model_id, score AS t, count(*) FILTER (label = 1)::DOUBLE AS pos_n, count(*) FILTER (label = 0)::DOUBLE AS neg_n FROM scores
      WHERE split = 'validation' AND seed = {SEED} AND recipe <> '{BALANCED}' AND start_sample % 25 = 0 GROUP BY ALL) WINDOW w AS (PARTITION BY model_id ORDER BY t DESC)))
  WHERE bacc >= best - 1e-12 GROUP BY model_id) USING (model_id)
""", "scores")
alarms_sql("poolm", "pool", "SELECT model_id, recording_id, any_value(is_fall) AS is_fall FROM pool GROUP BY model_id, recording_id", POLICIES, "model_id", 1.0)
part("poolc", f"SELECT *, {rates()} FROM (SELECT model_id, max(th) AS threshold, {COUNTS} FROM pool GROUP BY model_id)", "pool")


def pooled_scores(t):
    """The five validation shards of a method, at the deployment interval."""
    chosen = t.job_scores("validation").filter((F.col("seed") == SEED) & (F.col("recipe") != BALANCED))
    rows = scheduled(chosen, 1.0)
    limits = metrics.best_threshold(rows, ["model_id"])
    windows = scheduled(t.kept.filter("temporal_label >= 0 and fold_id >= 0"), 1.0)
    places = metrics.survivors_with_size(windows).select("recording_id", "win", "pos")
    return metrics.apply_threshold(rows, limits, ["model_id"]).drop("pos").join(places, ["recording_id", "win"])


@query(
    "sel_05_pooled_selection_evidence",
    ctes("poolm", "poolc") + f"""SELECT model_id, threshold, n, positive, round(balanced_accuracy, 6) AS balanced_accuracy, alarm_policy_id, fall_events::BIGINT AS fall_events, detected_events,
    episodes AS adl_alarm_episodes, round(episodes_per_hour, 6) AS adl_alarm_episodes_per_hour, round(lat95, 6) AS onset_latency_p95_s FROM poolm JOIN poolc USING (model_id)""",
)
def sel_05(t):
    scores = pooled_scores(t)
    window = metrics.classification(scores, ["model_id", "threshold"]).select("model_id", "threshold", "n", "positive", "balanced_accuracy")
    alarm = alarms.alarm_metrics(scores, t.events, POLICIES, by=["model_id"], stride_s=1.0)
    return alarm.join(window, "model_id").select(
        "model_id", "threshold", "n", "positive", *rounded("balanced_accuracy"), "alarm_policy_id", "fall_events", "detected_events",
        "adl_alarm_episodes", *rounded("adl_alarm_episodes_per_hour", "onset_latency_p95_s"),
    )


@query(
    "sel_06_participant_once_proof",
    ctes("scores") + """SELECT fold::BIGINT AS fold, count(*) AS participants, count(*) FILTER (a > 1) AS repeated_participants FROM (
    SELECT fold, count(*) OVER (PARTITION BY dataset_id, participant_id) AS a FROM (SELECT DISTINCT fold, dataset_id, participant_id FROM scores WHERE split = 'validation')) GROUP BY fold""",
)
def sel_06(t):
    return selection.participant_proof(t.job_scores("validation")).select(*longs("fold"), "participants", "repeated_participants")


@query("sel_07_resume_plan", ctes("thr") + f"SELECT {JL} FROM thr WHERE (fold + seed) % 3 <> 0")
def sel_07(t):
    jobs = stored_thresholds(t).withColumn("job_hash", job_hash("v1"))
    done = jobs.filter("(fold + seed) % 3 = 0")
    return selection.pending_jobs(jobs, done).select(*job_columns())


# -- fixed values: evidence level, expected jobs and folds per published experiment --
EVIDENCE = {
    "formal_baseline_temporal_core_onnx_v1": ("formal_cv", 65, 5),
    "onnx_full_parity_preflight_v1": ("engineering", 7, 1),
}
_EXPERIMENTS = list(EVIDENCE)


@query(
    "sel_08_evidence_profile",
    ctes("thr") + f"""SELECT {JL}, CASE WHEN recipe = 'natural' THEN 'formal_cv' WHEN recipe = 'not_applicable' THEN 'engineering' END AS level,
    CASE WHEN recipe = 'natural' THEN 65 WHEN recipe = 'not_applicable' THEN 7 END::BIGINT AS expected_jobs, CASE WHEN recipe = 'natural' THEN 5 WHEN recipe = 'not_applicable' THEN 1 END::BIGINT AS folds FROM thr""",
)
def sel_08(t):
    """Jobs tagged with an experiment; one without a published profile gets NULL."""
    experiment = F.when(F.col("recipe") == NATURAL, _EXPERIMENTS[0]).when(F.col("recipe") == NOT_APPLICABLE, _EXPERIMENTS[1]).otherwise("other")
    look = lambda i, kind: F.coalesce(*[F.when(F.col("experiment") == k, F.lit(v[i])) for k, v in EVIDENCE.items()]).cast(kind)
    rows = stored_thresholds(t).withColumn("experiment", experiment)
    return rows.select(*job_columns(), look(0, "string").alias("level"), look(1, "long").alias("expected_jobs"), look(2, "long").alias("folds"))


@query("sel_09_result_catalogue")
def sel_09(t):
    """One nested record per job; its arrays are as long as the policy catalogue."""
    scores = test_scores(t)
    window = metrics.classification(scores).select(*JOB, F.struct(*metrics.COUNTS, *rounded(*RATES)).alias("window_metrics"))
    rows = alarms.alarm_metrics(scores, t.events, POLICIES, fold_scope(t))
    policies = rows.groupBy(*JOB).agg(
        F.sort_array(F.collect_list(F.struct("alarm_policy_id", r6("event_sensitivity").alias("sensitivity"), "adl_alarm_episodes"))).alias("policies")
    )
    joined = window.join(policies, list(JOB))
    return joined.select(*job_columns(), F.to_json("window_metrics").alias("window_metrics"), F.to_json("policies").alias("policies"))


@query(
    "sel_10_flat_results",
    ctes("cls", "evm", "tcat_alm") + f"""SELECT {JL}, 'window' AS kind, 'f1' AS metric, round(f1, 6) AS value FROM cls UNION ALL
    SELECT {JL}, 'event', 'detected_events', detected_events::DOUBLE FROM evm UNION ALL
    SELECT {JL}, 'alarm', alarm_policy_id, episodes::DOUBLE FROM tcat_alm""",
)
def sel_10(t):
    scores = test_scores(t)
    row = lambda df, kind, metric, value: df.select(*job_columns(), F.lit(kind).alias("kind"), metric.alias("metric"), value.cast("double").alias("value"))
    window = row(metrics.classification(scores), "window", F.lit("f1"), r6("f1"))
    event = row(metrics.event_metrics(scores, t.events, fold_scope(t)), "event", F.lit("detected_events"), F.col("detected_events"))
    alarm = row(alarms.alarm_metrics(scores, t.events, POLICIES, fold_scope(t)), "alarm", F.col("alarm_policy_id"), F.col("adl_alarm_episodes"))
    return window.unionByName(event).unionByName(alarm)


# -- jobs and folds -------------------------------------------------------------

MODELS = ("impact_rule", "acc_ratio", "gyr_ratio")
_GRID = f"""SELECT fold, windows, model_id, recipe, seed FROM (SELECT fold_id::BIGINT AS fold, count(*) AS windows FROM kept WHERE temporal_label >= 0 AND fold_id >= 0 GROUP BY 1),
  (SELECT 'impact_rule' AS model_id, 'not_applicable' AS recipe, {SEED}::BIGINT AS seed UNION ALL
   SELECT m, r, s::BIGINT FROM (VALUES ('acc_ratio'), ('gyr_ratio')) m(m), (VALUES ('{NATURAL}'), ('{BALANCED}')) r(r), (VALUES ({SEED}), ({SEED + 1})) s(s) WHERE m <> 'acc_ratio' OR s = {SEED})"""
part("jobs", _GRID, "kept")


def grid(t):
    """Folds found in the data with their test windows, expanded to jobs."""
    found = t.kept.filter("temporal_label >= 0 and fold_id >= 0").groupBy(F.col("fold_id").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("windows"))
    return selection.job_grid(found, MODELS, (SEED, SEED + 1), "impact_rule", ("acc_ratio",))


@query("smp_03_job_grid", ctes("jobs") + "SELECT * FROM jobs")
def smp_03(t):
    return grid(t).select("fold", "windows", "model_id", "recipe", "seed")


@query("srt_01_job_order", ctes("jobs") + "SELECT *, row_number() OVER (ORDER BY fold, seed, recipe, CASE model_id WHEN 'impact_rule' THEN 0 WHEN 'acc_ratio' THEN 1 ELSE 2 END) AS place FROM jobs")
def srt_01(t):
    from motionframe.operators.skew import ordered_positions

    order = [F.col(c) for c in ("fold", "seed", "recipe", "model_order")]
    placed = ordered_positions(grid(t).withColumn("one", F.lit(0)), ["one"], order, F.col("fold"), "place")
    return placed.select("fold", "windows", "model_id", "recipe", "seed", (F.col("place") + 1).alias("place")).orderBy("place")


@query("agg_34_jobs_per_group", ctes("jobs") + "SELECT concat('fold-', fold, '/seed-', seed) AS execution_group, count(*) AS jobs FROM jobs GROUP BY ALL")
def agg_34(t):
    name = F.concat(F.lit("fold-"), F.col("fold").cast("string"), F.lit("/seed-"), F.col("seed").cast("string"))
    return grid(t).groupBy(name.alias("execution_group")).agg(F.count(F.lit(1)).alias("jobs"))


@query("smp_04_sticky_folds")
def smp_04(t):
    table = selection.propose_folds(stats_of(t), t.folds, scratch(t, "sticky"))
    return table.select("dataset_id", "participant_id", *longs("fold_id"), "is_new")


# -- custom functions -----------------------------------------------------------


@query("udf_01_custom_scorer", ctes("scored") + "SELECT recording_id, win::BIGINT AS win, round(acc_part / (acc_part + 1.0::DOUBLE), 6) AS score FROM scored")
def udf_01(t):
    scorer = lambda frame: (frame["acc_part"] / (frame["acc_part"] + 1.0)).to_numpy()
    rows = t.scored.select("recording_id", "win", "acc_part")
    return custom.score_with(rows, scorer, ("recording_id", "win")).select("recording_id", *longs("win"), *rounded("score"))


@query(
    "udf_03_custom_alarm_rule",
    ctes("tcat_alm_acc") + f"SELECT {JL}, recording_id, decision::BIGINT AS decision FROM tcat_alm_acc WHERE policy = 'two_of_three_cooldown_10s'",
)
def udf_03(t):
    """Two of three written as a user's rule gives the built-in policy's alarms."""
    import numpy as np

    def rule(alert):
        flags = alert.astype(int)
        recent = np.convolve(flags, np.ones(3, dtype=int))[: len(flags)]
        return (recent >= 2) & (np.arange(len(flags)) >= 2)

    fired = custom.custom_triggers(test_scores(t), rule, 3, "user_rule", 250)
    accepted = alarms.accept(fired, [*JOB, "policy", "recording_id"])
    return accepted.select(*job_columns(), "recording_id", *longs("decision"))


@query("udf_04_start_grid_function", ctes("grid") + "SELECT recording_id, win::BIGINT AS win, start_sample::BIGINT AS start_sample FROM grid")
def udf_04(t):
    function = custom.start_grid_function()
    rows = t.sequences.select("recording_id", "n").alias("q")
    made = rows.lateralJoin(function(F.col("q.n").outer(), F.lit(50), F.lit(25.0), F.lit(0.5)))
    return made.select("recording_id", *longs("win", "start_sample"))


# -- streaming --------------------------------------------------------------------


def sample_stream(t):
    """The stored sample table as a stream of its files, a few per micro-batch, in no order of time."""
    _ = t.samples
    return t.spark.readStream.schema(t.samples.schema).option("maxFilesPerTrigger", 4).parquet(f"{t.root}/samples")


def _window_stream(name, sql, gap=None, cadence=None):
    @query(name, sql)
    def build(t):
        stream = sample_stream(t)
        if gap is not None:
            stream = stream.filter(f"sample_idx % {gap} <> 60")
        table = processors.run_to_table(t.spark, processors.window_scores(stream, cadence), t.root)
        return table.select("recording_id", *longs("win", "end_sample"), *rounded("impact_score"))


_STREAMED = "SELECT i.recording_id, i.win::BIGINT AS win, g.end_sample::BIGINT AS end_sample, round(i.impact_score, 6) AS impact_score FROM impact i JOIN grid g USING (recording_id, win)"
_window_stream("str_01_streaming_windows", ctes("impact") + _STREAMED)
_window_stream(
    "str_02_gap_reset",
    ctes("impact") + _STREAMED + " WHERE NOT EXISTS (SELECT 1 FROM wrows w WHERE w.recording_id = i.recording_id AND w.win = i.win AND w.sample_idx % 97 = 60)",
    gap=97,
)
_window_stream("str_03_inference_cadence", ctes("impact") + _STREAMED + " WHERE g.start_sample % 25 = 0", cadence=1.0)


#: Replays deal rows of any time into any batch, so they may be late by the length of the data.
REPLAY_DELAY = "400 days"


@query(
    "str_04_streaming_alarms",
    ctes("tcat_alm_acc") + f"SELECT {JL}, recording_id, decision::BIGINT AS decision FROM tcat_alm_acc WHERE policy = 'two_of_three_cooldown_10s'",
)
def str_04(t):
    """The test scores of all jobs, streamed out of order through the alarm state, give the batch alarms."""
    keys = [*JOB, "recording_id"]
    rows = test_scores(t).select(*keys, (F.col("end_sample") - 1).cast("long").alias("decision"), (F.col("score") >= F.col("threshold")).alias("alert"))
    stream = processors.replayed(rows.withColumn("time", processors.sample_time(F.col("decision"))), t.root)
    table = processors.run_to_table(t.spark, processors.alarm_stream(stream, 2, 3, 250, keys, REPLAY_DELAY), t.root)
    return table.select(*job_columns(), "recording_id", *longs("decision"))


def replayed_events(t, *columns):
    """Events as a stream out of order, with their event time and other columns."""
    rows = t.read("events").select(F.col("ts").cast("timestamp").alias("time"), *columns)
    return processors.replayed(rows, t.root)


@query(
    "str_05_streaming_resample",
    ctes("resampled") + """SELECT r.user_id, r.k, round(r.rel, 6) AS rel, round(r.value, 6) + 0.0 AS value FROM resampled r JOIN (SELECT user_id, max(rel) AS last FROM series GROUP BY 1) l USING (user_id) WHERE r.rel < l.last""",
)
def str_05(t):
    """A grid point is emitted once the samples on both its sides are known."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    stream = replayed_events(t, "user_id", (micros / 1e6).alias("t"), "value")
    table = processors.run_to_table(t.spark, processors.resample_stream(stream, HOURLY, REPLAY_DELAY), t.root)
    return table.select("user_id", "k", *rounded("rel", "value"))


@query("str_06_repeated_deliveries", "SELECT event_type, count(*) AS events, 0::BIGINT AS late_rows FROM events GROUP BY 1")
def str_06(t):
    """Every third event is delivered twice, in any batch; the guard drops one. No row is late."""
    copies = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    stream = replayed_events(t, "event_id", "event_type", F.explode(copies).alias("copy"))
    once = processors.distinct_within_watermark(stream, "time", "event_id", REPLAY_DELAY)
    table, late = processors.run(t.spark, once.select("event_id", "event_type"), t.root)
    counts = table.filter("event_id is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    return counts.withColumn("late_rows", late.agg(F.sum("late_rows")).scalar())


@query(
    "str_07_hourly_false_alarms",
    """SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour_s, count(*) FILTER (value >= 20.0) AS false_positives, count(*) AS windows, round(count(*) FILTER (value >= 20.0)::DOUBLE / count(*), 6) AS rate FROM events GROUP BY 1""",
)
def str_07(t):
    stream = replayed_events(t, "value")
    table = processors.run_to_table(t.spark, processors.hourly_false_alarms(stream, "time", 20.0, REPLAY_DELAY), t.root)
    hour = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(hour as timestamp_ntz))")
    return table.select(hour.alias("hour_s"), "false_positives", "windows", *rounded("rate"))


# -- nearest neighbours ----------------------------------------------------------

NEIGHBOURS = 11
part("zs", """
SELECT vec_id, j, (x - m) / s AS z, label, f, k FROM vt JOIN (SELECT k, j, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS s FROM vt, range(5) r(k) WHERE f NOT IN (k, (k + 1) % 5) GROUP BY k, j) USING (j)
""", "vt")
part("nn", f"""
SELECT q_id, r_id, label, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, r_id) AS rank FROM (
  SELECT q.vec_id AS q_id, r.vec_id AS r_id, max(r.label) AS label, sqrt(sum((q.z - r.z) * (q.z - r.z))) AS distance
  FROM zs q JOIN zs r USING (j, k) WHERE q.f = k AND r.f NOT IN (k, (k + 1) % 5) GROUP BY q.vec_id, r.vec_id)) WHERE rank <= {NEIGHBOURS}
""", "zs")


def neighbours_of(t):
    """Nearest embeddings; fold by id."""
    from motionframe.operators.neighbours import nearest

    rows = t.read("embeddings").select(
        "vec_id", F.col("embedding").alias("features"), (F.col("label") < 5).cast("int").alias("label"), (F.col("vec_id") % FOLD_COUNT).alias("fold_id"), F.lit(1.0).alias("weight")
    )

    def found(fold):
        held_out = F.col("fold_id") == fold
        train, test = scaled(rows.filter(~held_out & (F.col("fold_id") != (fold + 1) % FOLD_COUNT)), rows.filter(held_out))
        return nearest(test.select(F.col("vec_id").alias("q_id"), "features"), train.select(F.col("vec_id").alias("r_id"), "features", "label"), NEIGHBOURS)

    return every_fold(found).drop("fold")  # a query belongs to one fold


@query("jn_12_nearest_neighbours", ctes("nn") + "SELECT q_id, r_id, rank, round(distance, 6) AS distance FROM nn")
def jn_12(t):
    return neighbours_of(t).select("q_id", "r_id", *longs("rank"), *rounded("distance"))


@query(
    "ml_06_distance_weighted_vote",
    ctes("nn") + """SELECT q_id, round(sum(w * label) / sum(w), 6) AS score FROM (SELECT *, CASE WHEN min(distance) OVER (PARTITION BY q_id) = 0 THEN (distance = 0)::INTEGER::DOUBLE ELSE 1.0::DOUBLE / distance END AS w FROM nn) GROUP BY q_id""",
)
def ml_06(t):
    from motionframe.operators.neighbours import vote

    return vote(neighbours_of(t)).select("q_id", *rounded("score"))
