"""Thresholds, window metrics, event metrics and alarm policies."""

from pyspark.sql import functions as F

from motionframe.constants import JOB, POLICIES, REFERENCE_POLICY, SHORT_POLICIES
from motionframe.functions.exprs import r6
from motionframe.operators import alarms, metrics
from motionframe.plans.registry import query
from motionframe.plans.sql import FOLD_SCOPE, JL, J, alarms_sql, ctes, part

ALL_POLICIES = POLICIES + SHORT_POLICIES
alarms_sql("alm", "test", FOLD_SCOPE, ALL_POLICIES)
part("val", "SELECT * FROM withthr WHERE split = 'validation'", "withthr")
alarms_sql("valm", "val", f"SELECT {J}, recording_id, any_value(is_fall) AS is_fall FROM val GROUP BY {J}, recording_id", POLICIES)
part("tcat", "SELECT * FROM test", "test")
alarms_sql("tcat_alm", "tcat", FOLD_SCOPE.replace("FROM test", "FROM tcat"), POLICIES)


def job_columns():
    return ["model_id", "recipe", F.col("fold").cast("long").alias("fold"), F.col("seed").cast("long").alias("seed")]


def longs(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names):
    return [r6(n).alias(n) for n in names]


def thresholds(t):
    """Chosen on validation scores only."""
    return metrics.best_threshold(t.job_scores("validation"))


def stored_thresholds(t):
    """The per-job result record; written once, like the score shards' metadata."""
    return t._stored("job_thresholds", lambda: thresholds(t).repartition(1))


def test_scores(t):
    return metrics.apply_threshold(t.job_scores("test"), stored_thresholds(t))


def validation_scores(t):
    return metrics.apply_threshold(t.job_scores("validation"), stored_thresholds(t))


def fold_scope(t):
    return t.scope.select(F.col("fold_id").alias("fold"), "recording_id", "is_fall")


# -- window metrics ---------------------------------------------------------

RATES = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "precision", "f1", "mcc")
_ROUND = ", ".join(f'round("{m}", 6) + 0.0 AS "{m}"' for m in RATES)


@query(
    "minimum_slice",
    ctes("cls", "rnk", "thr") + f"""SELECT {JL}, threshold, n, positive, tn, fp, fn, tp, {_ROUND.replace('"mcc"', 'cls.mcc', 1).replace('"balanced_accuracy"', 'cls.balanced_accuracy', 1)},
    round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM cls JOIN rnk USING ({J}) JOIN thr USING ({J}) WHERE model_id = 'impact_rule'""",
)
def minimum_slice(t):
    """How well the impact rule detects events of participants it has not seen."""
    rule = F.col("model_id") == "impact_rule"
    limits = metrics.best_threshold(t.job_scores("validation").filter(rule))
    scored = metrics.apply_threshold(t.job_scores("test").filter(rule), limits)
    table = metrics.classification(scored, (*JOB, "threshold")).join(metrics.ranking(scored), list(JOB))
    return table.select(*job_columns(), "threshold", *metrics.COUNTS, *rounded(*RATES, "auroc", "auprc"))


@query("prj_03_binary_prediction", ctes("test") + f"SELECT {JL}, recording_id, win::BIGINT AS win, alert FROM test")
def prj_03(t):
    return test_scores(t).select(*job_columns(), "recording_id", *longs("win"), (F.col("score") >= F.col("threshold")).alias("alert"))


@query("agg_01_confusion_counts", ctes("conf") + f"SELECT {JL}, n, positive, tn, fp, fn, tp FROM conf")
def agg_01(t):
    return test_scores(t).groupBy(*JOB).agg(*metrics.confusion_counts()).select(*job_columns(), *metrics.COUNTS)


def _rate_query(number, metric):
    @query(f"agg_{number:02d}_{metric}", ctes("cls") + f'SELECT {JL}, round("{metric}", 6) + 0.0 AS "{metric}" FROM cls')
    def build(t):
        return metrics.classification(test_scores(t)).select(*job_columns(), *rounded(metric))


for _number, _metric in enumerate(RATES, start=2):
    _rate_query(_number, _metric)


def _rank_query(number, metric):
    @query(f"agg_{number:02d}_{metric}", ctes("rnk") + f"SELECT {JL}, round({metric}, 6) AS {metric} FROM rnk")
    def build(t):
        return metrics.ranking(t.job_scores("test")).select(*job_columns(), *rounded(metric))


_rank_query(9, "auroc")
_rank_query(10, "auprc")


@query(
    "agg_11_false_positives_per_hour",
    ctes("test") + f"""SELECT {JL}, f AS false_positive_windows, round(h, 6) AS negative_hours,
    round(CASE WHEN h > 0 THEN f / h ELSE 0 END, 6) AS false_positive_windows_per_hour
    FROM (SELECT {J}, count(*) FILTER (label = 0 AND alert) AS f, count(*) FILTER (label = 0) * 0.5::DOUBLE / 3600.0::DOUBLE AS h FROM test GROUP BY ALL)""",
)
def agg_11(t):
    table = metrics.false_positives_per_hour(test_scores(t))
    return table.select(*job_columns(), "false_positive_windows", *rounded("negative_hours", "false_positive_windows_per_hour"))


# -- thresholds -------------------------------------------------------------


@query(
    "wf_01_best_threshold",
    ctes("thr") + f"SELECT {JL}, threshold, round(balanced_accuracy, 6) AS balanced_accuracy, round(mcc, 6) + 0.0 AS mcc FROM thr",
)
def wf_01(t):
    return thresholds(t).select(*job_columns(), "threshold", *rounded("balanced_accuracy", "mcc"))


@query(
    "sel_01_validation_threshold_on_test",
    ctes("cls", "thr") + f"""SELECT {JL}, threshold, round(thr.balanced_accuracy, 6) AS validation_balanced_accuracy,
    round(cls.balanced_accuracy, 6) AS test_balanced_accuracy FROM thr JOIN cls USING ({J})""",
)
def sel_01(t):
    limits = thresholds(t)
    scored = metrics.apply_threshold(t.job_scores("test"), limits)
    table = metrics.classification(scored).select(*JOB, r6("balanced_accuracy").alias("test_balanced_accuracy"))
    return limits.join(table, list(JOB)).select(
        *job_columns(), "threshold", r6("balanced_accuracy").alias("validation_balanced_accuracy"), "test_balanced_accuracy"
    )


# -- events -----------------------------------------------------------------

EVENT_COUNTS = ("fall_events", "detected_events")


def event_table(t):
    return metrics.event_metrics(test_scores(t), t.events, fold_scope(t))


@query(
    "agg_12_event_sensitivity",
    ctes("evm") + f"""SELECT {JL}, fall_events::BIGINT AS fall_events, detected_events, uncovered::BIGINT AS events_without_positive_decision_window,
    round(CASE WHEN fall_events > 0 THEN detected_events::DOUBLE / fall_events ELSE 0 END, 6) AS event_sensitivity FROM evm""",
)
def agg_12(t):
    return event_table(t).select(
        *job_columns(), "fall_events", "detected_events", "events_without_positive_decision_window", *rounded("event_sensitivity")
    )


@query(
    "agg_13_event_outcomes",
    ctes("evm_cov") + f"""SELECT {JL}, recording_id, code, onset::BIGINT AS onset, first_alert::BIGINT AS first_alert,
    round((first_alert - onset) / 25.0::DOUBLE, 6) AS onset_latency_s, round((first_alert - impact) / 25.0::DOUBLE, 6) + 0.0 AS impact_offset_s FROM evm_cov""",
)
def agg_13(t):
    rows = metrics.event_outcomes(test_scores(t), t.events)
    return rows.select(*job_columns(), "recording_id", "code", *longs("onset", "first_alert"), *rounded("onset_latency_s", "impact_offset_s"))


@query(
    "agg_14_latency_percentiles",
    ctes("evm") + f"""SELECT {JL}, round(lat50, 6) AS onset_latency_median_s, round(lat95, 6) AS onset_latency_p95_s, round(imp50, 6) + 0.0 AS impact_offset_median_s FROM evm""",
)
def agg_14(t):
    return event_table(t).select(*job_columns(), *rounded("onset_latency_median_s", "onset_latency_p95_s", "impact_offset_median_s"))


@query(
    "agg_15_adl_recordings",
    ctes("evm") + f"""SELECT {JL}, adl_recordings, adl_fp_rec AS adl_false_positive_recordings,
    round(CASE WHEN adl_recordings > 0 THEN adl_fp_rec::DOUBLE / adl_recordings ELSE 0 END, 6) AS adl_recording_false_positive_rate FROM evm""",
)
def agg_15(t):
    return event_table(t).select(
        *job_columns(), "adl_recordings", "adl_false_positive_recordings", *rounded("adl_recording_false_positive_rate")
    )


# -- alarm policies ---------------------------------------------------------

_ALARM = f"""SELECT {JL}, alarm_policy_id, fall_events::BIGINT AS fall_events, detected_events, uncovered::BIGINT AS events_without_positive_decision_window,
  round(event_sensitivity, 6) AS event_sensitivity, adl_recordings, adl_fp_rec AS adl_false_positive_recordings, round(hours, 6) AS adl_negative_window_hours,
  episodes AS adl_alarm_episodes, round(episodes_per_hour, 6) AS adl_alarm_episodes_per_hour, round(lat50, 6) AS onset_latency_median_s,
  round(lat95, 6) AS onset_latency_p95_s, round(imp50, 6) + 0.0 AS impact_offset_median_s FROM """


def alarm_columns():
    return [
        *job_columns(), "alarm_policy_id", "fall_events", "detected_events", "events_without_positive_decision_window",
        *rounded("event_sensitivity"), "adl_recordings", "adl_false_positive_recordings", *rounded("adl_negative_window_hours"),
        "adl_alarm_episodes",
        *rounded("adl_alarm_episodes_per_hour", "onset_latency_median_s", "onset_latency_p95_s", "impact_offset_median_s"),
    ]


@query("agg_16_alarm_policy_metrics", ctes("alm") + _ALARM + "alm")
def agg_16(t):
    return alarms.alarm_metrics(test_scores(t), t.events, ALL_POLICIES, fold_scope(t)).select(*alarm_columns())


@query(
    "wf_02_policy_triggers",
    ctes("alm_trig") + f"SELECT {JL}, policy, recording_id, decision::BIGINT AS decision FROM alm_trig",
)
def wf_02(t):
    return alarms.triggers(test_scores(t), ALL_POLICIES).select(*job_columns(), "policy", "recording_id", *longs("decision"))


@query(
    "wf_03_accepted_alarms",
    ctes("alm_acc") + f"SELECT {JL}, policy, recording_id, decision::BIGINT AS decision FROM alm_acc",
)
def wf_03(t):
    return alarms.alarms(test_scores(t), ALL_POLICIES).select(*job_columns(), "policy", "recording_id", *longs("decision"))


@query(
    "wf_04_first_alarm_in_event",
    ctes("alm_al") + f"""SELECT {JL}, policy, recording_id, e.code, min(decision)::BIGINT AS first_alarm FROM alm_al a JOIN ev e USING (recording_id)
    WHERE decision >= e.onset AND decision < e.stop GROUP BY {J}, policy, recording_id, e.onset, e.code""",
)
def wf_04(t):
    found = metrics.events_at(alarms.alarms(test_scores(t), ALL_POLICIES), t.events).filter(F.size("hits") > 0)
    first = found.withColumn("e", F.explode("hits")).groupBy(*JOB, "policy", "recording_id", "e").agg(F.min("decision").alias("first_alarm"))
    return first.select(*job_columns(), "policy", "recording_id", "e.code", *longs("first_alarm"))


PARETO_SQL = f"""SELECT {J}, alarm_policy_id FROM valm a WHERE NOT EXISTS (
  SELECT 1 FROM valm b WHERE b.model_id = a.model_id AND b.recipe = a.recipe AND b.fold = a.fold AND b.seed = a.seed
    AND b.event_sensitivity >= a.event_sensitivity AND b.episodes_per_hour <= a.episodes_per_hour
    AND coalesce(b.lat95, 'infinity'::DOUBLE) <= coalesce(a.lat95, 'infinity'::DOUBLE)
    AND (b.event_sensitivity > a.event_sensitivity OR b.episodes_per_hour < a.episodes_per_hour
      OR coalesce(b.lat95, 'infinity'::DOUBLE) < coalesce(a.lat95, 'infinity'::DOUBLE)))"""
part("par", PARETO_SQL, "valm")


def validation_alarms(t):
    return alarms.alarm_metrics(validation_scores(t), t.events, POLICIES)


@query("sel_02_pareto_policies", ctes("par") + f"SELECT {JL}, alarm_policy_id FROM par")
def sel_02(t):
    return alarms.pareto(validation_alarms(t)).select(*job_columns(), "alarm_policy_id")


@query(
    "sel_03_flagged_test_alarms",
    ctes("tcat_alm", "par") + f"""SELECT {JL}, alarm_policy_id, round(event_sensitivity, 6) AS event_sensitivity, episodes AS adl_alarm_episodes,
    EXISTS (SELECT 1 FROM par p WHERE p.model_id = a.model_id AND p.recipe = a.recipe AND p.fold = a.fold AND p.seed = a.seed AND p.alarm_policy_id = a.alarm_policy_id) AS validation_pareto,
    alarm_policy_id = '{REFERENCE_POLICY}' AS reference_policy FROM tcat_alm a""",
)
def sel_03(t):
    front = alarms.pareto(validation_alarms(t)).withColumn("validation_pareto", F.lit(True))
    rows = alarms.alarm_metrics(test_scores(t), t.events, POLICIES, fold_scope(t))
    return rows.join(front, [*JOB, "alarm_policy_id"], "left").select(
        *job_columns(), "alarm_policy_id", *rounded("event_sensitivity"), "adl_alarm_episodes",
        F.coalesce("validation_pareto", F.lit(False)).alias("validation_pareto"),
        (F.col("alarm_policy_id") == REFERENCE_POLICY).alias("reference_policy"),
    )
