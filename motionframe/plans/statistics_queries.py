"""Subgroups, participant statistics, bootstrap, sampling and limits."""

from pyspark.sql import functions as F

from motionframe.constants import JOB, NOT_APPLICABLE, SEED
from motionframe.functions.exprs import r6
from motionframe.operators import folds, metrics, sampling, statistics
from motionframe.plans.metric_queries import RATES, _ROUND, fold_scope, job_columns, longs, rounded, stored_thresholds, test_scores
from motionframe.plans.registry import query
from motionframe.plans.sql import COUNTS, JL, J, alarms_sql, ctes, part, rates

#: As in the formal runs.
REPLICATES = 5000

# -- subgroups --------------------------------------------------------------

part("sgrows", "SELECT *, unnest(['dataset_id', 'body_location']) AS subgroup_field, unnest([dataset_id, body_location]) AS subgroup_value FROM test", "test")
part("sgconf", f"SELECT {J}, subgroup_field, subgroup_value, {COUNTS} FROM sgrows GROUP BY {J}, subgroup_field, subgroup_value", "sgrows")
part("sgrank", f"""
SELECT {J}, subgroup_field, subgroup_value, CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(neg_n * (tp - pos_n + pos_n / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(q)) END AS auroc,
  CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(pos_n * (tp::DOUBLE / (tp + fp))) / max(p) END AS auprc FROM (
  SELECT *, sum(pos_n) OVER w AS tp, sum(neg_n) OVER w AS fp, sum(pos_n) OVER (PARTITION BY {J}, subgroup_field, subgroup_value) AS p, sum(neg_n) OVER (PARTITION BY {J}, subgroup_field, subgroup_value) AS q
  FROM (SELECT {J}, subgroup_field, subgroup_value, score, count(*) FILTER (label = 1) AS pos_n, count(*) FILTER (label = 0) AS neg_n FROM sgrows GROUP BY ALL)
  WINDOW w AS (PARTITION BY {J}, subgroup_field, subgroup_value ORDER BY score DESC)) GROUP BY {J}, subgroup_field, subgroup_value
""", "sgrows")


@query(
    "agg_17_subgroup_metrics",
    ctes("sgconf", "sgrank") + f"""SELECT {JL}, subgroup_field, subgroup_value, n, positive, tn, fp, fn, tp, {_ROUND}, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
    FROM (SELECT *, {rates()} FROM sgconf) JOIN sgrank USING ({J}, subgroup_field, subgroup_value)""",
)
def agg_17(t):
    scores = test_scores(t)
    keys = [*JOB, "subgroup_field", "subgroup_value"]
    table = metrics.subgroups(scores).join(metrics.ranking(metrics.subgroup_rows(scores), keys), keys)
    return table.select(*job_columns(), "subgroup_field", "subgroup_value", *metrics.COUNTS, *rounded(*RATES, "auroc", "auprc"))


part("docs", """
SELECT lang, source, quality AS label, (n_chars / (n_chars + 500.0::DOUBLE))::FLOAT::DOUBLE AS score, n_chars / (n_chars + 500.0::DOUBLE) >= 0.5 AS alert FROM labels JOIN documents USING (doc_id)
""")


@query(
    "agg_17_document_subgroups",
    ctes("docs") + f"""SELECT subgroup_field, subgroup_value, n, positive, tn, fp, fn, tp, {_ROUND} FROM (SELECT *, {rates()} FROM (
      SELECT subgroup_field, subgroup_value, {COUNTS} FROM (SELECT * REPLACE (score >= 0.5 AS alert), unnest(['lang', 'source']) AS subgroup_field, unnest([lang, source]) AS subgroup_value FROM docs) GROUP BY ALL))""",
)
def agg_17_documents(t):
    """Labelled documents as scored rows, by language and source."""
    length = F.col("n_chars")
    scores = (
        t.read("labels").select("doc_id", F.col("quality").alias("label"))
        .join(t.read("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        .select("lang", "source", "label", (length / (length + 500.0)).cast("float").cast("double").alias("score"), F.lit(0.5).alias("threshold"))
    )
    table = metrics.subgroups(scores, ("lang", "source"), ())
    return table.select("subgroup_field", "subgroup_value", *metrics.COUNTS, *rounded(*RATES))


# -- participants and bootstrap ---------------------------------------------

PK = f"{J}, dataset_id, participant_id"
from motionframe.constants import POLICIES, REFERENCE_POLICY  # noqa: E402

alarms_sql(
    "pal",
    "test",
    f"""SELECT {J}, q.dataset_id, q.participant_id, q.recording_id, q.is_fall FROM (SELECT DISTINCT {J} FROM test) j JOIN seqs q ON q.fold_id = j.fold AND q.n >= 50""",
    [p for p in POLICIES if p[0] == REFERENCE_POLICY],
    PK,
)
part("pcnt", f"""
SELECT {PK}, tn, fp, fn, tp, fall_events, detected_events, hours AS adl_negative_window_hours, episodes AS adl_alarm_episodes
FROM (SELECT {PK}, {COUNTS} FROM test GROUP BY {PK}) JOIN pal USING ({PK})
""", "test", "pal")


def counts_of(t):
    return statistics.participant_counts(
        test_scores(t), t.events, t.scope.select(F.col("fold_id").alias("fold"), "dataset_id", "participant_id", "recording_id", "is_fall")
    )


@query(
    "agg_18_participant_counts",
    ctes("pcnt") + f"""SELECT {JL}, dataset_id, participant_id, tn, fp, fn, tp, fall_events::BIGINT AS fall_events, detected_events,
    round(adl_negative_window_hours, 6) AS adl_negative_window_hours, adl_alarm_episodes FROM pcnt""",
)
def agg_18(t):
    return counts_of(t).select(
        *job_columns(), "dataset_id", "participant_id", "tn", "fp", "fn", "tp", "fall_events", "detected_events",
        *rounded("adl_negative_window_hours"), "adl_alarm_episodes",
    )


RATE_SQL = """CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS window_sensitivity,
  CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS window_specificity,
  (CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END) / 2 AS balanced_accuracy,
  CASE WHEN fall_events > 0 THEN detected_events::DOUBLE / fall_events ELSE 0 END AS event_sensitivity,
  CASE WHEN adl_negative_window_hours > 0 THEN adl_alarm_episodes / adl_negative_window_hours ELSE 0 END AS adl_alarm_episodes_per_hour"""
_RR = ", ".join(f"round({m}, 6) AS {m}" for m in statistics.RATES)
_SUMS = ", ".join(f"sum({c}) AS {c}" for c in statistics.COUNTS)


@query("agg_19_rates_from_counts", ctes("pcnt") + f"SELECT {JL}, dataset_id, participant_id, {_RR} FROM (SELECT *, {RATE_SQL} FROM pcnt)")
def agg_19(t):
    return statistics.rates(counts_of(t)).select(*job_columns(), "dataset_id", "participant_id", *rounded(*statistics.RATES))


@query(
    "agg_20_matrix_completeness",
    ctes("test") + """SELECT model_id, recipe, count(DISTINCT seed) AS seeds, count(DISTINCT (dataset_id, participant_id)) AS participants,
    count(DISTINCT (seed, dataset_id, participant_id)) AS cells, count(DISTINCT seed) * count(DISTINCT (dataset_id, participant_id)) = count(DISTINCT (seed, dataset_id, participant_id)) AS complete FROM test GROUP BY ALL""",
)
def agg_20(t):
    cells = t.job_scores("test").select("model_id", "recipe", "seed", "dataset_id", "participant_id").distinct()
    return statistics.completeness(cells)


part("pt", f"SELECT model_id, recipe, {RATE_SQL} FROM (SELECT model_id, recipe, {_SUMS} FROM pcnt GROUP BY ALL)", "pcnt")


@query("agg_21_point_estimates", ctes("pt") + f"SELECT model_id, recipe, {_RR} FROM pt")
def agg_21(t):
    return statistics.point_estimates(counts_of(t)).select("model_id", "recipe", *rounded(*statistics.RATES))


def _hash(text):
    return f"('0x' || substr(md5({text}), 1, 8))::UBIGINT::BIGINT"


def bootstrap_sql(prefix, cells):
    """Replicated sums over (unit, side) cells with the same hashed draws."""
    part(f"{prefix}_cells", cells[0], *cells[1:])
    part(f"{prefix}_p", f"SELECT unit, dataset_id, participant_id, row_number() OVER (PARTITION BY unit ORDER BY dataset_id, participant_id) - 1 AS p, count(*) OVER (PARTITION BY unit) AS np FROM (SELECT DISTINCT unit, dataset_id, participant_id FROM {prefix}_cells)", f"{prefix}_cells")
    part(f"{prefix}_s", f"SELECT unit, side, seed, row_number() OVER (PARTITION BY unit, side ORDER BY seed) - 1 AS s, count(*) OVER (PARTITION BY unit, side) AS ns FROM (SELECT DISTINCT unit, side, seed FROM {prefix}_cells)", f"{prefix}_cells")
    part(f"{prefix}_pd", f"""SELECT unit, rep, {_hash(f"concat_ws(':', {SEED}, 'participant', unit, rep, draw)")} % np AS p
      FROM (SELECT DISTINCT unit, np FROM {prefix}_p) u, range({REPLICATES}) r(rep), LATERAL (SELECT unnest(range(0, u.np)) AS draw)""", f"{prefix}_p")
    part(f"{prefix}_sd", f"""SELECT unit, side, rep, {_hash(f"concat_ws(':', {SEED}, 'seed', unit, side, rep, draw)")} % ns AS s
      FROM (SELECT DISTINCT unit, side, ns FROM {prefix}_s) u, range({REPLICATES}) r(rep), LATERAL (SELECT unnest(range(0, u.ns)) AS draw)""", f"{prefix}_s")
    part(f"{prefix}_rep", f"""SELECT unit, side, rep, {', '.join(f'sum({c} * w) AS {c}' for c in statistics.COUNTS)} FROM (
      SELECT c.unit, c.side, d.rep, s.s, {_SUMS} FROM {prefix}_pd d JOIN {prefix}_p p USING (unit, p) JOIN {prefix}_cells c USING (unit, dataset_id, participant_id) JOIN {prefix}_s s USING (unit, side, seed) GROUP BY ALL)
      JOIN (SELECT unit, side, rep, s, count(*) AS w FROM {prefix}_sd GROUP BY ALL) USING (unit, side, rep, s) GROUP BY unit, side, rep""", f"{prefix}_pd", f"{prefix}_sd")
    part(f"{prefix}_val", f"SELECT unit, side, rep, unnest([{', '.join(repr(m) for m in statistics.RATES)}]) AS metric, unnest([{', '.join(statistics.RATES)}]) AS value FROM (SELECT *, {RATE_SQL} FROM {prefix}_rep)", f"{prefix}_rep")


bootstrap_sql("b1", ("SELECT *, concat_ws('|', model_id, recipe) AS unit, '' AS side FROM pcnt", "pcnt"))
part("pairs", """
SELECT *, concat_ws('|', comparison, reference_model_id, reference_recipe, candidate_model_id, candidate_recipe) AS unit FROM (
  SELECT 'model_vs_threshold' AS comparison, 'impact_rule' AS reference_model_id, 'not_applicable' AS reference_recipe, model_id AS candidate_model_id, recipe AS candidate_recipe FROM (SELECT DISTINCT model_id, recipe FROM pcnt) WHERE model_id <> 'impact_rule'
  UNION ALL SELECT 'balanced_minus_natural', model_id, 'natural', model_id, recipe FROM (SELECT DISTINCT model_id, recipe FROM pcnt) WHERE recipe = 'participant_class_balanced')
""", "pcnt")
bootstrap_sql("b2", ("""SELECT p.*, unit, 'a' AS side FROM pcnt p JOIN pairs ON p.model_id = reference_model_id AND p.recipe = reference_recipe
  UNION ALL SELECT p.*, unit, 'b' AS side FROM pcnt p JOIN pairs ON p.model_id = candidate_model_id AND p.recipe = candidate_recipe""", "pcnt", "pairs"))


@query(
    "smp_05_hierarchical_bootstrap",
    ctes("b1_val", "pt") + f"""SELECT model_id, recipe, metric, round(estimate, 6) AS estimate, round(lo, 6) AS ci_lower_95, round(hi, 6) AS ci_upper_95, n AS bootstrap_replicates, participants, seeds
    FROM (SELECT unit, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS n FROM b1_val GROUP BY ALL)
    JOIN (SELECT model_id, recipe, concat_ws('|', model_id, recipe) AS unit, unnest([{', '.join(repr(m) for m in statistics.RATES)}]) AS metric, unnest([{', '.join(statistics.RATES)}]) AS estimate FROM pt) USING (unit, metric)
    JOIN (SELECT model_id, recipe, count(DISTINCT (dataset_id, participant_id)) AS participants, count(DISTINCT seed) AS seeds FROM pcnt GROUP BY ALL) USING (model_id, recipe)""",
)
def smp_05(t):
    table = statistics.bootstrap(stored_counts(t), REPLICATES)
    return table.select("model_id", "recipe", "metric", *rounded("estimate", "ci_lower_95", "ci_upper_95"), "bootstrap_replicates", "participants", "seeds")


def stored_counts(t):
    """Participant counts, written once: both bootstraps read them several times."""
    return t._stored("participant_counts", lambda: counts_of(t))


@query(
    "smp_06_paired_bootstrap",
    ctes("b2_val") + """SELECT comparison, reference_model_id, reference_recipe, candidate_model_id, candidate_recipe, metric, round(quantile_cont(d, 0.5), 6) + 0.0 AS difference_median,
    round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_lower_95, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_upper_95, count(*) AS bootstrap_replicates
    FROM (SELECT unit, rep, metric, sum(CASE WHEN side = 'b' THEN value ELSE -value END) AS d FROM b2_val GROUP BY ALL) JOIN pairs USING (unit) GROUP BY ALL""",
)
def smp_06(t):
    table = statistics.paired_bootstrap(stored_counts(t), REPLICATES, "impact_rule", NOT_APPLICABLE)
    names = ["comparison", "reference_model_id", "reference_recipe", "candidate_model_id", "candidate_recipe", "metric"]
    return table.select(*names, *rounded("difference_median", "ci_lower_95", "ci_upper_95"), "bootstrap_replicates")


@query(
    "jn_11_common_participants",
    ctes("pcnt", "pairs") + """SELECT comparison, reference_model_id, reference_recipe, candidate_model_id, candidate_recipe, count(*) AS common_participants FROM pairs
    JOIN (SELECT DISTINCT model_id, recipe, dataset_id, participant_id FROM pcnt) a ON a.model_id = reference_model_id AND a.recipe = reference_recipe
    JOIN (SELECT DISTINCT model_id, recipe, dataset_id, participant_id FROM pcnt) b ON b.model_id = candidate_model_id AND b.recipe = candidate_recipe AND a.dataset_id = b.dataset_id AND a.participant_id = b.participant_id GROUP BY ALL""",
)
def jn_11(t):
    cells = t.job_scores("test").select("model_id", "recipe", "dataset_id", "participant_id").distinct()
    pairs = statistics.comparison_pairs(cells.select("model_id", "recipe").distinct(), "impact_rule", NOT_APPLICABLE)
    people = ["dataset_id", "participant_id"]
    side = lambda name: cells.select(F.col("model_id").alias(f"{name}_model_id"), F.col("recipe").alias(f"{name}_recipe"), *people)
    left = pairs.join(side("reference"), ["reference_model_id", "reference_recipe"])
    both = left.join(side("candidate"), ["candidate_model_id", "candidate_recipe", *people])
    names = ["comparison", "reference_model_id", "reference_recipe", "candidate_model_id", "candidate_recipe"]
    return both.groupBy(*names).agg(F.count(F.lit(1)).alias("common_participants"))


@query(
    "agg_22_fold_mean_and_spread",
    ctes("cls") + f"""SELECT model_id, recipe, seed::BIGINT AS seed, metric, round(avg(value), 6) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(value) AS folds
    FROM (SELECT model_id, recipe, seed, unnest([{', '.join(repr(m) for m in RATES)}]) AS metric, unnest([{', '.join(RATES)}]) AS value FROM cls) GROUP BY ALL""",
)
def agg_22(t):
    table = metrics.classification(test_scores(t)).select(*JOB, *RATES)
    spread = statistics.fold_spread(table, ("model_id", "recipe", "seed"), RATES)
    return spread.select("model_id", "recipe", *longs("seed"), "metric", *rounded("mean", "std"), "folds")


# -- sampling ---------------------------------------------------------------

part("train", """
SELECT r.k AS fold, dataset_id, participant_id, recording_id, win, temporal_label AS label FROM kept, range(5) r(k)
WHERE temporal_label >= 0 AND fold_id <> r.k AND fold_id <> (r.k + 1) % 5
""", "kept")
part("quota", f"""
SELECT *, target // groups + CASE WHEN rk <= target % groups THEN 1 ELSE 0 END AS quota FROM (
  SELECT *, CASE WHEN label = 0 THEN n // 2 ELSE n - n // 2 END AS target,
    row_number() OVER (PARTITION BY fold, label ORDER BY {_hash(f"concat_ws(':', {SEED}, 'quota', label, dataset_id, participant_id)")}, dataset_id, participant_id) AS rk
  FROM (SELECT *, count(*) OVER (PARTITION BY fold, label) AS groups, (sum(candidates) OVER (PARTITION BY fold))::BIGINT AS n
    FROM (SELECT fold, label, dataset_id, participant_id, count(*) AS candidates FROM train GROUP BY ALL)))
""", "train")
part("bal", f"""
SELECT d.fold, d.label, d.dataset_id, d.participant_id, recording_id, win FROM (
  SELECT *, {_hash(f"concat_ws(':', {SEED}, 'pick', fold, label, dataset_id, participant_id, draw)")} % candidates AS idx FROM (SELECT *, unnest(range(0, quota)) AS draw FROM quota)) d
JOIN (SELECT *, row_number() OVER (PARTITION BY fold, label, dataset_id, participant_id ORDER BY win, recording_id) - 1 AS idx FROM (SELECT DISTINCT fold, label, dataset_id, participant_id, recording_id, win FROM train)) c
  USING (fold, label, dataset_id, participant_id, idx)
""", "quota", "train")
_AUDIT = """SELECT fold, count(*) AS windows, count(DISTINCT (recording_id, win)) AS unique_windows, count(*) FILTER (label = 1) AS positive_windows,
  count(*) FILTER (label = 0) AS negative_windows, count(DISTINCT (label, dataset_id, participant_id)) AS participant_class_groups FROM {} GROUP BY fold"""


def training_rows(t):
    roles = folds.assign_roles(t.kept.filter("temporal_label >= 0")).filter("role = 'train'")
    return roles.select(F.col("fold").cast("long").alias("fold"), "dataset_id", "participant_id", "recording_id", "win", F.col("temporal_label").alias("label"))


@query("smp_01_natural_recipe", ctes("train") + _AUDIT.format("train"))
def smp_01(t):
    return sampling.recipe_audit(training_rows(t), ["fold"])


@query(
    "smp_02_balanced_recipe",
    ctes("bal") + "SELECT fold, label::BIGINT AS label, dataset_id, participant_id, recording_id, win::BIGINT AS win, count(*) AS draws FROM bal GROUP BY ALL",
)
def smp_02(t):
    sample = sampling.balanced_sample(training_rows(t), ["fold"])
    keys = ["fold", F.col("label").cast("long").alias("label"), "dataset_id", "participant_id", "recording_id", F.col("win").cast("long").alias("win")]
    return sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"))


@query("agg_33_recipe_audit", ctes("bal") + _AUDIT.format("bal"))
def agg_33(t):
    return sampling.recipe_audit(sampling.balanced_sample(training_rows(t), ["fold"]), ["fold"])


LIMIT = 13
part("lroles", """
SELECT DISTINCT r.k AS fold, CASE WHEN fold_id = r.k THEN 'test' WHEN fold_id = (r.k + 1) % 5 THEN 'validation' ELSE 'train' END AS role, recording_id, is_fall
FROM kept, range(5) r(k) WHERE temporal_label >= 0
""", "kept")
part("lim", f"""
SELECT fold, role, recording_id, is_fall FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, role, first ORDER BY h, recording_id) AS fill, count(*) FILTER (first) OVER (PARTITION BY fold, role) AS took FROM (
    SELECT *, rk <= {LIMIT} // classes + CASE WHEN is_fall = lowest AND {LIMIT} % classes > 0 THEN 1 ELSE 0 END AS first FROM (
      SELECT l.*, c.classes, c.lowest, {_hash(f"concat_ws(':', {SEED}, 'limit', recording_id)")} AS h,
        row_number() OVER (PARTITION BY fold, role, is_fall ORDER BY {_hash(f"concat_ws(':', {SEED}, 'limit', recording_id)")}, recording_id) AS rk
      FROM lroles l JOIN (SELECT fold, role, count(DISTINCT is_fall) AS classes, min(is_fall) AS lowest FROM lroles GROUP BY ALL) c USING (fold, role)))
) WHERE first OR fill <= {LIMIT} - took
""", "lroles")


def limited_sequences(t):
    roles = folds.assign_roles(t.kept.filter("temporal_label >= 0").select("recording_id", "is_fall", "fold_id").distinct())
    return sampling.limit_sequences(roles, ["fold", "role"], LIMIT)


@query("lim_01_sequence_cap", ctes("lim") + "SELECT fold, role, recording_id, is_fall FROM lim")
def lim_01(t):
    return limited_sequences(t).select(*longs("fold"), "role", "recording_id", "is_fall")


PER_SEQUENCE = 5
_SPACED = f"""SELECT *, count(*) OVER (PARTITION BY recording_id) AS size FROM kept WHERE temporal_label >= 0"""
part("sized", _SPACED, "kept")
part("spaced", f"""
SELECT s.* FROM sized s WHERE size <= {PER_SEQUENCE} OR EXISTS (SELECT 1 FROM range({PER_SEQUENCE}) j(j) WHERE
  s.pos = CASE WHEN j.j = {PER_SEQUENCE - 1} THEN s.size - 1 ELSE floor(j.j * ((s.size - 1)::DOUBLE / {PER_SEQUENCE - 1}.0::DOUBLE)) END)
""", "sized")


def spaced_windows(t):
    rows = t.kept.filter("temporal_label >= 0")
    return metrics.evenly_spaced(metrics.survivors_with_size(rows), PER_SEQUENCE)


@query("wf_08_evenly_spaced_windows", ctes("spaced") + "SELECT recording_id, win::BIGINT AS win, pos::BIGINT AS pos, size FROM spaced")
def wf_08(t):
    return spaced_windows(t).select("recording_id", *longs("win", "pos"), "size")


@query("lim_02_both_caps", ctes("lim", "spaced") + "SELECT fold, role, recording_id, win::BIGINT AS win FROM lim JOIN spaced USING (recording_id)")
def lim_02(t):
    return spaced_windows(t).join(limited_sequences(t).select("fold", "role", "recording_id"), "recording_id").select(
        *longs("fold"), "role", "recording_id", *longs("win")
    )


@query(
    "jn_08_windows_of_selected_sequences",
    ctes("lim", "kept") + "SELECT recording_id, win::BIGINT AS win FROM kept WHERE temporal_label >= 0 AND recording_id IN (SELECT recording_id FROM lim WHERE role = 'test')",
)
def jn_08(t):
    chosen = limited_sequences(t).filter("role = 'test'").select("recording_id").distinct()
    return t.kept.filter("temporal_label >= 0").join(chosen, "recording_id", "left_semi").select("recording_id", *longs("win"))
