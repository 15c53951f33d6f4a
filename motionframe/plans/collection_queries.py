"""Sources, sinks, joins, set operations, filters and scalar functions."""

from pyspark.sql import functions as F

from motionframe.constants import CHANNELS, FOLD_COUNT, JOB, POLICIES, REFERENCE_POLICY, SEED, SHORT_POLICIES, TOP_FRACTION
from motionframe.functions import exprs
from motionframe.functions.exprs import r6
from motionframe.operators import folds, labels, metrics, quality, windows
from motionframe.plans.metric_queries import job_columns, longs, rounded, stored_thresholds, test_scores
from motionframe.plans.quality_queries import faulty_folds, observed_manifest
from motionframe.plans import statistics_queries  # noqa: F401  (defines shared SQL parts)
from motionframe.plans.registry import query
from motionframe.plans.sql import JL, J, ctes, part
from motionframe.sources import readers, writers


def scratch(t, name):
    """A folder of the shared store for a sink's round trip."""
    return f"{t.root}/sinks/{name}"


# -- sources ----------------------------------------------------------------


@query(
    "src_01_collection_scan",
    ctes("seqs", "manifest") + """SELECT dataset_id, sum(n)::BIGINT AS samples, count(*) AS sequences, dataset_id IN (SELECT dataset_id FROM manifest) AS declared FROM seqs GROUP BY dataset_id""",
)
def src_01(t):
    """Scan of the sample table; the datasets found must be those of the manifest."""
    declared = observed_manifest(t).select("dataset_id", F.lit(True).alias("declared"))
    per_sequence = t.samples.groupBy("recording_id").agg(F.count(F.lit(1)).alias("samples"))
    found = per_sequence.join(t.sequences.select("recording_id", "dataset_id"), "recording_id").groupBy("dataset_id").agg(
        F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("sequences")
    )
    return found.join(declared, "dataset_id", "full").select(
        "dataset_id", "samples", "sequences", F.coalesce("declared", F.lit(False)).alias("declared")
    )


@query(
    "src_02_recording_scan",
    ctes("ann", "ev", "coll") + """SELECT dataset_id, recording_id, body_location, sample_start::BIGINT AS sample_start, sample_stop::BIGINT AS sample_stop, coalesce(a, 0) AS annotations, coalesce(e, 0) AS events
    FROM coll LEFT JOIN (SELECT recording_id, count(*) AS a FROM ann GROUP BY 1) USING (recording_id) LEFT JOIN (SELECT recording_id, count(*) AS e FROM ev GROUP BY 1) USING (recording_id)""",
)
def src_02(t):
    per = lambda df, name: df.groupBy("recording_id").agg(F.count(F.lit(1)).alias(name))
    joined = t.collection.join(per(t.annotations, "annotations"), "recording_id", "left").join(per(t.events, "events"), "recording_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "dataset_id", "recording_id", "body_location", "sample_start", "sample_stop",
        F.coalesce("annotations", zero).alias("annotations"), F.coalesce("events", zero).alias("events"),
    )


@query("src_03_split_csv", ctes("parts") + "SELECT 'v1' AS split_version, dataset_id, participant_id, fold_id::BIGINT AS fold_id FROM parts WHERE fold_id >= 0")
def src_03(t):
    path = scratch(t, "folds_csv")
    writers.write_fold_proposal(t.folds, "v1", path)
    return readers.read_folds(t.spark, path).select("split_version", "dataset_id", "participant_id", *longs("fold_id"))


@query(
    "src_04_snapshot_manifest",
    ctes("manifest") + "SELECT 'snapshot-1' AS snapshot_id, 'base' AS role, dataset_id, path AS filename, sha256, size_bytes, sequences, rows, annotations FROM manifest",
)
def src_04(t):
    """Manifest written as one JSON document and read back one row per file."""
    path = scratch(t, "snapshot_json")
    item = observed_manifest(t).select(F.struct("dataset_id", F.col("path").alias("filename"), "sha256", "size_bytes", "sequences", "rows", "annotations").alias("f"))
    document = item.groupBy(F.lit("snapshot-1").alias("snapshot_id"), F.lit("base").alias("role")).agg(F.collect_list("f").alias("files"))
    writers.write_manifest(document.coalesce(1), path)
    rows = readers.read_manifest(t.spark, path)
    return rows.select("snapshot_id", "role", "dataset_id", "filename", "sha256", "size_bytes", "sequences", "rows", "annotations")


@query(
    "src_05_typed_results",
    ctes("cls") + """SELECT model_id, recipe, fold::VARCHAR AS fold, seed::VARCHAR AS seed, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM cls""",
)
def src_05(t):
    path = scratch(t, "results_csv")
    table = metrics.classification(test_scores(t)).select(*JOB, *rounded("sensitivity", "specificity"))
    writers.write_metric_table([table], path)
    return readers.read_results(t.spark, path, JOB, ("sensitivity", "specificity"))


@query("src_06_score_shards", ctes("scores") + f"SELECT {JL}, split, recording_id, win::BIGINT AS win, label::BIGINT AS label, score FROM scores WHERE model_id = 'acc_ratio' AND fold = 2")
def src_06(t):
    """Shards written per job and read with partition pruning on the job columns."""
    path = scratch(t, "score_shards")
    columns = ("split", "recording_id", "win", "label", "score")
    writers.write_scores(t.job_scores().select(*JOB, *columns), path)
    rows = readers.read_scores(t.spark, path, model_id="acc_ratio", fold=2)
    return rows.select(*job_columns(), "split", "recording_id", *longs("win", "label"), "score")


def _policy_values():
    return ", ".join(f"('{i}', {r}, {m}, {str(c).lower()}, {s})" for i, r, m, c, s in POLICIES + SHORT_POLICIES)


@query(
    "src_07_policy_catalogue",
    ctes("thr") + f""", pol(id, r, m, c, s) AS (VALUES {_policy_values()})
    SELECT {JL}, id, unnest(list_filter([CASE WHEN r <= 0 THEN 'required_not_positive' END, CASE WHEN m < r THEN 'lookback_below_required' END, CASE WHEN c AND r <> m THEN 'consecutive_not_equal' END], lambda x: x IS NOT NULL)) AS rule_id
    FROM (SELECT t.*, id, r - (CASE WHEN fold = 1 AND id LIKE 'one%' THEN 1 ELSE 0 END) AS r, m - (CASE WHEN fold = 2 AND id LIKE 'three%' THEN 3 ELSE 0 END) AS m, c OR (fold = 3 AND id LIKE 'two%') AS c FROM thr t, pol)""",
)
def src_07(t):
    """The policy catalogue attached to every job, with faults in three folds."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("id"), F.lit(r).alias("required_positive_windows"), F.lit(m).alias("lookback_windows"), F.lit(c).alias("consecutive"), F.lit(s).alias("cooldown_seconds"))
            for i, r, m, c, s in POLICIES + SHORT_POLICIES
        ]
    )
    rows = stored_thresholds(t).select(*JOB, F.explode(entries).alias("p")).select(*JOB, "p.*")
    bad = lambda fold, prefix: (F.col("fold") == fold) & F.col("id").startswith(prefix)
    faulty = rows.withColumns(
        {
            "required_positive_windows": F.col("required_positive_windows") - bad(1, "one").cast("int"),
            "lookback_windows": F.col("lookback_windows") - bad(2, "three").cast("int") * 3,
            "consecutive": F.col("consecutive") | bad(3, "two"),
        }
    )
    key = F.concat_ws("|", "model_id", "recipe", F.col("fold").cast("string"), F.col("seed").cast("string"), "id")
    named = faulty.withColumn("name", F.col("id")).withColumn("id", key)
    broken = readers.invalid_policies(named, REFERENCE_POLICY).filter("rule_id <> 'reference_missing'")
    return named.join(broken, "id").select(*job_columns(), F.col("name").alias("id"), "rule_id")


@query("src_08_file_inventory")
def src_08(t):
    return readers.file_inventory(t.spark, t.sf_dir, "*.parquet")


@query("dq_20_directory_against_manifest")
def dq_20(t):
    """Inventory against a manifest in which ``part`` is unlisted and ``orders`` altered."""
    seen = readers.file_inventory(t.spark, t.sf_dir, "*.parquet")
    altered = F.when(F.col("file_name") == "orders.parquet", F.lit("0" * 64)).otherwise(F.col("sha256"))
    listed = seen.filter("file_name <> 'part.parquet'").withColumn("sha256", altered)
    return quality.count_mismatches(listed, seen, ["file_name"], ["size_bytes", "sha256"])


@query("src_09_collection_union", ctes("seqs") + "SELECT recording_id, dataset_id, participant_id, fold_id::BIGINT AS fold_id FROM seqs")
def src_09(t):
    sequences = t.sequences.drop("fold_id")
    team = sequences.filter("suppkey % 11 = 0")
    base = sequences.filter("suppkey % 11 <> 0")
    rows = readers.collection_union(base, t.folds, team)
    return rows.select("recording_id", "dataset_id", "participant_id", *longs("fold_id"))


# -- sinks: each is written, read back and compared --------------------------


@query(
    "snk_01_window_store",
    ctes("scored") + "SELECT recording_id, win::BIGINT AS win, fold_id::BIGINT AS fold_id, temporal_label::BIGINT AS temporal_label, pos::BIGINT AS pos, round(impact_score, 6) AS impact_score FROM scored",
)
def snk_01(t):
    path = scratch(t, "windows")
    writers.write_windows(t.build_scored(), path)
    rows = t.spark.read.parquet(path)
    return rows.select("recording_id", *longs("win", "fold_id", "temporal_label", "pos"), r6("impact_score").alias("impact_score"))


@query(
    "snk_03_metric_csv",
    ctes("cls", "evm") + f"""SELECT model_id, recipe, fold::VARCHAR AS fold, seed::VARCHAR AS seed, tp::VARCHAR AS tp, NULL::VARCHAR AS detected_events FROM cls
    UNION ALL SELECT model_id, recipe, fold::VARCHAR, seed::VARCHAR, NULL, detected_events::VARCHAR FROM evm""",
)
def snk_03(t):
    path = scratch(t, "metrics_csv")
    scores = test_scores(t)
    window = metrics.classification(scores).select(*JOB, "tp")
    outcome = metrics.event_outcomes(scores, t.events).groupBy(*JOB).agg(F.count("first_alert").alias("detected_events"))
    event = stored_thresholds(t).select(*JOB).join(outcome, list(JOB), "left").select(*JOB, F.coalesce("detected_events", F.lit(0)).alias("detected_events"))
    writers.write_metric_table([window, event], path)
    return t.spark.read.csv(path, header=True, schema="model_id string, recipe string, fold string, seed string, tp string, detected_events string")


@query("snk_04_statistical_outputs", ctes("pcnt") + "SELECT count(*) AS methods, count(*) AS complete_methods, 'PASS' AS status FROM (SELECT DISTINCT model_id, recipe FROM pcnt)")
def snk_04(t):
    from motionframe.operators import statistics
    from motionframe.plans.statistics_queries import REPLICATES, stored_counts

    counts = stored_counts(t)
    return writers.write_statistics(
        counts,
        statistics.bootstrap(counts, REPLICATES),
        statistics.paired_bootstrap(counts, REPLICATES, "impact_rule", "not_applicable"),
        scratch(t, "statistics"),
    )


@query("snk_05_event_log", ctes("thr") + f"SELECT 'job_finished' AS event, {JL}, threshold FROM thr")
def snk_05(t):
    """One log line per job; appended, so repeated runs add lines."""
    path = scratch(t, "run_events")
    writers.append_events(stored_thresholds(t).select(F.lit("job_finished").alias("event"), *JOB, "threshold"), path)
    log = t.spark.read.schema("event string, model_id string, recipe string, fold int, seed int, threshold double").json(path)
    once = log.groupBy("event", *JOB).agg(F.max("threshold").alias("threshold"))
    return once.select("event", *[F.col(c).cast("long").alias(c) if c in ("fold", "seed") else c for c in JOB], "threshold")


@query(
    "snk_08_manifest_build",
    ctes("manifest") + "SELECT dataset_id, path, size_bytes, sha256, evaluation_role, sequences, rows, annotations, events FROM manifest",
)
def snk_08(t):
    path = scratch(t, "manifest_json")
    columns = ("dataset_id", "path", "size_bytes", "sha256", "evaluation_role", "sequences", "rows", "annotations", "events")
    writers.write_manifest(observed_manifest(t).select(*columns), path)
    schema = "dataset_id string, path string, size_bytes long, sha256 string, evaluation_role string, sequences long, rows long, annotations long, events long"
    return t.spark.read.schema(schema).json(path)


# -- projections and filters -------------------------------------------------


@query(
    "prj_02_standardised_channels",
    ctes("samples") + ", scales AS MATERIALIZED (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in CHANNELS
    ) + " FROM samples) SELECT recording_id, sample_idx::BIGINT AS sample_idx, " + ", ".join(
        f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in CHANNELS
    ) + " FROM samples, scales",
)
def prj_02(t):
    """One parameter row, attached as a scalar subquery's single row."""
    from motionframe.operators.models import standardise, standardisation

    parameters = standardisation(t.samples.select(*CHANNELS), CHANNELS)
    return standardise(t.samples.select("recording_id", "sample_idx", *CHANNELS), parameters, CHANNELS).select(
        "recording_id", *longs("sample_idx"), *rounded(*CHANNELS)
    )


@query("prj_04_decision_time", ctes("grid") + "SELECT recording_id, win::BIGINT AS win, (end_sample - 1)::BIGINT AS decision_sample, round((end_sample - 1) / 25.0::DOUBLE, 6) AS decision_s FROM grid")
def prj_04(t):
    decision = F.col("end_sample") - 1
    return t.grid.select("recording_id", *longs("win"), decision.cast("long").alias("decision_sample"), r6(decision / 25.0).alias("decision_s"))


part("noisy", f"SELECT {J}, recording_id, win, split, label, CASE WHEN win % 3 = 0 THEN score + 5e-7 ELSE score - 5e-7 END AS score FROM scores WHERE model_id <> 'impact_rule'", "scores")


@query("prj_05_clipped_probability", ctes("noisy") + f"SELECT {JL}, split, recording_id, win::BIGINT AS win, round(greatest(0.0, least(1.0, score)), 8) AS score FROM noisy")
def prj_05(t):
    noise = F.when(F.col("win") % 3 == 0, 5e-7).otherwise(-5e-7)
    scores = t.job_scores().filter("model_id <> 'impact_rule'")
    clipped = exprs.clip_probability(F.col("score") + noise)
    return scores.select(*job_columns(), "split", "recording_id", *longs("win"), F.round(clipped, 8).alias("score"))


@query(
    "flt_01_data_view",
    ctes("kept") + "SELECT recording_id, win::BIGINT AS win FROM kept WHERE dataset_id IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 7))",
)
def flt_01(t):
    """Datasets of the view come from a table, so the filter is a semi join on its keys."""
    view = t.read("nation").filter(F.col("n_nationkey").isin(1, 3, 7)).select(F.col("n_name").alias("dataset_id"))
    return t.kept.join(view, "dataset_id", "left_semi").select("recording_id", *longs("win"))


@query("flt_02_labelled_windows", ctes("kept") + "SELECT recording_id, win::BIGINT AS win, temporal_label::BIGINT AS temporal_label FROM kept WHERE temporal_label >= 0")
def flt_02(t):
    return t.kept.filter("temporal_label >= 0").select("recording_id", *longs("win", "temporal_label"))


part("roles", f"""
SELECT r.k AS fold, CASE WHEN fold_id = r.k THEN 'test' WHEN fold_id = (r.k + 1) % {FOLD_COUNT} THEN 'validation' ELSE 'train' END AS role, kept.*
FROM kept, range({FOLD_COUNT}) r(k) WHERE temporal_label >= 0
""", "kept")


def role_rows(t):
    return folds.assign_roles(t.kept.filter("temporal_label >= 0"))


@query("flt_03_fold_roles", ctes("roles") + "SELECT fold, role, recording_id, win::BIGINT AS win FROM roles")
def flt_03(t):
    return role_rows(t).select(*longs("fold"), "role", "recording_id", *longs("win"))


@query("agg_32_split_sizes", ctes("roles") + "SELECT fold, role, count(*) AS windows, count(DISTINCT recording_id) AS sequences FROM roles GROUP BY ALL")
def agg_32(t):
    return folds.split_sizes(role_rows(t)).select(*longs("fold"), "role", "windows", "sequences")


@query("flt_04_inference_schedule", ctes("kept") + "SELECT recording_id, win::BIGINT AS win, start_sample::BIGINT AS start_sample FROM kept WHERE start_sample % 25 = 0")
def flt_04(t):
    return scheduled(t.kept, 1.0).select("recording_id", *longs("win", "start_sample"))


def scheduled(rows, interval_s):
    return rows.filter(F.pmod(F.col("start_sample"), F.lit(int(round(25.0 * interval_s)))) == 0)


@query(
    "flt_05_final_refit_set",
    ctes("kept") + """SELECT dataset_id, temporal_label::BIGINT AS temporal_label, count(*) AS windows FROM kept WHERE fold_id >= 0 AND temporal_label >= 0 AND supervision_kind = 'temporal' GROUP BY ALL""",
)
def flt_05(t):
    rows = t.kept.filter("fold_id >= 0 and temporal_label >= 0 and supervision_kind = 'temporal'")
    return rows.groupBy("dataset_id", F.col("temporal_label").cast("long").alias("temporal_label")).agg(F.count(F.lit(1)).alias("windows"))


@query(
    "flt_06_finite_guard",
    ctes("scores") + f"SELECT {JL}, recording_id, win::BIGINT AS win FROM scores WHERE split = 'test' AND win % 13 = 5 AND label = 0",
)
def flt_06(t):
    """Scores of some negatives are replaced by NaN or infinity; the guard finds them."""
    bad = (F.col("win") % 13 == 5) & (F.col("label") == 0)
    fault = F.when(F.col("win") % 2 == 0, float("nan")).otherwise(float("inf"))
    rows = t.job_scores("test").withColumn("score", F.when(bad, fault).otherwise(F.col("score")))
    broken = F.isnan("score") | (F.abs(F.col("score")) == float("inf")) | F.col("score").isNull()
    return rows.filter(broken).select(*job_columns(), "recording_id", *longs("win"))


# -- windows ----------------------------------------------------------------


@query(
    "win_02_sliding_windows",
    ctes("wrows") + "SELECT recording_id, win::BIGINT AS win, count(*) AS samples, " + ", ".join(
        f"round(sum({c} * (p + 1)), 6) + 0.0 AS weighted_{c}" for c in CHANNELS
    ) + " FROM wrows GROUP BY ALL",
)
def win_02(t):
    """Position-weighted sums show that every sample sits at its place in each window."""
    place = F.col("pos") + 1
    sums = [F.sum(F.col(c) * place).alias(f"weighted_{c}") for c in CHANNELS]
    table = windows.complete_windows(windows.window_samples(t.samples), [F.count(F.lit(1)).alias("samples"), *sums])
    return table.select("recording_id", *longs("win"), "samples", *rounded(*[f"weighted_{c}" for c in CHANNELS]))


def _flag_query(name, condition, column):
    @query(name, ctes("marked") + f"SELECT recording_id, win::BIGINT AS win FROM marked WHERE {condition}")
    def build(t):
        return t.marked.filter(column).select("recording_id", *longs("win"))


_flag_query("win_04_excluded_windows", "drop_excluded", "drop_excluded")
_flag_query("win_05_event_tail_windows", "drop_post", "drop_post")


@query(
    "win_06_recording_labels",
    ctes("marked") + "SELECT recording_id, temporal_label::BIGINT AS temporal_label, count(*) AS windows FROM marked WHERE supervision_kind = 'recording' GROUP BY ALL",
)
def win_06(t):
    rows = t.marked.filter("supervision_kind = 'recording'")
    return rows.groupBy("recording_id", F.col("temporal_label").cast("long").alias("temporal_label")).agg(F.count(F.lit(1)).alias("windows"))


part("uncov", """
SELECT e.recording_id, e.onset, e.code FROM ev e JOIN seqs q USING (recording_id) WHERE q.n >= 50 AND NOT EXISTS (
  SELECT 1 FROM kept k WHERE k.recording_id = e.recording_id AND k.end_sample - 1 >= e.onset AND k.end_sample - 1 < e.stop AND k.win % 4 = 0)
""", "ev", "kept", "seqs")


def uncovered(t, rows):
    """Events without a decision window, by the bucketed lookup of every decision."""
    held = metrics.events_at(rows.select("recording_id", (F.col("end_sample") - 1).alias("decision")), t.events)
    covered = held.select("recording_id", F.explode("hits").alias("e")).select("recording_id", "e.onset", "e.code").distinct()
    stored = t.events.join(t.sequences.filter("n >= 50").select("recording_id"), "recording_id", "left_semi")
    return stored.join(covered, ["recording_id", "onset", "code"], "left_anti")


@query("win_08_uncovered_events", ctes("uncov") + "SELECT recording_id, onset::BIGINT AS onset, code FROM uncov")
def win_08(t):
    """With every fourth window only, some events have no decision window left."""
    return uncovered(t, t.kept.filter("win % 4 = 0")).select("recording_id", *longs("onset"), "code")


@query("win_09_bag_labels", ctes("kept") + "SELECT recording_id, bag_label::BIGINT AS bag_label, count(*) AS windows FROM kept GROUP BY ALL")
def win_09(t):
    return t.kept.groupBy("recording_id", F.col("bag_label").cast("long").alias("bag_label")).agg(F.count(F.lit(1)).alias("windows"))


@query(
    "win_10_skip_accounting",
    ctes("marked") + """SELECT dataset_id, (SELECT count(*) FROM seqs s WHERE s.dataset_id = m.dataset_id AND n < 50) AS short_sequences,
    count(*) FILTER (drop_excluded) AS excluded_windows, count(*) FILTER (drop_post) AS post_segment_windows FROM marked m GROUP BY dataset_id""",
)
def win_10(t):
    short = t.sequences.groupBy("dataset_id").agg(F.count(F.when(F.col("n") < 50, 1)).alias("short_sequences"))
    drops = t.marked.groupBy("dataset_id").agg(
        exprs.count_if(F.col("drop_excluded")).alias("excluded_windows"), exprs.count_if(F.col("drop_post")).alias("post_segment_windows")
    )
    return short.join(drops, "dataset_id")


part("build", """
SELECT coalesce(dataset_id, 'ALL') AS dataset_id, sum(sequences)::BIGINT AS sequences, sum(windows)::BIGINT AS windows, sum(positive)::BIGINT AS positive_windows, sum(negative)::BIGINT AS negative_windows, sum(events)::BIGINT AS events, sum(uncovered)::BIGINT AS uncovered_events
FROM (SELECT q.dataset_id, 1 AS sequences, coalesce(w, 0) AS windows, coalesce(p, 0) AS positive, coalesce(g, 0) AS negative, coalesce(e, 0) AS events, coalesce(u, 0) AS uncovered FROM seqs q
  LEFT JOIN (SELECT recording_id, count(*) AS w, count(*) FILTER (temporal_label = 1) AS p, count(*) FILTER (temporal_label = 0) AS g FROM kept GROUP BY 1) USING (recording_id)
  LEFT JOIN (SELECT recording_id, count(*) AS e FROM ev GROUP BY 1) USING (recording_id)
  LEFT JOIN (SELECT e.recording_id, count(*) AS u FROM ev e WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.recording_id = e.recording_id AND k.end_sample - 1 >= e.onset AND k.end_sample - 1 < e.stop) GROUP BY 1) USING (recording_id)
  WHERE q.n >= 50) GROUP BY ROLLUP (dataset_id)
""", "kept", "ev", "seqs")


def build_manifest(t):
    """Totals per dataset and overall; reduced per recording before the roll-up."""
    per = lambda df, *aggs: df.groupBy("recording_id").agg(*aggs)
    label = F.col("temporal_label")
    counted = per(
        t.kept, F.count(F.lit(1)).alias("windows"), exprs.count_if(label == 1).alias("positive_windows"), exprs.count_if(label == 0).alias("negative_windows")
    )
    joined = (
        t.sequences.filter("n >= 50").select("dataset_id", "recording_id")
        .join(counted, "recording_id", "left")
        .join(per(t.events, F.count(F.lit(1)).alias("events")), "recording_id", "left")
        .join(per(uncovered(t, t.kept), F.count(F.lit(1)).alias("uncovered_events")), "recording_id", "left")
    )
    names = ("windows", "positive_windows", "negative_windows", "events", "uncovered_events")
    table = joined.rollup("dataset_id").agg(
        F.count(F.lit(1)).alias("sequences"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    )
    return table.withColumn("dataset_id", F.coalesce("dataset_id", F.lit("ALL")))


query("win_11_build_manifest", ctes("build") + "SELECT * FROM build")(build_manifest)


@query("win_12_manifest_slice", ctes("build") + "SELECT * FROM build WHERE dataset_id = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def win_12(t):
    one = t.read("nation").filter("n_nationkey = 3").select(F.col("n_name").alias("dataset_id"))
    return build_manifest(t).join(one, "dataset_id", "left_semi")


# -- joins ------------------------------------------------------------------


@query(
    "jn_01_recording_with_fold",
    ctes("seqs", "dfold") + """SELECT q.recording_id, CASE WHEN d.fold_id IS NULL THEN 'missing' ELSE 'assigned' END AS status FROM seqs q
    LEFT JOIN (SELECT dataset_id, participant_id, max(fold_id) AS fold_id FROM dfold GROUP BY ALL) d USING (dataset_id, participant_id)""",
)
def jn_01(t):
    keys = ["dataset_id", "participant_id"]
    known = faulty_folds(t).groupBy(*keys).agg(F.max("fold_id").alias("fold_id"))
    status = F.when(F.col("fold_id").isNull(), "missing").otherwise("assigned")
    return t.sequences.drop("fold_id").join(known, keys, "left").select("recording_id", status.alias("status"))


@query(
    "jn_02_window_attributes",
    ctes("impact", "seqs") + "SELECT i.recording_id, win::BIGINT AS win, dataset_id, participant_id, body_location, round(impact_score, 6) AS impact_score FROM impact i JOIN seqs USING (recording_id)",
)
def jn_02(t):
    attributes = t.sequences.select("recording_id", "dataset_id", "participant_id", "body_location")
    return t.impact.join(attributes, "recording_id").select(
        "recording_id", *longs("win"), "dataset_id", "participant_id", "body_location", r6("impact_score").alias("impact_score")
    )


@query(
    "jn_03_decisions_in_events",
    ctes("kept", "ev") + """SELECT k.recording_id, win::BIGINT AS win, e.code, e.onset::BIGINT AS onset FROM kept k JOIN ev e ON e.recording_id = k.recording_id AND k.end_sample - 1 >= e.onset AND k.end_sample - 1 < e.stop""",
)
def jn_03(t):
    rows = t.kept.select("recording_id", "win", (F.col("end_sample") - 1).alias("decision"))
    return metrics.events_at(rows, t.events).select("recording_id", "win", F.explode("hits").alias("e")).select(
        "recording_id", *longs("win"), "e.code", F.col("e.onset").cast("long").alias("onset")
    )


@query(
    "jn_04_windows_clear_of_excludes",
    ctes("grid", "ann") + """SELECT recording_id, win::BIGINT AS win FROM grid g WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.kind = 'exclude' AND a.recording_id = g.recording_id AND g.start_sample < a.stop_sample AND g.end_sample > a.start_sample)""",
)
def jn_04(t):
    none = t.events.filter("false")
    return labels.mark_windows(t.grid, none, t.annotations).filter("not excluded").select("recording_id", *longs("win"))


@query(
    "jn_07_scores_by_policy",
    ctes("test") + f"""SELECT {JL}, p.policy, count(*) AS windows, count(*) FILTER (alert) AS alerts FROM test, (VALUES {', '.join(f"('{p[0]}')" for p in POLICIES)}) p(policy) GROUP BY ALL""",
)
def jn_07(t):
    """Policies are a fixed list, so they are an expansion of the reduced job rows."""
    from motionframe.operators.alarms import policy_rows

    alert = F.col("score") >= F.col("threshold")
    per_job = test_scores(t).groupBy(*JOB).agg(F.count(F.lit(1)).alias("windows"), exprs.count_if(alert).alias("alerts"))
    return policy_rows(per_job).select(*job_columns(), "policy", "windows", "alerts")


@query(
    "jn_09_scope_with_and_without_windows",
    ctes("test", "seqs") + f"""SELECT {JL}, q.recording_id, count(t.win) AS windows FROM (SELECT DISTINCT {J} FROM test) j JOIN seqs q ON q.fold_id = j.fold AND q.n >= 50
    LEFT JOIN test t USING ({J}, recording_id) GROUP BY ALL""",
)
def jn_09(t):
    jobs = stored_thresholds(t).select(*JOB)
    scope = t.scope.select(F.col("fold_id").alias("fold"), "recording_id").join(jobs, "fold")
    counts = t.job_scores("test").groupBy(*JOB, "recording_id").agg(F.count(F.lit(1)).alias("windows"))
    joined = scope.join(counts, [*JOB, "recording_id"], "left")
    return joined.select(*job_columns(), "recording_id", F.coalesce("windows", F.lit(0)).alias("windows"))


@query(
    "jn_10_results_by_job",
    ctes("cls", "evm", "rnk") + f"""SELECT {JL}, round(auroc, 6) AS auroc, round(sensitivity, 6) AS sensitivity, detected_events FROM (SELECT * FROM cls WHERE fold <> 1) c
    FULL JOIN (SELECT * FROM evm WHERE fold <> 2) e USING ({J}) FULL JOIN rnk USING ({J})""",
)
def jn_10(t):
    scores = test_scores(t)
    window = metrics.classification(scores).filter("fold <> 1").select(*JOB, "sensitivity")
    found = metrics.event_metrics(scores.filter("fold <> 2"), t.events, t.scope.select(F.col("fold_id").alias("fold"), "recording_id", "is_fall"))
    joined = window.join(found.select(*JOB, "detected_events"), list(JOB), "full").join(metrics.ranking(scores), list(JOB), "full")
    return joined.select(*job_columns(), *rounded("auroc", "sensitivity"), "detected_events")


# -- aggregates -------------------------------------------------------------

part("pairscore", f"""
SELECT a.model_id, a.recipe, a.fold, a.recording_id, a.win, a.score AS o, b.score AS e FROM (SELECT * FROM scores WHERE split = 'test' AND seed = 3889) a
JOIN (SELECT * FROM scores WHERE split = 'test' AND seed = 3888) b USING (model_id, recipe, fold, recording_id, win)
""", "scores")


@query(
    "agg_23_score_parity",
    ctes("pairscore") + """SELECT model_id, recipe, fold::BIGINT AS fold, count(*) AS samples, round(max(abs(o - e)), 6) AS max_absolute_error, round(avg(abs(o - e)), 6) AS mean_absolute_error,
    round(quantile_cont(abs(o - e), 0.99), 6) AS p99_absolute_error, bool_and(abs(o - e) <= 0.06 + 1e-4 * abs(e)) AS passed FROM pairscore GROUP BY ALL""",
)
def agg_23(t):
    keys, by = ["model_id", "recipe", "fold", "recording_id", "win"], ["model_id", "recipe", "fold"]
    scores = t.job_scores("test").filter("model_id <> 'impact_rule'")
    observed, expected = scores.filter(F.col("seed") == SEED + 1), scores.filter(F.col("seed") == SEED)
    table = metrics.score_parity(observed, expected, keys, by, 1e-4, 0.06)
    errors = observed.select(*keys, F.col("score").alias("o")).join(expected.select(*keys, F.col("score").alias("e")).hint("merge"), keys)
    tail = metrics.exact_quantile(errors.withColumn("d", F.abs(F.col("o") - F.col("e"))), "d", 0.99, by, "p99_absolute_error")
    return table.join(tail, by).select(
        "model_id", "recipe", *longs("fold"), "samples", *rounded("max_absolute_error", "mean_absolute_error", "p99_absolute_error"), "passed"
    )


@query(
    "agg_25_channel_standardisation",
    ctes("wrows") + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, round(avg({c}), 6) + 0.0 AS mean, round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale FROM wrows"
        for c in ("ax", "ay", "az", "gx", "gy", "gz")
    ),
)
def agg_25(t):
    """A sample counts once per window holding it; windows are reduced before the total."""
    from motionframe.operators.models import channel_standardisation

    return channel_standardisation(t.samples).select("channel", *rounded("mean", "scale"))


@query(
    "agg_26_class_weight",
    ctes("roles") + "SELECT fold, count(*) FILTER (temporal_label = 1) AS positives, count(*) FILTER (temporal_label = 0) AS negatives, round(count(*) FILTER (temporal_label = 0)::DOUBLE / count(*) FILTER (temporal_label = 1), 6) AS positive_weight FROM roles WHERE role = 'train' GROUP BY fold",
)
def agg_26(t):
    from motionframe.operators.models import positive_weight

    rows = role_rows(t).filter("role = 'train'").withColumnRenamed("temporal_label", "label")
    return positive_weight(rows, ["fold"]).select(*longs("fold"), "positives", "negatives", *rounded("positive_weight"))


part("bag", f"""
SELECT {J}, recording_id, k AS top_windows, avg(score) FILTER (rk <= k) AS bag_score FROM (
  SELECT *, greatest(1, ceil({TOP_FRACTION}::DOUBLE * c))::BIGINT AS k FROM (
    SELECT {J}, recording_id, score, row_number() OVER (PARTITION BY {J}, recording_id ORDER BY score DESC) AS rk, count(*) OVER (PARTITION BY {J}, recording_id) AS c FROM test)) GROUP BY ALL
""", "test")


@query("agg_27_recording_scores", ctes("bag") + f"SELECT {JL}, recording_id, round(bag_score, 6) AS bag_score FROM bag")
def agg_27(t):
    return metrics.bag_scores(t.job_scores("test")).select(*job_columns(), "recording_id", *rounded("bag_score"))


@query("wf_05_top_fraction_size", ctes("bag") + f"SELECT {JL}, recording_id, top_windows FROM bag")
def wf_05(t):
    return metrics.bag_scores(t.job_scores("test")).select(*job_columns(), "recording_id", *longs("top_windows"))


@query(
    "top_01_top_half_mean",
    ctes("test") + f"""SELECT {JL}, recording_id, round(avg(score), 6) AS top_mean FROM (SELECT {J}, recording_id, score, row_number() OVER (PARTITION BY {J}, recording_id ORDER BY score DESC) AS rk,
    count(*) OVER (PARTITION BY {J}, recording_id) AS c FROM test) WHERE rk <= greatest(1, ceil(0.5::DOUBLE * c)) GROUP BY {J}, recording_id""",
)
def top_01(t):
    table = metrics.bag_scores(t.job_scores("test"), fraction=0.5)
    return table.select(*job_columns(), "recording_id", r6("bag_score").alias("top_mean"))


@query(
    "agg_28_log_loss",
    ctes("test") + f"""SELECT {JL}, round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1.0::DOUBLE - p) END), 6) AS log_loss FROM (
    SELECT *, greatest(1e-7, least(1.0::DOUBLE - 1e-7, score)) AS p FROM test) GROUP BY {J}""",
)
def agg_28(t):
    return metrics.log_loss(t.job_scores("test")).select(*job_columns(), *rounded("log_loss"))


@query(
    "agg_29_phase_timings",
    """SELECT CASE WHEN source IS NULL THEN 'phase' ELSE 'model_phase' END AS level, event_type AS phase, source AS model, count(*) AS samples, round(sum(value), 4) AS total, round(avg(value), 6) AS mean,
    round(quantile_cont(value, 0.5), 6) AS median, max(value) AS maximum FROM (SELECT event_type, value, concat('m', user_id % 4) AS source FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, source))""",
)
def agg_29(t):
    """Event values as phase durations; groups of 4 users stand for models."""
    rows = t.read("events").select(F.col("event_type").alias("phase"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), "value")
    medians = lambda by: metrics.exact_quantile(rows, "value", 0.5, by, "median")
    stats = rows.groupingSets([["phase"], ["phase", "model"]], "phase", "model").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("maximum")
    )
    middle = medians(["phase"]).withColumn("model", F.lit(None).cast("string")).unionByName(medians(["phase", "model"]))
    on = stats["phase"].eqNullSafe(middle["phase"]) & stats["model"].eqNullSafe(middle["model"])
    level = F.when(stats["model"].isNull(), "phase").otherwise("model_phase")
    return stats.join(middle, on).select(
        level.alias("level"), stats["phase"], stats["model"], "samples", F.round("total", 4).alias("total"), *rounded("mean", "median"), "maximum"
    )


part("pstat", """
SELECT q.dataset_id, q.participant_id, count(*) AS sequences, count(*) FILTER (is_fall) AS fall_sequences, coalesce(sum(e), 0)::BIGINT AS events, coalesce(sum(n) FILTER (NOT is_fall), 0)::BIGINT AS adl_rows,
  string_agg(DISTINCT body_location, ',' ORDER BY body_location) AS body_locations FROM seqs q LEFT JOIN (SELECT recording_id, count(*) AS e FROM ev GROUP BY 1) USING (recording_id) GROUP BY ALL
""", "seqs", "ev")


def stats_of(t):
    return folds.participant_stats(t.sequences, t.events, t.annotations)


@query("agg_30_participant_statistics", ctes("pstat") + "SELECT * FROM pstat")
def agg_30(t):
    return stats_of(t).withColumn("body_locations", F.array_join("body_locations", ","))


@query(
    "agg_31_fold_summary",
    ctes("pstat", "parts") + """SELECT fold_id::BIGINT AS fold_id, count(*) AS participants, sum(fall_sequences)::BIGINT AS fall_sequences, sum(events)::BIGINT AS events, sum(adl_rows)::BIGINT AS adl_rows, count(DISTINCT dataset_id) AS datasets
    FROM pstat JOIN parts USING (dataset_id, participant_id) WHERE fold_id >= 0 GROUP BY fold_id""",
)
def agg_31(t):
    table = folds.fold_summary(stats_of(t), t.folds)
    return table.select(*longs("fold_id"), "participants", "fall_sequences", "events", "adl_rows", "datasets")


@query("snk_07_fold_proposal_csv", ctes("parts") + "SELECT 'proposal' AS split_version, dataset_id, participant_id, fold_id::BIGINT AS fold_id FROM parts WHERE fold_id >= 0")
def snk_07(t):
    path = scratch(t, "proposal_csv")
    writers.write_fold_proposal(t.folds, "proposal", path)
    return readers.read_folds(t.spark, path).select("split_version", "dataset_id", "participant_id", *longs("fold_id"))


# -- orders, sets -----------------------------------------------------------


@query(
    "srt_02_windows_by_end",
    ctes("kept") + "SELECT recording_id, win::BIGINT AS win, pos::BIGINT AS pos FROM kept",
)
def srt_02(t):
    """Rank of each surviving window in end order, built from the unsorted windows."""
    return t.build_kept().select("recording_id", *longs("win", "pos"))


@query(
    "srt_03_event_order",
    ctes("ev") + "SELECT recording_id, code, (row_number() OVER (PARTITION BY recording_id ORDER BY onset, stop, code) - 1)::BIGINT AS position FROM ev",
)
def srt_03(t):
    from motionframe.operators.skew import ordered_positions

    order = [F.col(c) for c in ("onset", "stop", "code")]
    placed = ordered_positions(t.events, ["recording_id"], order, F.floor(F.col("onset") / 65536), "position")
    return placed.select("recording_id", "code", "position")


@query(
    "wf_09_sticky_order",
    ctes("pstat", "parts") + f"""SELECT dataset_id, participant_id, row_number() OVER (ORDER BY events DESC, fall_sequences DESC, adl_rows DESC, sha256(concat_ws(':', {SEED}, dataset_id, participant_id))) AS place
    FROM pstat JOIN parts USING (dataset_id, participant_id) WHERE fold_id < 0""",
)
def wf_09(t):
    """Participants without a fold in the order they are assigned; split by event count."""
    from motionframe.operators.skew import ordered_positions

    new = stats_of(t).join(t.folds, ["dataset_id", "participant_id"], "left_anti").withColumns(
        {"tie": F.sha2(F.concat_ws(":", F.lit(str(SEED)), "dataset_id", "participant_id"), 256), "one": F.lit(0)}
    )
    order = [F.col("events").desc(), F.col("fall_sequences").desc(), F.col("adl_rows").desc(), F.col("tie")]
    placed = ordered_positions(new, ["one"], order, -F.col("events"), "place")
    return placed.select("dataset_id", "participant_id", (F.col("place") + 1).alias("place"))


@query("set_01_union_of_collections", ctes("seqs") + "SELECT CASE WHEN suppkey % 11 = 0 THEN 'team' ELSE 'base' END AS collection, recording_id, n FROM seqs")
def set_01(t):
    tag = lambda name, condition: t.sequences.filter(condition).select(F.lit(name).alias("collection"), "recording_id", "n")
    return tag("base", "suppkey % 11 <> 0").unionByName(tag("team", "suppkey % 11 = 0"))


@query(
    "set_02_missing_and_extra_keys",
    ctes("dfold") + """SELECT 'missing' AS status, dataset_id, participant_id FROM (SELECT dataset_id, participant_id FROM parts EXCEPT SELECT dataset_id, participant_id FROM dfold)
    UNION ALL SELECT 'extra', dataset_id, participant_id FROM (SELECT dataset_id, participant_id FROM dfold EXCEPT SELECT dataset_id, participant_id FROM parts)""",
)
def set_02(t):
    keys = ["dataset_id", "participant_id"]
    expected, seen = t.participants.select(*keys).distinct(), faulty_folds(t).select(*keys).distinct()
    tagged = lambda df, name: df.select(F.lit(name).alias("status"), *keys)
    return tagged(expected.exceptAll(seen), "missing").unionByName(tagged(seen.exceptAll(expected), "extra"))


@query(
    "set_03_shared_participants",
    ctes("dfold") + """SELECT dataset_id, participant_id FROM dfold WHERE fold_id = 0 INTERSECT SELECT dataset_id, participant_id FROM dfold WHERE fold_id <> 0""",
)
def set_03(t):
    keys = ["dataset_id", "participant_id"]
    rows = faulty_folds(t)
    return rows.filter("fold_id = 0").select(*keys).intersect(rows.filter("fold_id <> 0").select(*keys))


@query("set_04_new_participants", ctes("parts") + "SELECT dataset_id, participant_id FROM parts WHERE fold_id < 0")
def set_04(t):
    keys = ["dataset_id", "participant_id"]
    return t.participants.select(*keys).subtract(t.folds.select(*keys))


@query(
    "set_05_union_of_shards",
    ctes("scores") + "SELECT model_id, recipe, seed::BIGINT AS seed, recording_id, win::BIGINT AS win, count(*) AS copies FROM scores WHERE split = 'validation' GROUP BY ALL",
)
def set_05(t):
    """The five validation shards of a method hold every window once."""
    shards = t.job_scores("validation")
    parts = [shards.filter(F.col("fold") == k) for k in range(FOLD_COUNT)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    keys = ["model_id", "recipe", F.col("seed").cast("long").alias("seed"), "recording_id", F.col("win").cast("long").alias("win")]
    return union.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "set_06_snapshot_diff",
    ctes("dmanifest") + """SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id, CASE WHEN a.dataset_id IS NULL THEN 'added' WHEN b.dataset_id IS NULL THEN 'removed'
    WHEN a.sha256 <> b.sha256 OR a.size_bytes <> b.size_bytes THEN 'changed' ELSE 'same' END AS status FROM dmanifest a FULL JOIN (SELECT * FROM manifest WHERE dataset_id NOT LIKE '%4') b USING (dataset_id)""",
)
def set_06(t):
    from motionframe.plans.quality_queries import declared_manifest

    old = declared_manifest(t).select("dataset_id", F.struct("sha256", "size_bytes").alias("a"))
    new = observed_manifest(t).filter("dataset_id not like '%4'").select("dataset_id", F.struct("sha256", "size_bytes").alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return old.join(new, "dataset_id", "full").select("dataset_id", status.alias("status"))


# -- scalar functions -------------------------------------------------------

_JSON = """concat('{"fold":', fold, ',"model_id":"', model_id, '","recipe":"', recipe, '","seed":', seed, '}')"""


def job_payload():
    return {k: F.col(k).cast("int") if k in ("fold", "seed") else F.col(k) for k in JOB}


@query("scl_01_canonical_digest", ctes("thr") + f"SELECT {JL}, sha256({_JSON}) AS digest FROM thr")
def scl_01(t):
    return stored_thresholds(t).select(*job_columns(), exprs.canonical_digest(job_payload()).alias("digest"))


@query("scl_02_store_fingerprint")
def scl_02(t):
    """Fingerprint of the store next to the size of what it covers."""
    return t.sequences.groupBy("dataset_id").agg(F.sum("n").alias("samples")).withColumn("fingerprint", F.lit(t.root.rsplit("-", 1)[-1]))


@query("scl_03_job_key_and_hash", ctes("thr") + f"SELECT {JL}, concat_ws('/', model_id, recipe, concat('fold-', fold), concat('seed-', seed)) AS job_key, sha256(concat('v1:', {_JSON})) AS job_hash FROM thr")
def scl_03(t):
    key = F.concat_ws("/", "model_id", "recipe", F.concat(F.lit("fold-"), F.col("fold").cast("string")), F.concat(F.lit("seed-"), F.col("seed").cast("string")))
    return stored_thresholds(t).select(*job_columns(), key.alias("job_key"), job_hash("v1").alias("job_hash"))


def job_hash(version):
    return F.sha2(F.concat(F.lit(f"{version}:"), exprs.canonical_json(job_payload())), 256)


@query("scl_04_run_id", ctes("seqs") + "SELECT dataset_id, concat('experiment-', substr(sha256(concat(dataset_id, ':', sum(n)::BIGINT)), 1, 12)) AS run_id FROM seqs GROUP BY dataset_id")
def scl_04(t):
    totals = t.sequences.groupBy("dataset_id").agg(F.sum("n").alias("rows"))
    digest = F.sha2(F.concat("dataset_id", F.lit(":"), F.col("rows").cast("string")), 256)
    return totals.select("dataset_id", F.concat(F.lit("experiment-"), F.substring(digest, 1, 12)).alias("run_id"))


@query("scl_05_tie_break_hash", ctes("parts") + f"SELECT dataset_id, participant_id, k AS fold, sha256(concat_ws(':', {SEED}, dataset_id, participant_id, k)) AS tie FROM parts, range({FOLD_COUNT}) r(k)")
def scl_05(t):
    every = F.explode(F.array(*[F.lit(k).cast("long") for k in range(FOLD_COUNT)]))
    rows = t.participants.select("dataset_id", "participant_id", every.alias("fold"))
    return rows.withColumn("tie", F.sha2(F.concat_ws(":", F.lit(str(SEED)), "dataset_id", "participant_id", F.col("fold").cast("string")), 256))


@query("scl_06_participant_key", ctes("parts") + "SELECT concat(dataset_id, chr(1), participant_id) AS participant_key, dataset_id, participant_id FROM parts")
def scl_06(t):
    """Joined key and the two columns cut from it again."""
    keyed = t.participants.select(F.concat_ws("\u0001", "dataset_id", "participant_id").alias("participant_key"))
    cut = F.split("participant_key", "\u0001", 2)
    return keyed.select("participant_key", cut[0].alias("dataset_id"), cut[1].alias("participant_id"))


part("vers", "SELECT DISTINCT concat(p_size % 3, '.', p_size % 5, '.', p_size % 2) AS a, concat(p_partkey % 3, '.', p_size % 4, '.0') AS b FROM part")


@query("scl_07_version_compatibility", ctes("vers") + "SELECT a AS actual, b AS expected, CASE WHEN split_part(a, '.', 1) = '0' THEN a = b ELSE split_part(a, '.', 1) = split_part(b, '.', 1) END AS compatible FROM vers")
def scl_07(t):
    text = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = t.spark.read.schema("p_partkey long, p_size int").parquet(f"{t.sf_dir}/part.parquet")
    pairs = rows.select(text(size % 3, size % 5, size % 2).alias("actual"), text(key % 3, size % 4, F.lit(0)).alias("expected")).distinct()
    return pairs.withColumn("compatible", exprs.compatible_version(F.col("actual"), F.col("expected")))


@query("scl_08_identifier_checks", ctes("dmanifest") + "SELECT dataset_id, regexp_matches(sha256, '^[0-9a-f]{64}$') AS digest_ok, regexp_matches(dataset_id, '^[A-Za-z0-9_]+$') AS id_ok FROM dmanifest")
def scl_08(t):
    from motionframe.plans.quality_queries import declared_manifest

    return declared_manifest(t).select(
        "dataset_id", F.col("sha256").rlike(quality.HEX64).alias("digest_ok"), F.col("dataset_id").rlike("^[A-Za-z0-9_]+$").alias("id_ok")
    )


@query("scl_09_boolean_text", "SELECT doc_id, lower(trim(v)) IN ('1', 'true', 'yes') AS flag FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN toxic::VARCHAR WHEN toxic = 1 THEN ' Yes ' ELSE 'no' END AS v FROM labels)")
def scl_09(t):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("toxic").cast("string")).when(F.col("toxic") == 1, " Yes ").otherwise("no")
    return t.read("labels").select("doc_id", exprs.truth(text).alias("flag"))


_MICRO = ", ".join(f"round({c} * 1e6)::BIGINT" for c in CHANNELS)
part("blocks", f"""
SELECT recording_id, sample_idx // 4096 AS b, sha256(string_agg(concat_ws(':', sample_idx, {_MICRO}), ',' ORDER BY sample_idx)) AS d FROM samples GROUP BY ALL
""", "samples")
part("notes", """
SELECT recording_id, string_agg(concat_ws(':', kind, start_sample, stop_sample, code), ',' ORDER BY kind, start_sample, stop_sample, code) AS a FROM ann GROUP BY recording_id
""", "ann")


@query(
    "scl_10_logical_content_digest",
    ctes("blocks", "notes", "seqs") + """SELECT recording_id, sha256(concat_ws('|', concat_ws(':', s.dataset_id, s.participant_id, s.body_location, s.supervision_kind, s.n), coalesce(a, ''), d)) AS digest
    FROM (SELECT recording_id, string_agg(d, ',' ORDER BY b) AS d FROM blocks GROUP BY recording_id) JOIN seqs s USING (recording_id) LEFT JOIN notes USING (recording_id)""",
)
def scl_10(t):
    """Digest of each recording's metadata, annotations and all channels of its samples, these
    by digests of 4,096-sample blocks, so no task reads a whole recording."""
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long").cast("string")
    text = F.concat_ws(":", F.col("sample_idx").cast("string"), *map(micro, CHANNELS))
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda s: s["v"]), ",")
    block = F.floor(F.col("sample_idx") / 4096)
    inner = t.samples.select("recording_id", block.alias("b"), "sample_idx", text.alias("v")).groupBy("recording_id", "b").agg(
        F.sha2(ordered("sample_idx", "v"), 256).alias("v")
    )
    blocks = inner.groupBy("recording_id").agg(ordered("b", "v").alias("d"))
    place = F.struct("kind", "start_sample", "stop_sample", "code")
    note = F.concat_ws(":", "kind", F.col("start_sample").cast("string"), F.col("stop_sample").cast("string"), "code")
    notes = t.annotations.select("recording_id", place.alias("k"), note.alias("v")).groupBy("recording_id").agg(ordered("k", "v").alias("a"))
    names = ("dataset_id", "participant_id", "body_location", "supervision_kind")
    about = t.sequences.select("recording_id", F.concat_ws(":", *names, F.col("n").cast("string")).alias("m"))
    whole = blocks.join(about, "recording_id").join(notes, "recording_id", "left")
    return whole.select("recording_id", F.sha2(F.concat_ws("|", "m", F.coalesce("a", F.lit("")), "d"), 256).alias("digest"))


@query(
    "scl_11_evaluation_fingerprint",
    ctes("thr") + f"SELECT {JL}, CASE WHEN fold = 3 THEN NULL ELSE sha256(concat('{{\"fold\":', fold, ',\"policy\":\"{REFERENCE_POLICY}\",\"rate\":25,\"recipe\":\"', recipe, '\",\"seed\":', seed, '}}')) END AS fingerprint FROM thr",
)
def scl_11(t):
    """A required field is missing in fold 3, so it has no fingerprint."""
    policy = F.when(F.col("fold") != 3, REFERENCE_POLICY)
    fields = {"fold": F.col("fold").cast("int"), "policy": policy, "rate": F.lit(25), "recipe": F.col("recipe"), "seed": F.col("seed").cast("int")}
    complete = F.col("fold").isNotNull() & policy.isNotNull() & F.col("recipe").isNotNull() & F.col("seed").isNotNull()
    return stored_thresholds(t).select(*job_columns(), F.when(complete, exprs.canonical_digest(fields)).alias("fingerprint"))


@query(
    "scl_12_snapshot_id",
    ctes("seqs") + """SELECT dataset_id, sha256(string_agg(d, ',' ORDER BY b)) AS snapshot_id FROM (
    SELECT dataset_id, substr(sha256(recording_id), 1, 3) AS b, sha256(string_agg(recording_id, ',' ORDER BY recording_id)) AS d FROM seqs GROUP BY ALL) GROUP BY dataset_id""",
)
def scl_12(t):
    """Digest of the sorted recording ids in 4,096 hash buckets, then of the bucket digests."""
    bucket = F.substring(F.sha2("recording_id", 256), 1, 3)
    ids = F.array_join(F.sort_array(F.collect_list("recording_id")), ",")
    parts = t.sequences.groupBy("dataset_id", bucket.alias("b")).agg(F.sha2(ids, 256).alias("v"))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda s: s["v"])
    return parts.groupBy("dataset_id").agg(F.sha2(F.array_join(joined, ","), 256).alias("snapshot_id"))


@query("scl_13_median_best_epoch", "SELECT l_returnflag AS model_id, quantile_cont(l_linenumber + l_quantity, 0.5)::DOUBLE AS median, trunc(quantile_cont(l_linenumber + l_quantity, 0.5))::BIGINT AS best_epoch FROM lineitem GROUP BY 1")
def scl_13(t):
    """Small integers stand for epochs; the percentile keeps one count per distinct value."""
    epochs = t.read("lineitem").select(F.col("l_returnflag").alias("model_id"), (F.col("l_linenumber") + F.col("l_quantity")).alias("e"))
    return epochs.groupBy("model_id").agg(F.expr("percentile(e, 0.5)").alias("median")).withColumn("best_epoch", F.col("median").cast("long"))
