"""Data-quality rules over the collection tables and over copies with known faults."""

from pyspark.sql import functions as F

from motionframe.functions.exprs import canonical_digest
from motionframe.operators import folds, quality
from motionframe.plans.metric_queries import longs, stored_thresholds
from motionframe.plans.registry import query
from motionframe.plans.sql import JL, J, ctes, part

part("coll", """
SELECT *, concat('act_', flag) AS activity_code, sum(n) OVER w - n AS sample_start, sum(n) OVER w AS sample_stop, 25.0::DOUBLE AS rate
FROM seqs WINDOW w AS (PARTITION BY dataset_id ORDER BY suppkey, flag ROWS UNBOUNDED PRECEDING)
""", "seqs")
part("dseq", """
SELECT * REPLACE (CASE WHEN suppkey % 29 = 7 THEN '' ELSE body_location END AS body_location,
  CASE WHEN suppkey % 31 = 8 AND flag = 'R' THEN NOT is_fall ELSE is_fall END AS is_fall,
  CASE WHEN suppkey % 13 = 6 AND flag = 'A' THEN 'unknown' ELSE supervision_kind END AS supervision_kind,
  CASE WHEN suppkey % 19 = 4 AND flag = 'N' THEN 0.0 WHEN suppkey % 23 = 5 AND flag = 'R' THEN -25.0 ELSE 25.0 END AS rate,
  sample_start + CASE WHEN suppkey % 17 = 3 AND flag = 'A' THEN 1 ELSE 0 END AS sample_start) FROM coll
""", "coll")
part("dann", """
SELECT recording_id, CASE WHEN s % 37 = 9 AND kind = 'exclude' THEN 'skip' ELSE kind END AS kind,
  start_sample + CASE WHEN s % 7 = 2 AND kind = 'impact' THEN 1000 ELSE 0 END + CASE WHEN s % 9 = 1 AND kind = 'activity' AND code = 'ADL' THEN 2 ELSE 0 END AS start_sample,
  stop_sample + CASE WHEN s % 7 = 2 AND kind = 'impact' THEN 1000 ELSE 0 END + CASE WHEN s % 7 = 3 AND kind = 'onset' THEN 1 ELSE 0 END
    + CASE WHEN s % 13 = 5 AND kind = 'exclude' THEN 3 ELSE 0 END AS stop_sample,
  CASE WHEN s % 11 = 4 AND kind = 'activity' THEN '' ELSE code END AS code, CASE WHEN s % 5 = 2 THEN xor(r, 1) ELSE r END AS row_idx
FROM (SELECT a.*, q.suppkey AS s, row_number() OVER (PARTITION BY recording_id ORDER BY start_sample,
    CASE kind WHEN 'activity' THEN 0 WHEN 'onset' THEN 1 WHEN 'impact' THEN 2 ELSE 3 END, stop_sample, code) - 1 AS r
  FROM ann a JOIN seqs q USING (recording_id))
""", "ann", "seqs")
part("dpair", """
SELECT o.recording_id, o.code, o.start_sample AS onset, count(a.stop_sample) AS acts, max(a.stop_sample) AS stop
FROM (SELECT * FROM dann WHERE kind = 'onset') o LEFT JOIN (SELECT * FROM dann WHERE kind = 'activity') a
  ON a.recording_id = o.recording_id AND a.code = o.code AND a.start_sample = o.start_sample AND a.stop_sample > o.start_sample
GROUP BY ALL
""", "dann")
part("dpts", """
SELECT p.*, (SELECT count(*) FROM dann i WHERE i.kind = 'impact' AND i.recording_id = p.recording_id AND i.code = p.code
  AND p.acts = 1 AND i.start_sample > p.onset AND i.start_sample < p.stop) AS imps FROM dpair p
""", "dpair")


@query(
    "dq_01_sequence_ranges",
    ctes("dseq") + """SELECT 'not_contiguous' AS rule_id, dataset_id, recording_id, sample_start::BIGINT AS detail FROM (
      SELECT *, lag(sample_stop, 1, 0) OVER (PARTITION BY dataset_id ORDER BY sample_start, sample_stop, recording_id) AS p FROM dseq) WHERE sample_start <> p
    UNION ALL SELECT 'too_short', dataset_id, recording_id, sample_start::BIGINT FROM dseq WHERE sample_stop - sample_start < 2
    UNION ALL SELECT 'not_covering', dataset_id, '', max(sample_stop)::BIGINT FROM dseq GROUP BY dataset_id HAVING max(sample_stop) <> sum(n)""",
)
def dq_01(t):
    counts = t.sequences.groupBy("dataset_id").agg(F.sum("n").alias("samples"))
    return quality.sequence_ranges(t.faulty_sequences, counts)


query(
    "wf_06_contiguity_with_previous",
    ctes("coll") + """SELECT dataset_id, recording_id, sample_start::BIGINT AS sample_start, (lag(sample_stop) OVER (PARTITION BY dataset_id ORDER BY sample_start))::BIGINT AS prev_sample_stop FROM coll""",
)(
    lambda t: quality.with_previous(
        t.collection, ["dataset_id"], [F.col("sample_start")], F.floor(F.col("sample_start") / 1_000_000), ["sample_stop"]
    ).select("dataset_id", "recording_id", "sample_start", "prev_sample_stop")
)


@query("dq_02_source_rate", ctes("dseq") + "SELECT 'rate_not_positive' AS rule_id, recording_id FROM dseq WHERE NOT (rate > 0)")
def dq_02(t):
    return quality.source_rate(t.faulty_sequences)


@query(
    "dq_03_text_fields",
    ctes("dseq") + """SELECT rule_id, participant_id, sample_start::BIGINT AS sample_start FROM (
    SELECT 'empty_body_location' AS rule_id, * FROM dseq WHERE body_location = '' UNION ALL
    SELECT 'unknown_supervision', * FROM dseq WHERE supervision_kind NOT IN ('temporal', 'recording'))""",
)
def dq_03(t):
    return quality.text_fields(t.faulty_sequences)


@query(
    "dq_04_annotation_bounds",
    ctes("dann") + """, j AS (SELECT a.*, q.n, kind IN ('onset', 'impact') AS point FROM dann a LEFT JOIN seqs q USING (recording_id))
    SELECT rule_id, recording_id, kind, start_sample::BIGINT AS start_sample, stop_sample::BIGINT AS stop_sample FROM (
      SELECT 'unknown_kind' AS rule_id, * FROM j WHERE kind NOT IN ('activity', 'onset', 'impact', 'exclude') UNION ALL
      SELECT 'empty_code', * FROM j WHERE code = '' UNION ALL
      SELECT 'start_out_of_bounds', * FROM j WHERE start_sample < 0 OR start_sample >= n UNION ALL
      SELECT 'point_has_length', * FROM j WHERE point AND start_sample <> stop_sample UNION ALL
      SELECT 'bad_interval', * FROM j WHERE NOT point AND NOT (start_sample < stop_sample AND stop_sample <= n))""",
)
def dq_04(t):
    return quality.annotation_bounds(t.faulty_annotations, t.sequences)


@query(
    "dq_05_annotation_order",
    ctes("dann") + """, k AS (SELECT recording_id, row_idx, {'a': start_sample, 'b': CASE kind WHEN 'activity' THEN 0 WHEN 'onset' THEN 1 WHEN 'impact' THEN 2 WHEN 'exclude' THEN 3 END, 'c': stop_sample, 'd': code} AS key FROM dann WHERE kind <> 'skip')
    SELECT 'not_sorted' AS rule_id, a.recording_id, a.row_idx::BIGINT AS row_idx FROM k a JOIN k b ON a.recording_id = b.recording_id AND a.row_idx = b.row_idx + 1 WHERE a.key < b.key""",
)
def dq_05(t):
    return quality.annotation_order(t.faulty_annotations.filter("kind <> 'skip'"))


@query(
    "dq_06_temporal_coverage",
    ctes("dann") + """, sp AS (SELECT a.*, q.n FROM dann a JOIN seqs q USING (recording_id) WHERE q.supervision_kind = 'temporal' AND kind IN ('activity', 'exclude'))
    SELECT 'gap_or_overlap' AS rule_id, recording_id, start_sample::BIGINT AS detail FROM (
      SELECT *, lag(stop_sample, 1, 0) OVER (PARTITION BY recording_id ORDER BY start_sample, stop_sample) AS p FROM sp) WHERE start_sample <> p
    UNION ALL SELECT 'end_not_reached', recording_id, coalesce(e, 0)::BIGINT FROM (SELECT recording_id, n FROM seqs WHERE supervision_kind = 'temporal') LEFT JOIN (
      SELECT recording_id, arg_max(stop_sample, {'a': start_sample, 'b': stop_sample}) AS e FROM sp GROUP BY 1) USING (recording_id) WHERE coalesce(e, 0) <> n""",
)
def dq_06(t):
    return quality.temporal_coverage(t.faulty_annotations, t.sequences)


@query(
    "dq_07_event_consistency",
    ctes("dpts", "dseq") + """SELECT 'onset_unpaired' AS rule_id, recording_id, onset::BIGINT AS detail FROM dpts WHERE acts <> 1 OR imps <> 1
    UNION ALL SELECT 'impact_unpaired', recording_id, start_sample::BIGINT FROM dann i WHERE kind = 'impact' AND 1 <> (SELECT count(*) FROM dpts p
      WHERE p.acts = 1 AND p.recording_id = i.recording_id AND p.code = i.code AND i.start_sample > p.onset AND i.start_sample < p.stop)
    UNION ALL SELECT 'fall_flag_mismatch', recording_id, coalesce(c, 0)::BIGINT FROM dseq LEFT JOIN (SELECT recording_id, count(*) AS c FROM dpts WHERE acts = 1 AND imps = 1 GROUP BY 1) USING (recording_id)
      WHERE supervision_kind = 'temporal' AND is_fall <> (coalesce(c, 0) > 0)""",
)
def dq_07(t):
    return quality.event_consistency(t.faulty_annotations, t.faulty_sequences)


@query(
    "win_07_event_pairing",
    ctes("ev") + "SELECT recording_id, onset::BIGINT AS onset, impact::BIGINT AS impact, stop::BIGINT AS stop, code FROM ev",
)
def win_07(t):
    from motionframe.operators.labels import pair_events

    return pair_events(t.annotations).select("recording_id", *longs("onset", "impact", "stop"), "code")


# -- manifests --------------------------------------------------------------

part("summ", """
SELECT q.dataset_id, count(*) AS sequences, sum(n)::BIGINT AS rows, coalesce(sum(a), 0)::BIGINT AS annotations, coalesce(sum(e), 0)::BIGINT AS events,
  coalesce(sum(g), 0)::BIGINT AS segments, count(DISTINCT participant_id) AS participants, count(*) FILTER (is_fall) AS fall_sequences,
  count(*) FILTER (supervision_kind = 'temporal') AS temporal_sequences, count(*) FILTER (supervision_kind = 'recording') AS recording_sequences
FROM seqs q LEFT JOIN (SELECT recording_id, count(*) AS a, count(*) FILTER (kind = 'activity') AS g FROM ann GROUP BY 1) USING (recording_id)
LEFT JOIN (SELECT recording_id, count(*) AS e FROM ev GROUP BY 1) USING (recording_id) GROUP BY 1
""", "ann", "seqs")
_FIELDS = ("sequences", "rows", "annotations", "events", "segments", "participants", "fall_sequences", "temporal_sequences", "recording_sequences")
part("manifest", """
SELECT *, concat('datasets/', lower(replace(dataset_id, ' ', '_')), '.parquet') AS path, sequences * 1000 AS size_bytes,
  sha256(concat_ws(':', dataset_id, sequences, rows, annotations)) AS sha256, 'cross_validation' AS evaluation_role FROM summ
""", "summ")
part("dmanifest", """
SELECT * REPLACE (rows + CASE WHEN dataset_id LIKE '%1' THEN 5 ELSE 0 END AS rows,
  CASE WHEN dataset_id LIKE '%2' THEN -1 ELSE annotations END AS annotations,
  CASE WHEN dataset_id LIKE '%3' THEN 'datasets/shared.parquet' WHEN dataset_id LIKE '%4' THEN '../' || path ELSE path END AS path,
  CASE WHEN dataset_id LIKE '%5' THEN upper(sha256) ELSE sha256 END AS sha256,
  CASE WHEN dataset_id LIKE '%6' THEN 'holdout' ELSE evaluation_role END AS evaluation_role,
  CASE WHEN dataset_id LIKE '%7' THEN 0 ELSE size_bytes END AS size_bytes)
FROM manifest WHERE dataset_id NOT LIKE '%8'
""", "manifest")


def observed_manifest(t):
    table = quality.summary(t.sequences, t.annotations, t.events)
    path = F.concat(F.lit("datasets/"), F.lower(F.replace("dataset_id", F.lit(" "), F.lit("_"))), F.lit(".parquet"))
    return table.withColumns(
        {
            "path": path,
            "size_bytes": F.col("sequences") * 1000,
            "sha256": F.sha2(F.concat_ws(":", "dataset_id", *[F.col(c).cast("string") for c in ("sequences", "rows", "annotations")]), 256),
            "evaluation_role": F.lit("cross_validation"),
        }
    )


def declared_manifest(t):
    """A manifest that disagrees with the data in known ways."""
    d = lambda digit: F.col("dataset_id").endswith(digit)
    path = F.when(d("3"), "datasets/shared.parquet").when(d("4"), F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    return observed_manifest(t).filter(~d("8")).withColumns(
        {
            "rows": F.col("rows") + F.when(d("1"), 5).otherwise(0),
            "annotations": F.when(d("2"), F.lit(-1).cast("long")).otherwise(F.col("annotations")),
            "path": path,
            "sha256": F.when(d("5"), F.upper("sha256")).otherwise(F.col("sha256")),
            "evaluation_role": F.when(d("6"), "holdout").otherwise(F.col("evaluation_role")),
            "size_bytes": F.when(d("7"), F.lit(0).cast("long")).otherwise(F.col("size_bytes")),
        }
    )


@query("dq_18_dataset_summary", ctes("summ") + "SELECT * FROM summ")
def dq_18(t):
    return quality.summary(t.sequences, t.annotations, t.events)


def diff_sql(left, right, keys, fields):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    key = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
    return " UNION ALL ".join(
        f"SELECT {key}, '{f}' AS field, a.{f}::VARCHAR AS declared, b.{f}::VARCHAR AS observed FROM {left} a FULL JOIN {right} b ON {on} WHERE a.{f} IS DISTINCT FROM b.{f}"
        for f in fields
    )


@query("dq_08_declared_counts", ctes("dmanifest") + diff_sql("dmanifest", "manifest", ["dataset_id"], ("sequences", "rows", "annotations")))
def dq_08(t):
    return quality.count_mismatches(declared_manifest(t), observed_manifest(t), ["dataset_id"], ("sequences", "rows", "annotations"))


@query(
    "dq_09_duplicate_recordings",
    ctes("seqs") + "SELECT participant_id, body_location, count(*) AS rows FROM seqs GROUP BY ALL HAVING count(*) > 1",
)
def dq_09(t):
    """Read with the participant as recording key, every supplier's three flags collide."""
    return quality.duplicates(t.sequences, ["participant_id", "body_location"])


_MANIFEST_FIELDS = ("path", "size_bytes", "sha256", "evaluation_role", *_FIELDS)


@query("dq_10_manifest_reconciliation", ctes("dmanifest") + diff_sql("dmanifest", "manifest", ["dataset_id"], _MANIFEST_FIELDS))
def dq_10(t):
    return quality.count_mismatches(declared_manifest(t), observed_manifest(t), ["dataset_id"], _MANIFEST_FIELDS)


part("parts", "SELECT DISTINCT dataset_id, participant_id, suppkey, fold_id FROM seqs", "seqs")
part("dfold", """
SELECT dataset_id, participant_id, CASE WHEN suppkey % 16 = 3 THEN 7 ELSE suppkey % 5 END AS fold_id FROM parts WHERE suppkey % 9 <> 4
UNION ALL SELECT dataset_id, participant_id, 0 FROM parts WHERE suppkey % 12 = 5
UNION ALL SELECT dataset_id, concat('x', participant_id), 1 FROM parts WHERE suppkey % 25 = 6
""", "parts")


def faulty_folds(t):
    s = F.substring("participant_id", 2, 20).cast("long")
    parts = t.participants.select("dataset_id", "participant_id", s.alias("s"))
    row = lambda df, pid, fold: df.select("dataset_id", pid.alias("participant_id"), fold.cast("int").alias("fold_id"))
    pid = F.col("participant_id")
    main = row(parts.filter("s % 9 <> 4"), pid, F.when(F.col("s") % 16 == 3, 7).otherwise(F.col("s") % 5))
    twice = row(parts.filter("s % 12 = 5"), pid, F.lit(0))
    extra = row(parts.filter("s % 25 = 6"), F.concat(F.lit("x"), pid), F.lit(1))
    return main.unionByName(twice).unionByName(extra)


@query(
    "dq_11_split_coverage",
    ctes("dfold") + """SELECT 'duplicate_assignment' AS rule_id, dataset_id, participant_id FROM dfold GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'no_fold', dataset_id, participant_id FROM parts p WHERE NOT EXISTS (SELECT 1 FROM dfold d WHERE d.dataset_id = p.dataset_id AND d.participant_id = p.participant_id)
    UNION ALL SELECT 'no_data', dataset_id, participant_id FROM dfold d WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE d.dataset_id = p.dataset_id AND d.participant_id = p.participant_id)
    UNION ALL SELECT 'bad_fold', dataset_id, participant_id FROM dfold WHERE fold_id NOT BETWEEN 0 AND 4""",
)
def dq_11(t):
    return quality.split_coverage(faulty_folds(t), t.participants.select("dataset_id", "participant_id"))


@query("dq_12_anonymous_participants", "SELECT s_suppkey AS suppkey, s_name AS name FROM supplier WHERE NOT regexp_matches(s_name, '^[A-Za-z]+#?[0-9]*[02468]$')")
def dq_12(t):
    names = t.read("supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"))
    return quality.malformed_ids(names, "name", "^[A-Za-z]+#?[0-9]*[02468]$")


@query(
    "dq_13_store_integrity",
    ctes("marked") + """SELECT rule_id, recording_id, detail::BIGINT AS detail FROM (
    SELECT 'event_order' AS rule_id, recording_id, CASE WHEN n % 7 = 0 THEN onset + 40 ELSE onset END AS detail FROM ev WHERE n % 7 = 0
    UNION ALL SELECT 'window_length', recording_id, win FROM marked WHERE kept AND win % 11 = 3 AND recording_id NOT LIKE '%_N'
    UNION ALL SELECT 'window_orphan', recording_id, win FROM marked WHERE kept AND recording_id LIKE '%_N')""",
)
def dq_13(t):
    """Faults: recordings N unknown, every 11th window one sample short, some onsets late."""
    known = t.sequences.filter("flag <> 'N'")
    late = F.when(F.col("n") % 7 == 0, F.col("onset") + 40).otherwise(F.col("onset"))
    events = t.event_rows.withColumn("onset", late)
    short = (F.col("win") % 11 == 3) & ~F.col("recording_id").endswith("_N")
    windows = t.kept.withColumn("end_sample", F.col("end_sample") - short.cast("int"))
    return quality.store_integrity(windows, events, known)


@query(
    "dq_14_manifest_entries",
    ctes("dmanifest") + """SELECT 'bad_digest' AS rule_id, dataset_id, path FROM dmanifest WHERE NOT regexp_matches(sha256, '^[0-9a-f]{64}$')
    UNION ALL SELECT 'unsafe_path', dataset_id, path FROM dmanifest WHERE path LIKE '../%'
    UNION ALL SELECT 'bad_size', dataset_id, path FROM dmanifest WHERE size_bytes <= 0
    UNION ALL SELECT 'bad_count', dataset_id, path FROM dmanifest WHERE annotations < 0
    UNION ALL SELECT 'bad_role', dataset_id, path FROM dmanifest WHERE evaluation_role <> 'cross_validation'
    UNION ALL SELECT 'duplicate_path', dataset_id, path FROM dmanifest WHERE path IN (SELECT path FROM dmanifest GROUP BY 1 HAVING count(*) > 1)""",
)
def dq_14(t):
    return quality.manifest_entries(declared_manifest(t), ("cross_validation",))


# -- runs and splits --------------------------------------------------------


@query(
    "dq_16_split_leakage",
    ctes("marked") + """, role AS (SELECT r.k AS fold, CASE WHEN f = r.k THEN 'test' WHEN f = (r.k + 1) % 5 THEN 'validation' ELSE 'train' END AS role, dataset_id, participant_id, temporal_label
      FROM (SELECT *, CASE WHEN fold_id >= 0 AND suppkey % 21 = 8 AND flag = 'A' THEN (fold_id + 1) % 5 ELSE fold_id END AS f FROM marked WHERE kept AND temporal_label >= 0), range(5) r(k))
    SELECT 'shared_participant' AS rule_id, fold, concat_ws('/', dataset_id, participant_id) AS key FROM role GROUP BY fold, dataset_id, participant_id HAVING count(DISTINCT role) > 1
    UNION ALL SELECT 'single_class', fold, role FROM role GROUP BY fold, role HAVING count(DISTINCT temporal_label) < 2""",
)
def dq_16(t):
    """Some A recordings are moved one fold on, away from the participant's other ones."""
    s = F.substring("participant_id", 2, 20).cast("long")
    moved = (F.col("fold_id") >= 0) & (s % 21 == 8) & F.col("recording_id").endswith("_A")
    windows = t.kept.withColumn("fold_id", F.when(moved, (F.col("fold_id") + 1) % 5).otherwise(F.col("fold_id")))
    roles = folds.assign_roles(windows.filter("temporal_label >= 0"))
    return quality.role_leaks(roles).select("rule_id", *longs("fold"), "key")


@query(
    "dq_15_run_completeness",
    ctes("thr") + f"""SELECT {JL}, fold = 3 AS in_metrics_only FROM thr WHERE (fold = 3 AND seed = 3889) OR (fold = 1 AND recipe = 'natural')""",
)
def dq_15(t):
    """Two result tables that each miss some jobs of the plan."""
    plan = stored_thresholds(t).select("model_id", "recipe", "fold", "seed")
    metrics = plan.filter("not (fold = 1 and recipe = 'natural')").withColumn("a", F.lit(True))
    parity = plan.filter("not (fold = 3 and seed = 3889)").withColumn("b", F.lit(True))
    keys = ["model_id", "recipe", "fold", "seed"]
    both = plan.join(metrics, keys, "full").join(parity, keys, "full").filter("a is null or b is null")
    return both.select("model_id", "recipe", *longs("fold", "seed"), F.col("b").isNull().alias("in_metrics_only"))


@query(
    "dq_17_one_threshold_per_job",
    ctes("alm") + f"""SELECT {JL}, count(DISTINCT v) AS thresholds FROM (SELECT model_id, recipe, fold, seed,
      CASE WHEN fold = 2 AND alarm_policy_id LIKE 'two%' THEN threshold + 1 ELSE threshold END AS v FROM alm JOIN thr USING ({J})) GROUP BY model_id, recipe, fold, seed HAVING count(DISTINCT v) <> 1""",
)
def dq_17(t):
    """Alarm rows of fold 2 carry a second threshold for some policies."""
    from motionframe.operators.alarms import policy_rows
    from motionframe.plans.metric_queries import ALL_POLICIES

    rows = policy_rows(stored_thresholds(t), ALL_POLICIES)
    other = (F.col("fold") == 2) & F.col("policy").startswith("two")
    value = F.when(other, F.col("threshold") + 1).otherwise(F.col("threshold"))
    counts = rows.withColumn("v", value).groupBy("model_id", "recipe", "fold", "seed").agg(F.count_distinct("v").alias("thresholds"))
    return counts.filter("thresholds <> 1").select("model_id", "recipe", *longs("fold", "seed"), "thresholds")


@query(
    "dq_19_publication_manifest",
    ctes("thr") + f"""SELECT {JL}, rule_id FROM (SELECT *, unnest(list_filter([CASE WHEN fold = 4 AND seed = 3889 THEN 'bad_digest' END, CASE WHEN fold = 0 AND recipe = 'natural' THEN 'bad_size' END,
      CASE WHEN model_id = 'impact_rule' THEN 'unsafe_path' END], lambda x: x IS NOT NULL)) AS rule_id FROM thr)""",
)
def dq_19(t):
    """File list of a run's job artifacts, with three kinds of faults."""
    c = F.col
    digest = canonical_digest({k: c(k).cast("string") for k in ("model_id", "recipe", "fold", "seed")})
    files = stored_thresholds(t).withColumns(
        {
            "dataset_id": F.concat_ws("/", "model_id", "recipe", c("fold").cast("string"), c("seed").cast("string")),
            "path": F.concat(F.when(c("model_id") == "impact_rule", "/abs/").otherwise("jobs/"), F.substring(digest, 1, 16), F.lit(".parquet")),
            "sha256": F.when((c("fold") == 4) & (c("seed") == 3889), F.lit("none")).otherwise(digest),
            "size_bytes": F.when((c("fold") == 0) & (c("recipe") == "natural"), 0).otherwise(10),
            "sequences": F.lit(1), "rows": F.lit(1), "annotations": F.lit(0),
            "evaluation_role": F.lit("result"),
        }
    )
    found = quality.manifest_entries(files, ("result",)).join(files.select("dataset_id", "model_id", "recipe", "fold", "seed"), "dataset_id")
    return found.select("model_id", "recipe", *longs("fold", "seed"), "rule_id")


@query(
    "dq_21_holdout_readiness",
    ctes("seqs") + "SELECT dataset_id, count(DISTINCT participant_id) AS participants, count(DISTINCT participant_id) >= 3 AS ready FROM seqs GROUP BY 1",
)
def dq_21(t):
    counts = t.sequences.groupBy("dataset_id").agg(F.count_distinct("participant_id").alias("participants"))
    return counts.withColumn("ready", F.col("participants") >= 3)
