"""Data-quality rules. Each returns its violations; an empty result is a pass.

Rules report ``rule_id``, the key of the offending row and a detail, so that all
violations of a collection can be united in one table.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.constants import FOLD_COUNT, KIND_ORDER, SEQ, SUPERVISION_KINDS
from motionframe.operators.labels import pair_points, unpaired_points
from motionframe.operators.skew import with_previous

TEXT_FIELDS = ("dataset_id", "participant_id", "recording_id", "body_location", "activity_code")


def flagged(df: DataFrame, rules: dict[str, Column], keys: Sequence[str], *detail) -> DataFrame:
    """One row per (row, broken rule)."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.withColumn("rule_id", F.explode(hits)).select("rule_id", *keys, *detail)


def sequence_ranges(sequences: DataFrame, sample_counts: DataFrame) -> DataFrame:
    """Ranges of a dataset start at 0, touch each other and end at its sample count."""
    chunk = F.floor(F.col("sample_start") / 1_000_000)
    order = [F.col("sample_start"), F.col("sample_stop"), F.col("recording_id")]
    linked = with_previous(sequences, ["dataset_id"], order, chunk, ["sample_stop"])
    broken = flagged(
        linked,
        {
            "not_contiguous": F.col("sample_start") != F.coalesce("prev_sample_stop", F.lit(0)),
            "too_short": F.col("sample_stop") - F.col("sample_start") < 2,
        },
        ["dataset_id", "recording_id"],
        F.col("sample_start").alias("detail"),
    )
    ends = sequences.groupBy("dataset_id").agg(F.max("sample_stop").alias("_end"))
    uncovered = (
        ends.join(sample_counts, "dataset_id", "full")
        .filter("not (_end <=> samples)")
        .select(
            F.lit("not_covering").alias("rule_id"),
            "dataset_id",
            F.lit("").alias("recording_id"),
            F.col("_end").alias("detail"),
        )
    )
    return broken.unionByName(uncovered)


def source_rate(sequences: DataFrame) -> DataFrame:
    rate = F.col("source_sampling_rate_hz")
    valid = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    return flagged(sequences, {"rate_not_positive": ~valid}, ["recording_id"])


def text_fields(sequences: DataFrame) -> DataFrame:
    rules = {f"empty_{f}": F.coalesce(F.length(f), F.lit(0)) == 0 for f in TEXT_FIELDS}
    rules["unknown_supervision"] = ~F.col("supervision_kind").isin(*SUPERVISION_KINDS)
    return flagged(sequences, rules, ["participant_id", "sample_start"])


def annotation_bounds(
    annotations: DataFrame, sequences: DataFrame, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Known kind, non-empty code, start inside the sequence, valid point or interval."""
    sized = annotations.join(sequences.select(*seq, "n"), list(seq), "left")
    start, stop, n = F.col("start_sample"), F.col("stop_sample"), F.col("n")
    point = F.col("kind").isin("onset", "impact")
    rules = {
        "unknown_sequence": n.isNull(),
        "unknown_kind": ~F.col("kind").isin(*KIND_ORDER),
        "empty_code": F.length("code") == 0,
        "start_out_of_bounds": (start < 0) | (start >= n),
        "point_has_length": point & (start != stop),
        "bad_interval": ~point & ~((start < stop) & (stop <= n)),
    }
    return flagged(sized, rules, [*seq, "kind", "start_sample", "stop_sample"])


def annotation_order(annotations: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Rows (numbered ``row_idx`` per sequence) whose sort key is below that of the row before.

    Neighbours meet by an equi-join on the row number.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_ORDER.items()])
    key = F.struct(F.col("start_sample"), kind.alias("kind_order"), F.col("stop_sample"), F.col("code"))
    rows = annotations.select(*seq, "row_idx", key.alias("_key"))
    before = rows.select(*seq, (F.col("row_idx") + 1).alias("row_idx"), F.col("_key").alias("_prev"))
    return (
        rows.join(before, [*seq, "row_idx"])
        .filter("_key < _prev")
        .select(F.lit("not_sorted").alias("rule_id"), *seq, "row_idx")
    )


def temporal_coverage(
    annotations: DataFrame, sequences: DataFrame, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Activity and exclude intervals tile ``[0, n)`` of every temporal sequence."""
    temporal = sequences.filter("supervision_kind = 'temporal'").select(*seq, "n")
    spans = annotations.filter("kind in ('activity', 'exclude')").join(temporal, list(seq))
    chunk = F.floor(F.col("start_sample") / 65536)
    order = [F.col("start_sample"), F.col("stop_sample")]
    linked = with_previous(spans, seq, order, chunk, ["stop_sample"])
    gaps = linked.filter("start_sample <> coalesce(prev_stop_sample, 0)").select(
        F.lit("gap_or_overlap").alias("rule_id"), *seq, F.col("start_sample").alias("detail")
    )
    ends = spans.groupBy(*seq).agg(F.max(F.struct(*order))["stop_sample"].alias("_end"))
    short = (
        temporal.join(ends, list(seq), "left")
        .filter("coalesce(_end, 0) <> n")
        .select(F.lit("end_not_reached").alias("rule_id"), *seq, F.coalesce("_end", F.lit(0)).alias("detail"))
    )
    return gaps.unionByName(short)


def event_consistency(
    annotations: DataFrame, sequences: DataFrame, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Unpaired points, and temporal sequences whose fall flag disagrees with their events."""
    points = unpaired_points(annotations, seq).select("rule_id", *seq, F.col("sample").alias("detail"))
    paired = pair_points(annotations, seq).filter("activities = 1 and impacts = 1")
    counts = paired.groupBy(*seq).agg(F.count(F.lit(1)).alias("_events"))
    temporal = sequences.filter("supervision_kind = 'temporal'")
    events = F.coalesce("_events", F.lit(0))
    flags = (
        temporal.join(counts, list(seq), "left")
        .filter(F.col("is_fall") != (events > 0))
        .select(F.lit("fall_flag_mismatch").alias("rule_id"), *seq, events.cast("long").alias("detail"))
    )
    return points.unionByName(flags)


def count_mismatches(
    declared: DataFrame, observed: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Null-safe comparison of two keyed tables: one row per differing field or missing key."""
    a = declared.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_a"))
    b = observed.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_b"))
    both = a.join(b, list(keys), "full")
    checks = [
        F.when(
            ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")),
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"_a.{f}").alias("declared"),
                F.col(f"_b.{f}").alias("observed"),
            ),
        )
        for f in fields
    ]
    return both.withColumn("_m", F.explode(F.array_compact(F.array(*checks)))).select(*keys, "_m.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def split_coverage(folds: DataFrame, participants: DataFrame) -> DataFrame:
    """Duplicate assignments, participants missing on either side, folds outside 0..4."""
    keys = ["dataset_id", "participant_id"]
    row = lambda df, rule: df.select(F.lit(rule).alias("rule_id"), *keys)
    return (
        row(duplicates(folds, keys), "duplicate_assignment")
        .unionByName(row(participants.join(folds, keys, "left_anti"), "no_fold"))
        .unionByName(row(folds.join(participants, keys, "left_anti"), "no_data"))
        .unionByName(row(folds.filter(~F.col("fold_id").between(0, FOLD_COUNT - 1)), "bad_fold"))
    )


def malformed_ids(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(~F.col(column).rlike(pattern))


def store_integrity(windows: DataFrame, events: DataFrame, sequences: DataFrame, seq=SEQ, length=50):
    """Fixed window length, ordered event samples, events and windows of known sequences."""
    known = sequences.select(*seq)
    item = lambda df, rule, c: df.select(F.lit(rule).alias("rule_id"), *seq, F.col(c).cast("long").alias("detail"))
    return (
        item(windows.filter(F.col("end_sample") - F.col("start_sample") != length), "window_length", "win")
        .unionByName(item(windows.join(known, list(seq), "left_anti"), "window_orphan", "win"))
        .unionByName(item(events.filter("not (onset < impact and impact < stop)"), "event_order", "onset"))
        .unionByName(item(events.join(known, list(seq), "left_anti"), "event_orphan", "onset"))
    )


HEX64 = "^[0-9a-f]{64}$"
SAFE_PATH = r"^(?!/)(?!.*(^|/)\.\.(/|$))[A-Za-z0-9_.\-/]+$"


def manifest_entries(files: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Entry rules of a file manifest, plus ids and paths used more than once."""
    rules = {
        "bad_digest": ~F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False)),
        "unsafe_path": ~F.coalesce(F.col("path").rlike(SAFE_PATH), F.lit(False)),
        "bad_size": F.coalesce(F.col("size_bytes") <= 0, F.lit(True)),
        "bad_count": F.coalesce(F.least("sequences", "rows", "annotations") < 0, F.lit(True)),
        "bad_role": ~F.coalesce(F.col("evaluation_role").isin(*roles), F.lit(False)),
    }
    rows = flagged(files, rules, ["dataset_id", "path"])

    def twice(column, rule):
        repeated = files.join(duplicates(files, [column]).select(column), column, "left_semi")
        return repeated.select(F.lit(rule).alias("rule_id"), "dataset_id", "path")

    return rows.unionByName(twice("dataset_id", "duplicate_id")).unionByName(twice("path", "duplicate_path"))


def role_leaks(roles: DataFrame) -> DataFrame:
    """Participants in more than one role of a fold, and roles without both classes."""
    keys = ["fold", "dataset_id", "participant_id"]
    shared = (
        roles.groupBy(*keys)
        .agg(F.count_distinct("role").alias("_roles"))
        .filter("_roles > 1")
        .select(F.lit("shared_participant").alias("rule_id"), "fold", F.concat_ws("/", "dataset_id", "participant_id").alias("key"))
    )
    classes = (
        roles.groupBy("fold", "role")
        .agg(F.count_distinct("temporal_label").alias("_classes"))
        .filter("_classes < 2")
        .select(F.lit("single_class").alias("rule_id"), "fold", F.col("role").alias("key"))
    )
    return shared.unionByName(classes)


def summary(sequences: DataFrame, annotations: DataFrame, events: DataFrame, seq=SEQ) -> DataFrame:
    """Per dataset: sequences, samples, annotations, events, participants, falls, supervision."""
    notes = annotations.groupBy(*seq).agg(
        F.count(F.lit(1)).alias("_notes"), F.count(F.when(F.col("kind") == "activity", 1)).alias("_segments")
    )
    falls = events.groupBy(*seq).agg(F.count(F.lit(1)).alias("_events"))
    joined = sequences.join(notes, list(seq), "left").join(falls, list(seq), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("n").alias("rows"),
        total("_notes").alias("annotations"),
        total("_events").alias("events"),
        total("_segments").alias("segments"),
        F.count_distinct("participant_id").alias("participants"),
        F.count(F.when(F.col("is_fall"), 1)).alias("fall_sequences"),
        F.count(F.when(F.col("supervision_kind") == "temporal", 1)).alias("temporal_sequences"),
        F.count(F.when(F.col("supervision_kind") == "recording", 1)).alias("recording_sequences"),
    )
