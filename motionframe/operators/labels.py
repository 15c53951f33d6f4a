"""Event pairing and decision-time labels.

Every rule of the labelling protocol is a test of the decision sample ``e`` against a
half-open interval, so all rules share one lookup:

* label 1: ``onset <= e < stop`` of an event
* excluded: ``start <= e < stop + length - 1`` of an exclude interval (any overlap)
* tail: ``stop <= e < stop + length - 1`` of an event (its end is still in the window)

Intervals are cut into time buckets and joined on (seq, bucket); no sequence ever has
all its windows paired with all its intervals.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.constants import SEQ, WINDOW_LENGTH

BUCKET = 512


def bucketed(intervals: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """One row per time bucket an interval ``[low, high)`` touches."""
    return intervals.filter(F.col(low) < F.col(high)).withColumn(
        "bucket",
        F.explode(
            F.sequence(F.floor(F.col(low) / BUCKET), F.floor((F.col(high) - 1) / BUCKET))
        ),
    )


def bucket_of(column: str):
    return F.floor(F.col(column) / BUCKET)


def pair_points(annotations: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Each onset with the number of matching activities and impacts, and their bounds."""
    keys = [*seq, "code"]
    of_kind = lambda kind: annotations.filter(F.col("kind") == kind)
    onsets = of_kind("onset").select(*keys, F.col("start_sample").alias("onset"))
    activities = of_kind("activity").select(
        *keys, F.col("start_sample").alias("onset"), F.col("stop_sample").alias("stop")
    )
    matched = (
        onsets.join(activities.filter("stop > onset"), [*keys, "onset"], "left")
        .groupBy(*keys, "onset")
        .agg(F.count("stop").alias("activities"), F.max("stop").alias("stop"))
    )
    impacts = of_kind("impact").select(*keys, F.col("start_sample").alias("impact"))
    inside = bucketed(matched.filter("activities = 1"), "onset", "stop").join(
        impacts.withColumn("bucket", bucket_of("impact")), [*keys, "bucket"]
    )
    inside = inside.filter("impact > onset and impact < stop")
    found = inside.groupBy(*keys, "onset").agg(
        F.count("impact").alias("impacts"), F.min("impact").alias("impact")
    )
    return matched.join(found, [*keys, "onset"], "left").withColumn(
        "impacts", F.coalesce("impacts", F.lit(0))
    )


def pair_events(annotations: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Events (onset, impact, stop, code): exactly one activity and one impact each.

    An onset that pairs otherwise fails, as its windows would pass for negatives;
    ``unpaired_points`` lists such onsets beforehand.
    """
    paired = pair_points(annotations, seq)
    told = F.concat_ws(" ", F.lit("onset without exactly one activity and impact:"), *seq, F.col("onset").cast("string"), "code")
    one = (F.col("activities") == 1) & (F.col("impacts") == 1)
    stop = F.when(one, F.col("stop")).otherwise(F.raise_error(told).cast("long"))
    return paired.select(*seq, "onset", "impact", stop.alias("stop"), "code")


def unpaired_points(annotations: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Onsets without exactly one activity and impact, and impacts not used exactly once."""
    points = pair_points(annotations, seq)
    onsets = points.filter("activities <> 1 or impacts <> 1").select(
        *seq, F.lit("onset_unpaired").alias("rule_id"), F.col("onset").alias("sample"), "code"
    )
    used = (
        bucketed(points.filter("activities = 1").select(*seq, "code", "onset", "stop"), "onset", "stop")
    )
    impacts = (
        annotations.filter(F.col("kind") == "impact")
        .select(*seq, "code", F.col("start_sample").alias("sample"))
        .withColumn("bucket", bucket_of("sample"))
    )
    uses = (
        impacts.join(used, [*seq, "code", "bucket"], "left")
        .groupBy(*seq, "code", "sample")
        .agg(F.count(F.when((F.col("sample") > F.col("onset")) & (F.col("sample") < F.col("stop")), 1)).alias("uses"))
        .filter("uses <> 1")
    )
    return onsets.unionByName(
        uses.select(*seq, F.lit("impact_unpaired").alias("rule_id"), "sample", "code")
    )


def decision_intervals(
    events: DataFrame,
    annotations: DataFrame,
    seq: Sequence[str] = SEQ,
    length: int = WINDOW_LENGTH,
) -> DataFrame:
    """(seq, rule, lo, hi): decision samples to which each labelling rule applies."""
    tail = length - 1
    hits = events.select(
        *seq,
        F.explode(
            F.array(
                F.struct(F.lit("hit").alias("rule"), F.col("onset").alias("lo"), F.col("stop").alias("hi")),
                F.struct(F.lit("tail").alias("rule"), F.col("stop").alias("lo"), (F.col("stop") + tail).alias("hi")),
            )
        ).alias("i"),
    ).select(*seq, "i.*")
    excluded = annotations.filter(F.col("kind") == "exclude").select(
        *seq,
        F.lit("exclude").alias("rule"),
        F.col("start_sample").alias("lo"),
        (F.col("stop_sample") + tail).alias("hi"),
    )
    return hits.unionByName(excluded)


def mark_windows(
    windows: DataFrame,
    events: DataFrame,
    annotations: DataFrame,
    seq: Sequence[str] = SEQ,
    length: int = WINDOW_LENGTH,
) -> DataFrame:
    """Add ``hit``, ``excluded`` and ``tail`` flags to every window.

    The intervals of one (seq, bucket) become one row, so the join adds no rows; an
    array holds at most the distinct intervals that touch 512 samples.
    """
    lookup = (
        bucketed(decision_intervals(events, annotations, seq, length))
        .groupBy(*seq, "bucket")
        .agg(F.collect_set(F.struct("rule", "lo", "hi")).alias("_rules"))
    )
    decided = windows.withColumn("_e", F.col("end_sample") - 1).withColumn("bucket", bucket_of("_e"))
    joined = decided.join(lookup, [*seq, "bucket"], "left")

    def holds(rule):
        test = F.exists(
            "_rules", lambda i: (i["rule"] == rule) & (F.col("_e") >= i["lo"]) & (F.col("_e") < i["hi"])
        )
        return F.coalesce(test, F.lit(False))

    flags = {"hit": holds("hit"), "excluded": holds("exclude"), "tail": holds("tail")}
    return joined.withColumns(flags).drop("_rules", "_e", "bucket")


def label_windows(marked: DataFrame) -> DataFrame:
    """Labels and drop flags; needs ``supervision_kind`` and ``is_fall`` on each window.

    Temporal sequences: 1 inside an event, else 0; windows touching an exclude interval
    and negatives still holding an event tail are dropped. Recording-supervised ones:
    0 for a non-fall recording, -1 (unknown) for a fall.
    """
    temporal = F.col("supervision_kind") == "temporal"
    label = F.when(temporal, F.col("hit").cast("int")).otherwise(
        F.when(F.col("is_fall"), -1).otherwise(0)
    )
    post = temporal & ~F.col("excluded") & ~F.col("hit") & F.col("tail")
    return marked.withColumns(
        {
            "temporal_label": label.cast("int"),
            "bag_label": F.col("is_fall").cast("int"),
            "drop_excluded": temporal & F.col("excluded"),
            "drop_post": post,
            "kept": ~((temporal & F.col("excluded")) | post),
        }
    )
