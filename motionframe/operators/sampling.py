"""Reproducible sampling. Every draw is a hash of its key, never a random generator."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.constants import SEED, SEQ
from motionframe.functions.exprs import hash_draw
from motionframe.operators.skew import ordered_positions

DRAW_BLOCK = 10_000
PARTICIPANT = ("dataset_id", "participant_id")


def numbered(df: DataFrame, size, name: str, block: int = DRAW_BLOCK) -> DataFrame:
    """Repeat each row ``size`` times, numbered from 0, without one huge array.

    Blocks are spread over the cluster before they are expanded.
    """
    blocks = df.withColumn("_size", size.cast("long")).filter("_size > 0").withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / block)))
    )
    first = F.col("_b") * block
    return blocks.withColumn(
        name, F.explode(F.sequence(first, F.least(first + block, F.col("_size")) - 1))
    ).drop("_b", "_size")


def class_quotas(rows: DataFrame, by: Sequence[str], seed: int = SEED) -> DataFrame:
    """Draws per participant and class: equal shares of half the rows, the rest by hash."""
    groups = rows.groupBy(*by, "label", *PARTICIPANT).agg(F.count(F.lit(1)).alias("candidates"))
    totals = groups.groupBy(*by).agg(
        F.sum("candidates").alias("_n"), F.count_distinct("label").alias("_classes")
    )
    classes = groups.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_groups"))
    sized = groups.join(classes, [*by, "label"]).join(totals, list(by))
    half = F.floor(F.col("_n") / 2)
    target = F.when(F.col("label") == 0, half).otherwise(F.col("_n") - half)
    both = F.when(F.col("_classes") == 2, target).otherwise(
        F.raise_error(F.lit("balanced sampling needs both classes")).cast("long")
    )
    draw = hash_draw(seed, "quota", F.col("label"), *[F.col(p) for p in PARTICIPANT])
    ranked = ordered_positions(
        sized.withColumns({"_target": both, "_draw": draw}),
        [*by, "label"],
        [F.col(c) for c in ("_draw", *PARTICIPANT)],
        F.floor(F.col("_draw") / 1_048_576),
        "_rank",
        hot=F.lit(True),
    )
    extra = (F.col("_rank") < F.col("_target") % F.col("_groups")).cast("long")
    quota = F.floor(F.col("_target") / F.col("_groups")) + extra
    return ranked.select(*by, "label", *PARTICIPANT, "candidates", quota.alias("quota"))


def balanced_sample(
    rows: DataFrame, by: Sequence[str], seed: int = SEED, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Participant- and class-balanced resampling with replacement.

    ``rows`` holds (by, label, participant, seq, win). Each draw picks a candidate by
    number within its own group, so the join is on exact keys and a hot participant is
    spread by number. ``rows`` holds a window of a group once.
    """
    pool = rows.select(*by, "label", *PARTICIPANT, *seq, "win").distinct()
    members = [*by, "label", *PARTICIPANT]
    indexed = ordered_positions(
        pool, members, [F.col("win"), *[F.col(s) for s in seq]], F.floor(F.col("win") / 4096), "idx"
    )
    draws = numbered(class_quotas(rows, by, seed), F.col("quota"), "draw")
    pick = hash_draw(seed, "pick", *[F.col(b) for b in by], F.col("label"), *[F.col(p) for p in PARTICIPANT], F.col("draw"))
    chosen = draws.withColumn("idx", pick % F.col("candidates"))
    return chosen.join(indexed, [*members, "idx"]).select(*members, *seq, "win")


def recipe_audit(sample: DataFrame, by: Sequence[str], seq: Sequence[str] = SEQ) -> DataFrame:
    """Rows, unique windows, class sizes and participant-class groups of a training sample."""
    keys = [*by, "label", *PARTICIPANT]
    windows = sample.groupBy(*keys, *seq, "win").agg(F.count(F.lit(1)).alias("_m"))
    groups = windows.groupBy(*keys).agg(F.sum("_m").alias("_rows"), F.count(F.lit(1)).alias("_unique"))
    return groups.groupBy(*by).agg(
        F.sum("_rows").alias("windows"),
        F.sum("_unique").alias("unique_windows"),
        F.sum(F.when(F.col("label") == 1, F.col("_rows")).otherwise(0)).alias("positive_windows"),
        F.sum(F.when(F.col("label") == 0, F.col("_rows")).otherwise(0)).alias("negative_windows"),
        F.count(F.lit(1)).alias("participant_class_groups"),
    )


def limit_sequences(
    sequences: DataFrame, by: Sequence[str], limit: int, seed: int = SEED, seq: Sequence[str] = SEQ
) -> DataFrame:
    """At most ``limit`` sequences per group, shared between classes, refilled from the rest.

    Ranking keeps only the first ``limit`` rows per class, which Spark also applies
    before the exchange.
    """
    order = hash_draw(seed, "limit", *[F.col(s) for s in seq])
    ranked = sequences.withColumn("_h", order).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*by, "is_fall").orderBy("_h", *seq))
    )
    top = ranked.filter(F.col("_rank") <= limit)
    sizes = sequences.groupBy(*by).agg(
        F.count_distinct("is_fall").alias("_classes"),
        F.count(F.when(~F.col("is_fall"), 1)).alias("_n0"),
        F.count(F.when(F.col("is_fall"), 1)).alias("_n1"),
    )
    base, rest = F.floor(F.lit(limit) / F.col("_classes")), F.lit(limit) % F.col("_classes")
    first_class = F.when(F.col("_n0") > 0, False).otherwise(True)
    share = base + F.when((F.col("is_fall") == first_class) & (rest > 0), 1).otherwise(0)
    other = F.when(F.col("is_fall"), F.col("_n0")).otherwise(F.col("_n1"))
    other_share = base + F.when((F.col("is_fall") != first_class) & (rest > 0), 1).otherwise(0)
    # What the other class leaves unused refills this one.
    spare = F.greatest(F.lit(0), F.when(F.col("_classes") == 2, other_share - other).otherwise(0))
    kept = top.join(sizes, list(by)).filter(F.col("_rank") <= share + spare)
    return kept.drop("_h", "_rank", "_classes", "_n0", "_n1")
