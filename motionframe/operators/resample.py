"""Linear interpolation of irregular series to a regular grid."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.operators.sampling import numbered
from motionframe.operators.skew import HOT_ROWS, ordered_positions, with_previous

BLOCK = 4096


def segments(
    series: DataFrame, keys: Sequence[str], values: Sequence[str], chunk: Column, hot_rows=HOT_ROWS
) -> DataFrame:
    """Each sample with its successor: columns ``rel``, ``next_rel`` and ``next_<value>``.

    ``rel`` is the time since the key's first sample. Rows are cut into blocks by
    position and the first row of a block is repeated in the one before, so no task
    holds a whole long series.
    """
    first = series.groupBy(*keys).agg(F.min("t").alias("_t0"))
    timed = series.join(first, list(keys)).withColumn("rel", F.col("t") - F.col("_t0"))
    placed = ordered_positions(timed, keys, [F.col("rel")], chunk, "_pos", hot_rows)
    block = F.floor(F.col("_pos") / BLOCK)
    edge = (F.col("_pos") % BLOCK == 0) & (F.col("_pos") > 0)
    repeated = placed.withColumn(
        "_block", F.explode(F.when(edge, F.array(block, block - 1)).otherwise(F.array(block)))
    )
    order = Window.partitionBy(*keys, "_block").orderBy("_pos")
    following = {f"next_{v}": F.lead(v).over(order) for v in ("rel", *values)}
    return repeated.withColumns(following).filter(block == F.col("_block")).drop("_block")


def resample(
    series: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rate_hz: float,
    chunk: Column,
    hot_rows=HOT_ROWS,
) -> DataFrame:
    """Grid rows (keys, k, rel, values) at ``k / rate``, never after the last sample.

    Every grid point belongs to one segment, so interpolation needs no as-of join: a
    segment emits the points inside it, a block of them at a time, so that a long gap is
    never one array. ``t`` is the time in seconds.
    """
    parts = segments(series, keys, values, chunk, hot_rows)
    low = F.floor(F.col("rel") * rate_hz)
    high = F.when(F.col("next_rel").isNull(), low + 1).otherwise(F.ceil(F.col("next_rel") * rate_hz))
    sized = parts.withColumns({"_low": low, "_many": high - low + 1})
    points = numbered(sized, F.col("_many"), "_step", BLOCK).withColumn("k", F.col("_low") + F.col("_step")).withColumn(
        "grid", F.col("k") / F.lit(float(rate_hz))
    )
    inside = (F.col("grid") >= F.col("rel")) & F.when(
        F.col("next_rel").isNull(), F.col("grid") <= F.col("rel") + 1e-12
    ).otherwise(F.col("grid") < F.col("next_rel"))

    def at(v):
        slope = (F.col(f"next_{v}") - F.col(v)) / (F.col("next_rel") - F.col("rel"))
        return F.when(F.col("next_rel").isNull(), F.col(v)).otherwise(
            slope * (F.col("grid") - F.col("rel")) + F.col(v)
        )

    return points.filter(inside).select(
        *keys, "k", F.col("grid").alias("rel"), *[at(v).alias(v) for v in values]
    )


def bad_timestamps(
    series: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], hot_rows=HOT_ROWS
) -> DataFrame:
    """Rows whose time is not finite or not above the time of the row before them.

    ``order`` is the arrival order; ``chunk`` a non-decreasing function of it.
    """
    checked = with_previous(series, keys, order, chunk, ["t"], hot_rows)
    finite = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs(F.col("t")) < float("inf"))
    rule = F.when(~finite, "not_finite").when(F.col("prev_t") >= F.col("t"), "not_increasing")
    return checked.withColumn("rule_id", rule).filter("rule_id is not null").drop("prev_t")
