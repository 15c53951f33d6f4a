"""Causal sliding windows on a half-up start grid.

Window ``k`` of a sequence starts at ``floor(k * stride * rate + 0.5)`` and spans
``length`` samples; its decision sample is its last one.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.constants import (
    CHANNELS,
    GRAVITY,
    SAMPLING_RATE_HZ,
    SEQ,
    STRIDE_SECONDS,
    WINDOW_LENGTH,
)
from motionframe.functions.exprs import norm

# Windows are processed in blocks of this many, so a long recording spreads over tasks.
BLOCK_WINDOWS = 256


def start_of(win: Column, stride_s: float = STRIDE_SECONDS, rate: float = SAMPLING_RATE_HZ):
    return F.floor(win * F.lit(stride_s * rate) + 0.5).cast("int")


def start_grid(
    sequences: DataFrame,
    seq: Sequence[str] = SEQ,
    n: str = "n",
    keep: Sequence[str] = (),
    length: int = WINDOW_LENGTH,
    stride_s: float = STRIDE_SECONDS,
    rate: float = SAMPLING_RATE_HZ,
) -> DataFrame:
    """All complete windows of each sequence: (seq, win, start_sample, end_sample).

    The windows of a sequence are generated in blocks spread over the cluster, so one
    very long sequence neither builds a huge array nor stays in one task.
    """
    last = F.col(n) - length
    top = F.floor((last / rate) / stride_s + 1e-12).cast("long")
    blocks = (
        sequences.filter(F.col(n) >= length)
        .select(*seq, n, *[k for k in keep if k not in (*seq, n)], top.alias("_top"))
        .withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.floor(F.col("_top") / BLOCK_WINDOWS)))
        )
    )
    first = F.col("_block") * BLOCK_WINDOWS
    final = F.least(first + BLOCK_WINDOWS - 1, F.col("_top"))
    wins = F.explode(F.sequence(first.cast("int"), final.cast("int")))
    grid = (
        blocks.withColumn("win", wins)
        .withColumn("start_sample", start_of(F.col("win"), stride_s, rate))
        .withColumn("end_sample", F.col("start_sample") + length)
    )
    kept = grid.filter(F.col("end_sample") <= F.col(n))
    extra = [k for k in keep if k not in seq]
    return kept.select(*seq, *extra, "win", "start_sample", "end_sample")


def reach_of(idx: Column, length: int, step: float) -> tuple[Column, Column]:
    """First and last window that may hold a sample."""
    return F.greatest(F.lit(0), F.floor((idx - length) / step)).cast("long"), F.ceil(idx / step).cast("long")


def blocked_samples(
    samples: DataFrame,
    seq: Sequence[str] = SEQ,
    values: Sequence[str] = CHANNELS,
    length: int = WINDOW_LENGTH,
    stride_s: float = STRIDE_SECONDS,
    rate: float = SAMPLING_RATE_HZ,
) -> DataFrame:
    """Samples with the ``block`` of windows that contain them; those at an edge go to two.

    That is one exchange of about 1.02 times the samples.
    """
    low, high = reach_of(F.col("sample_idx"), length, stride_s * rate)
    blocks = F.sequence(F.floor(low / BLOCK_WINDOWS), F.floor(high / BLOCK_WINDOWS))
    return samples.select(*seq, "sample_idx", *values).withColumn("block", F.explode(blocks)).repartition(*seq, "block")


def window_samples(
    samples: DataFrame,
    seq: Sequence[str] = SEQ,
    values: Sequence[str] = CHANNELS,
    length: int = WINDOW_LENGTH,
    stride_s: float = STRIDE_SECONDS,
    rate: float = SAMPLING_RATE_HZ,
    differences: Sequence[str] = (),
) -> DataFrame:
    """Long form of the windows: one row per (seq, window, position).

    Each sample goes to the block of windows that contain it; only the samples at a
    block edge go to two. That is one exchange of about 1.02 times the samples. The
    four-fold expansion into windows happens after it, inside the task, and a later
    ``groupBy(seq, block, win)`` is already partitioned for. ``differences`` adds
    ``d_<name>``, the step from the previous sample.
    """
    step = stride_s * rate
    idx = F.col("sample_idx")
    low, high = reach_of(idx, length, step)
    placed = blocked_samples(samples, seq, values, length, stride_s, rate)
    if differences:
        previous = Window.partitionBy(*seq, "block").orderBy("sample_idx")
        placed = placed.withColumns(
            {f"d_{d}": F.col(d) - F.lag(d).over(previous) for d in differences}
        )
    first = F.greatest(low, F.col("block") * BLOCK_WINDOWS)
    final = F.least(high, F.col("block") * BLOCK_WINDOWS + BLOCK_WINDOWS - 1)
    spread = F.when(first <= final, F.sequence(first.cast("int"), final.cast("int")))
    pos = idx - start_of(F.col("win"), stride_s, rate)
    rows = (
        placed.withColumn("win", F.explode(spread))
        .withColumn("pos", pos.cast("int"))
        .filter(F.col("pos").between(0, length - 1))
    )
    for d in differences:
        rows = rows.withColumn(f"d_{d}", F.when(F.col("pos") > 0, F.col(f"d_{d}")))
    return rows


def add_norms(df: DataFrame) -> DataFrame:
    """Signals 7 and 8: acceleration and angular-velocity magnitude."""
    return df.withColumns({"acc_norm": norm("ax", "ay", "az"), "gyr_norm": norm("gx", "gy", "gz")})


def complete_windows(rows: DataFrame, aggregates, seq=SEQ, length: int = WINDOW_LENGTH):
    """Aggregate each window; the incomplete one at the end of a sequence is dropped."""
    return (
        rows.groupBy(*seq, "block", "win")
        .agg(F.count(F.lit(1)).alias("_n"), *aggregates)
        .filter(F.col("_n") == length)
        .drop("_n", "block")
    )


def impact_scores(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Rule score per window: relative acceleration excursion plus peak rotation in turns/s."""
    rows = add_norms(window_samples(samples, seq))
    parts = complete_windows(
        rows,
        [
            (F.max(F.abs(F.col("acc_norm") - GRAVITY)) / GRAVITY).alias("acc_part"),
            (F.max("gyr_norm") / F.lit(6.283185307179586)).alias("gyr_part"),
        ],
        seq,
    )
    return parts.withColumn("impact_score", F.col("acc_part") + F.col("gyr_part"))
