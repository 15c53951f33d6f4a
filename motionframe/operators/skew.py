"""Ordered work that must not put one hot key into one task.

A sequence, job or participant may hold a third of all rows. The helpers here split
such a key by an ordered *chunk* (a coarse function of the order column), do the
window work per (key, chunk) and add the totals of the earlier chunks. Only the
chunk totals, a table of one row per key and chunk, are ever ordered per key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# A key is split once it has more rows than one task should sort.
HOT_ROWS = 5_000_000


def offsets_before(
    df: DataFrame, keys: Sequence[str], chunk: str, sums: dict[str, Column], whole: dict[str, Column] | None = None
) -> DataFrame:
    """Per (key, chunk): totals of all earlier chunks of the key, and of ``whole`` over all its
    chunks. Reduced map-side."""
    whole = whole or {}
    totals = df.groupBy(*keys, chunk).agg(*[F.sum(c).alias(n) for n, c in {**sums, **whole}.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, chunk, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.sum(n).over(Window.partitionBy(*keys)).alias(n) for n in whole],
    )


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    hot: Column | None = None,
) -> DataFrame:
    """Zero-based position of every row inside its key.

    ``chunk`` must be non-decreasing in ``order``. Keys up to ``hot_rows`` rows are
    numbered by one window, so their rows are exchanged once; larger ones go their own way,
    per chunk plus the counts of earlier chunks. There are at most rows/hot_rows hot keys,
    a list short enough to broadcast. A caller that already knows the size of a key passes
    ``hot`` and saves the count.
    """
    if hot is None:
        large = F.broadcast(df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys))
        cold, split = df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")
    else:
        known = F.coalesce(hot, F.lit(False))
        cold, split = df.filter(~known), df.filter(known)
    whole = Window.partitionBy(*keys).orderBy(*order)
    numbered = cold.withColumn(name, F.row_number().over(whole).cast("long") - 1)
    chunked = split.withColumn("_chunk", chunk)
    offsets = offsets_before(chunked, keys, "_chunk", {"_before": F.lit(1).cast("long")})
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    placed = (
        chunked.withColumn("_local", F.row_number().over(local).cast("long") - 1)
        .join(offsets.hint("merge"), [*keys, "_chunk"], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
    )
    return numbered.unionByName(placed.select(*numbered.columns))


BLOCK_ROWS = 4096


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    columns: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: Column | None = None,
) -> DataFrame:
    """Add ``prev_<column>``: the value in the row before, inside the key.

    Rows are numbered, cut into blocks, and the last row of a block is repeated at the
    head of the next one; each task then needs one block only.
    """
    placed = ordered_positions(df, keys, order, chunk, "_pos", hot_rows, hot)
    block = F.floor(F.col("_pos") / BLOCK_ROWS)
    edge = F.col("_pos") % BLOCK_ROWS == BLOCK_ROWS - 1
    repeated = placed.withColumn(
        "_block", F.explode(F.when(edge, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    added = repeated.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})
    return added.filter(block == F.col("_block")).drop("_block", "_pos")
