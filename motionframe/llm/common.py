"""Helpers shared by the operators of this package: words, shared tables, running sums, joins."""

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than the space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark):
    """The folder that the driver and all executors see, as the cluster names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root.rstrip("/")


def new_path(spark, name):
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def reread(spark, frame, path):
    return spark.read.schema(frame.schema).parquet(path)


def written(spark, frame, name):
    """Write a table to the shared folder and read it back: lineage ends there, so a lost
    executor costs at most a re-read."""
    path = new_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return reread(spark, frame, path)


def kept(spark, frame, path):
    """As ``written``, in a place that the caller names, to be dropped when it is done."""
    frame.write.option("compression", "zstd").parquet(path)
    return reread(spark, frame, path)


def dropped(spark, path):
    """Remove a table of this run that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def words(text):
    """Array of the words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def word_count(text):
    """Number of words, without building them where there are none."""
    return F.size(words(text)).cast("long")


def let(value, body):
    """``body(value)`` with the value computed once per row, though the body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(*keys):
    """Hash of the keys as a number in [0, 1): the same on every run and machine."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def running_sum(frame, keys, cell, order, value, name):
    """Add ``name``: the sum of ``value`` over the earlier rows of the same keys.

    ``cell`` is a column that grows with ``order`` and cuts a key into cells small enough for
    one task. Totals per cell are summed over the earlier cells of the key, then rows only
    within their cell: no task sees a whole key. A tie in ``order`` is broken by nothing else,
    so the caller passes an order that separates rows which differ.
    """
    whole = [F.col(k) for k in keys]
    sums = frame.groupBy(*keys, cell).agg(F.sum(value).alias("_cell_sum"))
    before = Window.partitionBy(*whole).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_cell_sum").over(before), F.lit(0).cast("long")).alias("_cell_start")
    names = {k: f"_of_{k}" for k in [*keys, cell]}
    starts = sums.select(*[F.col(k).alias(v) for k, v in names.items()], start)
    same = [F.col(k).eqNullSafe(F.col(v)) if k in keys else F.col(k) == F.col(v) for k, v in names.items()]
    joined = frame.join(starts, reduce(and_, same)).drop(*names.values())
    inside = Window.partitionBy(*whole, F.col(cell)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = F.col("_cell_start") + F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long"))
    return joined.withColumn(name, added).drop("_cell_start")
