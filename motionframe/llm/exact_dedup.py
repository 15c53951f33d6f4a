"""Exact duplicates by an extendible-hash index on shared files (operator 7).

The SHA-256 of a text gives its place: the first 60 bits are the key. The directory grows by
doubling: a bucket of more than ``BUCKET_KEYS`` keys is split by the next bit of the key until
it fits. The index is written by owner tasks, each of which holds a range of keys, that is whole
neighbouring buckets. Only one row a digest enters it, with its size and its last document, so
copies are folded before they are shuffled.

Equal digests are not taken on trust: the texts of every digest with more rows are compared byte
for byte with the head of its chain, and those that differ form the next link, until none is left.

Cases: null counts as empty, so nulls and empty texts are one group; rows that repeat doc_id and
text are copies, one of which stays; a null doc_id is smaller than any other; no rows give no
rows. A text is one value of a row, however long.
"""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common

BUCKET_KEYS = 4096
KEY_BITS = 60
#: Bits that the directory is deeper than an even spread of the keys asks for.
SPARE_BITS = 4


def digested(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))


def _prefix(bits):
    return F.shiftright(F.col("key"), KEY_BITS - bits)


def directory(keys, n_keys, bucket_keys=BUCKET_KEYS):
    """Bucket of every key prefix of the deepest level: (prefix, depth, bucket), and that level.

    A prefix belongs to the shallowest bucket on its path that is not overfull."""
    bits = max(0, math.ceil(math.log2(max(1, n_keys / bucket_keys)))) + SPARE_BITS
    while True:
        counts = keys.groupBy(_prefix(bits).alias("prefix")).agg(F.count("*").alias("n"))
        paths = counts.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
        paths = paths.withColumn("bucket", F.expr(f"shiftright(prefix, {bits} - depth)"))
        filled = paths.groupBy("depth", "bucket").agg(F.sum("n").alias("filled"))
        fits = paths.join(filled, ["depth", "bucket"]).groupBy("prefix").agg(F.min(F.when(F.col("filled") <= bucket_keys, F.col("depth"))).alias("depth"))
        if bits >= KEY_BITS - SPARE_BITS or not fits.filter("depth is null").head(1):
            depth = F.coalesce("depth", F.lit(bits))
            return fits.select("prefix", depth.alias("depth"), F.expr(f"shiftright(prefix, {bits} - coalesce(depth, {bits}))").alias("bucket")), bits
        bits += SPARE_BITS


def build_index(spark, entries, bucket_keys=BUCKET_KEYS):
    """Write the index of ``entries`` (row, doc_id, sha): one row a digest, by bucket."""
    key = F.conv(F.substring("sha", 1, KEY_BITS // 4), 16, 10).cast("long")
    last = F.max(F.struct("doc_id", "row")).alias("last")
    keys = entries.groupBy("sha").agg(F.count("*").alias("n"), last).withColumn("key", key)
    keys = common.written(spark, keys, "op7-keys")
    buckets, bits = directory(keys, keys.count(), bucket_keys)
    index = keys.withColumn("prefix", _prefix(bits)).join(buckets, "prefix").drop("prefix")
    start = F.expr(f"shiftleft(bucket, {KEY_BITS} - depth)")
    index = index.withColumn("range_start", start).repartitionByRange("range_start").sortWithinPartitions("range_start", "key", "sha")
    return common.written(spark, index, "op7-index")


def collisions(spark, docs, index):
    """Rows whose text differs from the head of their digest's chain: (sha, doc_id, chain > 0)."""
    several = index.filter("n > 1").select("sha")
    waiting = common.written(spark, digested(docs).join(several, "sha", "left_semi"), "op7-copies")
    found, chain = None, 0
    while True:
        heads = waiting.groupBy("sha").agg(F.max_by("text", F.struct("doc_id", "text")).alias("head"))
        heads = common.written(spark, heads, "op7-heads")  # read anew, so that a hot digest's copies can be split
        rest = common.written(spark, waiting.join(heads, "sha").filter("text <> head").drop("head"), "op7-rest")
        if not rest.head(1):
            return found
        chain += 1
        differ = rest.select("sha", "doc_id").distinct().withColumn("chain", F.lit(chain))
        found = differ if found is None else found.unionByName(differ).groupBy("sha", "doc_id").agg(F.max("chain").alias("chain"))
        waiting = rest


def duplicates(spark, docs, bucket_keys=BUCKET_KEYS):
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    entries = digested(docs).select("doc_id", "sha", F.monotonically_increasing_id().alias("row"))
    entries = common.written(spark, entries, "op7-entries")
    index = build_index(spark, entries, bucket_keys)
    apart = collisions(spark, docs, index)
    if apart is None:
        groups = index.select("sha", "n", "last")
        rows = entries.join(groups, "sha")
    else:
        apart = apart.withColumnRenamed("doc_id", "of").withColumnRenamed("sha", "by")
        same = (entries["sha"] == apart["by"]) & entries["doc_id"].eqNullSafe(apart["of"])
        linked = entries.join(apart, same, "left").select("doc_id", "sha", "row", F.coalesce("chain", F.lit(0)).alias("chain"))
        groups = linked.groupBy("sha", "chain").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
        rows = linked.join(groups, ["sha", "chain"])
    return rows.select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def without_copies(spark, docs):
    """The rows of ``docs`` that stay, with all their columns, whatever these are called."""
    stay = duplicates(spark, docs).filter("kept").select(F.col("doc_id").alias("stay"), F.col("text_sha256").alias("stay_sha"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    own = F.sha2(F.coalesce(F.col("whole.text"), F.lit("")).cast("binary"), 256)
    same = F.col("whole.doc_id").cast("long").eqNullSafe(F.col("stay")) & (F.col("own") == F.col("stay_sha"))
    once = Window.partitionBy("stay", "stay_sha").orderBy("own")
    rows = whole.withColumn("own", own).join(stay, same).withColumn("copy", F.row_number().over(once))
    return rows.filter("copy = 1").select("whole.*")
