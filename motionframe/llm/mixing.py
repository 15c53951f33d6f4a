"""Mixing sources to target weights by a low-discrepancy schedule (operator 8).

Slot n of the mix lies at the n-th van der Corput point in [0, 1); the cumulative weights of the
sources cut that interval, so every stretch of slots has every source near its share. Slots are
ranked within their source, and rank r takes block r (again from the first after the last) of
the source's documents in shuffled order: blocks of equal numbers of words, that may begin and
end inside a document. A source stops at its target, its last block cut short; where its points
came a few short, it gets the missing slots at the end (a van der Corput interval count is off by
the logarithm of the number of slots at most, so these are few).

Everything is a join or a sum over cells: running sums over documents and ranks over slots go
through ``common.running_sum``, so a source with a third of all rows is many cells.

Cases: a null or blank text has size 0 and is never taken; a null source is a source of its own,
the last; where all sizes are 0, all targets are 0; repeated rows are taken each; no rows give no rows.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common

#: Words of a block.
BLOCK = 1024
#: Rows of a cell in running sums.
CELL = 10_000
#: No document is taken more often.
MOST = 3


def source_targets(spark, sized, share=1.0, most=MOST):
    """One row a source: position, weight, source_size, target. The excess over ``most`` times
    the size is shared out again by weight until no source is above."""
    sizes = common.written(spark, sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "op8-sources")
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("position", position).withColumn("weight", F.col("position") % 3 + 1)
    ranked = common.written(spark, ranked, "op8-weights")
    room = F.lit(most) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:  # the level grows, and each round caps at least one source more
        capped = F.lit(level) * F.col("weight") >= room
        held, open_weight = ranked.agg(F.sum(F.when(capped, room)), F.sum(F.when(~capped, F.col("weight")))).first()
        raised = (share * total - (held or 0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.lit(max(level, 0.0)) * F.col("weight"), room.cast("double"))
    return ranked.withColumn("target", target)


def block_pieces(sized, sources):
    """Parts of documents that lie in each block of their source: source, block, key, low, high
    (words of the document from low to high - 1). Only documents with words have parts."""
    with_source = sized.filter("size > 0").join(sources.select("source", "source_size", "n_docs", "blocks"), sized["source"].eqNullSafe(sources["source"]))
    with_source = with_source.drop(sources["source"]).withColumn("at", common.unit(F.lit("shuffle"), "doc_id"))
    with_source = with_source.withColumn("cell", F.floor(F.col("at") * F.ceil(F.col("n_docs") / CELL)))
    placed = common.running_sum(with_source, ["source"], "cell", ["at", "doc_id", "size", "key"], F.col("size"), "begin")
    first, last = (F.expr(f"(cast({p} as decimal(38, 0)) * blocks - 1) div source_size") for p in ("begin + 1", "begin + size"))
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low, high = _edge("block"), _edge("block + 1")
    begin = F.col("begin")
    return cut.select(
        "source", "block", "key", "blocks", "source_size",
        F.greatest(low, begin).alias("low"), F.least(high, begin + F.col("size")).alias("high"),
    ).filter("low < high").select("source", "block", "key", (F.col("low") - low).alias("low"), (F.col("high") - low).alias("high"))


def _edge(block):
    """First word of a block: the source's words cut evenly, to the word."""
    return F.expr(f"cast({block} as decimal(38, 0)) * source_size div blocks")


def _corput(slot, bits):
    """The base-2 van der Corput point of each slot: its bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("double") / float(1 << bits)


def schedule(spark, sources, share=1.0):
    """The mix as rows (slot, source, rank, epoch, block, words): ``words`` of the block's first
    words are read, all but for a source's last block."""
    need = F.ceil(F.col("target") / F.col("source_size") * F.col("blocks"))
    sources = sources.filter("target >= 1 and source_size > 0").withColumn("quota", F.floor("target").cast("long"))
    sources = sources.withColumn("need", need)
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("target").over(Window.partitionBy())
    low = F.coalesce(F.sum("target").over(before), F.lit(0.0)) / total
    high = F.sum("target").over(Window.orderBy("position")) / total
    cuts = common.written(spark, sources.withColumn("low", low).withColumn("high", high), "op8-shares")
    slots, n_sources = cuts.agg(F.sum("need"), F.count("*")).first()
    slots = int(slots or 0)
    bits, cells = max(1, slots.bit_length()), 4 * (n_sources or 1)
    points = spark.range(slots).select(F.col("id").alias("slot"), _corput(F.col("id"), bits).alias("point"))
    points = points.withColumn("grid", F.floor(F.col("point") * cells))
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long"))
    spans = cuts.select("source", "position", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), last)).alias("grid"))
    top = F.when(F.col("high") >= 1, F.lit(2.0)).otherwise(F.col("high"))
    drawn = points.join(spans, "grid").filter((F.col("point") >= F.col("low")) & (F.col("point") < top))
    drawn = drawn.select("slot", "position", F.floor(F.col("slot") / CELL).alias("cell"))
    ranked = common.running_sum(drawn, ["position"], "cell", ["slot"], F.lit(1), "rank").select("slot", "position", "rank")
    got = ranked.groupBy("position").agg(F.count("*").alias("got"))
    short = cuts.join(got, "position", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = short.select(F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"), "position")
    late = late.select((F.col("rank") + slots).alias("slot"), "position", "rank")
    kept = ranked.unionByName(late).join(cuts, "position").filter("rank < need")
    kept = kept.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    left = F.col("quota") - F.col("epoch") * F.col("source_size") - _edge("block")
    read = F.least(_edge("block + 1") - _edge("block"), left)
    return kept.select("slot", "source", "rank", "epoch", "block", read.alias("words")).filter("words > 0")


def mix(spark, docs, block=BLOCK, share=1.0, most=MOST):
    """(schedule, parts of documents in each block, documents, sources). ``docs``: doc_id, source,
    size; a document is told by its ``key``, as doc_ids may repeat. It is given where there is none."""
    if "key" in docs.columns:
        sized = docs.select("doc_id", "source", "size", "key")
    else:
        sized = docs.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("key"))
    sized = common.written(spark, sized, "op8-sizes")
    sources = source_targets(spark, sized, share, most)
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)))
    sources = common.written(spark, sources, "op8-targets")
    return schedule(spark, sources, share), block_pieces(sized, sources), sized, sources


def taken_words(spark, docs, block=BLOCK, share=1.0, most=MOST):
    """doc_id, source, size, source_size, target, taken, key of each row of ``docs`` (doc_id, source, size)."""
    slots, pieces, sized, sources = mix(spark, docs, block, share, most)
    reads = slots.groupBy("source", "block", "words").agg(F.count("*").alias("times"))
    same = pieces["source"].eqNullSafe(reads["source"]) & (pieces["block"] == reads["block"])
    words = F.greatest(F.lit(0), F.least("high", "words") - F.col("low")) * F.col("times")
    taken = pieces.join(reads, same).groupBy("key").agg(F.sum(words).alias("taken"))
    rows = sized.join(taken, "key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    facts = sources.select(F.col("source").alias("of"), "source_size", "target")
    return rows.join(facts, rows["source"].eqNullSafe(facts["of"])).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "key"
    )


def mixed(spark, docs, block=BLOCK, share=1.0, most=MOST):
    """The mix at the grain of documents, with their columns, whatever these are called: each row as
    often as it is taken, a last time where at least half of it is."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("key"))
    whole = common.written(spark, whole, "op8-rows")
    sized = whole.select(F.col("whole.doc_id").cast("long").alias("doc_id"), "whole.source", common.word_count(F.col("whole.text")).alias("size"), "key")
    taken = taken_words(spark, sized, block, share, most).filter("taken > 0")
    times = taken.select("key", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).filter("times > 0")
    rows = whole.join(times, "key").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select("whole.*")
