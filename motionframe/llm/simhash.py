"""SimHash near-duplicates by anchor points of a covering code (operator 9).

Fingerprints that differ in at most ``THRESHOLD`` = 4 of 64 bits differ in at most one bit of one
of the three blocks of 22, 21 and 21 bits. In a block the anchors are the words of a covering
code: a Hamming code on 15 of its bits and every value of the others, so each value is at most
one bit (the covering radius) from an anchor. A fingerprint is at home at its nearest anchor, and
it is copied to every anchor within radius plus one bit that can be home to a value one bit away,
some 14 of 131,072 or more: whatever lies within one bit of a fingerprint is among the copies at
that fingerprint's home. Homes are
compared with copies anchor by anchor. An anchor with many rows is dealt out as a matrix of cells,
``CELL`` homes by ``CELL`` copies, each a unit of work of its own. A cell puts out the edges of a
spanning forest of its links, so a large group costs rows in proportion to its members; the
components over all cells are found by alternating star joins in tables.

Equal fingerprints are one node from the start. Cases: null, empty and blank texts have the
fingerprint 0 and are linked like any other; fewer words than a shingle are one shingle; no rows
give no rows; repeated rows are nodes of one fingerprint; a null doc_id counts as larger than any
other, and a component of such rows alone has none.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from motionframe.llm import common, tokens

WORDS = 4
SEED = 42
THRESHOLD = 4
#: (lowest bit, bits) of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODED = 15
CELL = 4096
#: Anchors with more than a cell of rows that may be broadcast: some 5 MB.
SMALL_LIST = 100_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text, n_words=WORDS):
    """64-bit SimHash of one text as bytes (UTF-8)."""
    import xxhash

    found = text.translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(n_words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def _fingerprints(n_words):
    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                texts = pc.fill_null(some.column("text").cast(pa.large_binary()), b"")
                made = np.array([fingerprint(t.as_py(), n_words) for t in texts], np.uint64)
                names = [c for c in some.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(some.column, names), pa.array(made.view(np.int64))], [*names, "fp"])

    return run


def _syndrome(values):
    """Hamming syndrome of 15-bit values: the sum modulo 2 of the numbers of their set bits."""
    out = np.zeros(len(values), np.uint64)
    for bit in range(CODED):
        out ^= (values >> np.uint64(bit) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def _nearest(values):
    """The code word nearest to each 15-bit value."""
    s = _syndrome(values)
    return values ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0)).astype(np.uint64)


def anchors(values, width):
    """(row, anchor, home) of every anchor at home or home to a value one bit away, no row twice."""
    rows = np.arange(len(values))
    low = values & np.uint64((1 << CODED) - 1)
    high = values ^ low
    home = _nearest(low)
    found = [(rows, home | high, np.ones(len(rows), bool))]
    # one bit outside the code differs, and the code part is within its radius
    for bit in range(CODED, width):
        found.append((rows, home | (high ^ np.uint64(1 << bit)), np.zeros(len(rows), bool)))
    # two bits of the code part differ: for each first bit the second one follows from the syndrome
    s = _syndrome(low)
    for bit in range(CODED):
        other = s ^ np.uint64(bit + 1)
        pair = (other > bit + 1) & (s > 0)
        flipped = low[pair] ^ np.uint64(1 << bit) ^ (np.uint64(1) << (other[pair] - np.uint64(1)))
        found.append((rows[pair], flipped | high[pair], np.zeros(int(pair.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*found))


PLACED_SCHEMA = "block int, anchor int, fp long, home boolean"


def _placed(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for k, (lowest, width) in enumerate(BLOCKS):
            rows, anchor, home = anchors(fps >> np.uint64(lowest) & np.uint64((1 << width) - 1), width)
            made = [np.full(len(rows), k, np.int32), anchor.astype(np.int32), fps[rows].view(np.int64), home]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["block", "anchor", "fp", "home"])


def _counted(batches):
    """Rows and homes at each anchor, summed within an Arrow batch."""
    for some in _placed(batches):
        whole, home = some.column("anchor").to_numpy(), some.column("home").to_numpy(zero_copy_only=False)
        block = some.column("block")[0].as_py() if len(some) else 0
        anchor, back = np.unique(whole, return_inverse=True)
        made = [np.full(len(anchor), block, np.int32), anchor, np.bincount(back, minlength=len(anchor)), np.bincount(back, home, len(anchor)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["block", "anchor", "members", "homes"])


def forest(homes, members, threshold=THRESHOLD):
    """Edges (node, smaller node) that span the links between ``homes`` and ``members``."""
    nodes = np.unique(np.concatenate([homes, members]))
    label = np.arange(len(nodes))
    place = np.searchsorted(nodes, members)
    step = max(1, (1 << 20) // max(1, len(members)))
    for at in range(0, len(homes), step):
        part = homes[at : at + step]
        apart = np.bitwise_count(part[:, None] ^ members[None, :])
        near = apart <= threshold
        # a home is among the members in one cell of its anchor's matrix only
        for k in np.flatnonzero((near & (apart > 0)).any(1)):
            groups = np.unique(np.r_[label[place[near[k]]], label[np.searchsorted(nodes, part[k])]])
            if len(groups) > 1:
                label[np.isin(label, groups[1:])] = groups[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(threshold):
    """mapInArrow function over rows sorted by cell: a cell may span batches."""

    def run(batches):
        held_key, homes, members = None, [], []

        def finish():
            h, m = np.concatenate(homes), np.concatenate(members)
            if len(h) and len(m):
                a, b = forest(h, m, threshold)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "anchor", "i", "j")])
            fps = batch.column("fp").to_numpy().view(np.uint64)
            as_home = batch.column("as_home").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), len(fps)]
            for a, b in zip(edges, edges[1:]):
                own = tuple(key[:, a])
                if own != held_key:
                    if held_key is not None:
                        yield from finish()
                    held_key, homes, members = own, [], []
                h = as_home[a:b]
                homes.append(fps[a:b][h])
                members.append(fps[a:b][~h])
        if held_key is not None:
            yield from finish()

    return run


def links(spark, fps, threshold=THRESHOLD, cell=CELL):
    """Edges (a, b) between distinct fingerprints (column fp) that span all links."""
    if threshold // len(BLOCKS) > 1:
        raise ValueError("the blocks find differences in at most one bit of a block")
    sizes = fps.mapInArrow(_counted, "block int, anchor int, members long, homes long")
    sizes = sizes.groupBy("block", "anchor").agg(F.sum("members").alias("members"), F.sum("homes").alias("homes"))
    large = sizes.filter(F.col("members") > cell).select(
        "block", "anchor", F.ceil(F.col("members") / cell).cast("int").alias("n_j"), F.ceil(F.greatest("homes", F.lit(1)) / cell).cast("int").alias("n_i")
    )
    large = common.written(spark, large, "op9-large")
    large = F.broadcast(large) if large.count() <= SMALL_LIST else large
    placed = fps.mapInArrow(_placed, PLACED_SCHEMA).join(large, ["block", "anchor"], "left")
    n_i, n_j = F.coalesce("n_i", F.lit(1)), F.coalesce("n_j", F.lit(1))
    own = F.xxhash64("fp")
    many = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.transform(many(n_i), lambda i: F.struct(i.alias("i"), F.pmod(own, n_j).cast("int").alias("j"), F.lit(False).alias("as_home")))
    as_home = F.transform(many(n_j), lambda j: F.struct(F.pmod(own, n_i).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("as_home")))
    roles = F.when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)
    dealt = placed.select("block", "anchor", "fp", F.inline(roles))
    cells = ["block", "anchor", "i", "j"]
    ordered = dealt.repartition(*cells).sortWithinPartitions(*cells)
    return ordered.mapInArrow(_links(threshold), "a long, b long").distinct()


def components(spark, edges):
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it reaches.

    Alternating stars: every node's larger neighbours, then its smaller ones, are tied to its
    least neighbour, until nothing changes. Each round is written to a table."""
    current = common.written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "op9-edges")
    mark = None
    while True:
        both = current.union(current.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.written(spark, large, "op9-large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))))
        current = common.written(spark, small.filter("a <> b").distinct(), "op9-small-star")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def rooted(spark, docs, n_words=WORDS, threshold=THRESHOLD, cell=CELL):
    """The columns of ``docs`` (doc_id, text and more) without the text and with fp, and (fp,
    first, root) of every fingerprint: first is its smallest doc_id, root names its component."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    schema = ", ".join(["doc_id long", *[f"{f.name} {f.dataType.simpleString()}" for f in others], "fp long"])
    own = docs.select(F.col("doc_id").cast("long"), *[f.name for f in others], "text")
    rows = common.written(spark, own.mapInArrow(_fingerprints(n_words), schema), "op9-fingerprints")
    nodes = common.written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "op9-nodes")
    roots = components(spark, links(spark, nodes.select("fp"), threshold, cell))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rows, common.written(spark, named, "op9-roots")


def clusters(spark, docs, n_words=WORDS, threshold=THRESHOLD, cell=CELL):
    """doc_id, fingerprint, component_id of every row of ``docs`` (doc_id, text)."""
    rows, of_fp = rooted(spark, docs.select("doc_id", "text"), n_words, threshold, cell)
    named = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = rows.join(of_fp.join(named, "root").select("fp", "component_id"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
