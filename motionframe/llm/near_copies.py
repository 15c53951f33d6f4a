"""The near-copy stage: wide SimHash fingerprints through the anchors of operator 9, links verified.

Texts are near copies when the sets of their five-word shingles (A-Z in lower case, fewer words:
the whole sequence) have a Jaccard similarity of 0.8 or more. Two such sets differ in up to
``APART`` = 15.2 % of their SimHash bits, ten of 64, too many for the contract of operator 9. So

* a set has a fingerprint of as many bits as blocks need. A block is as wide as the logarithm of
  the number of rows, so an anchor holds some 16 homes however large the corpus is, and there are
  as many blocks as bring the chance that some block differs in one bit at most to ``FOUND``;
* rows meet at the anchors of every block as in operator 9. A row is copied only to anchors
  above its own home: of two rows the one with the smaller home goes to the other;
* rows that meet are candidates if ``FIRST`` further words of 64 bits differ in at most as many bits
  as ``allowed`` says (99 % of the pairs at a similarity of 0.8, one in ten million of unlike ones);
* candidates are verified exactly, by their sets of shingles (64-bit digests).

A group of n near copies has n * n links, which are never put out. First every cell of an anchor
puts out a spanning forest of its candidates, the rows nearest to all others as its centres, and
these edges are verified. Where all edges of a family of candidates hold, its rows are one group
and no further link matters. Only families with a false edge are met again, and then all their
candidates between groups that are still apart are verified, so no link found is lost. There
``SECOND`` words, drawn from the sets that the first verification has made, decide who is a candidate:
in a crowd of texts at similarities of 0.5 to 0.75 most pairs pass two words and few pass sixteen.

Of each group of verified links the row with the smallest doc_id stays (null is larger than any
other, then the smallest digest of the text). Equal sets are one node from the start. Cases: null,
empty and blank texts have no words and are equal; no rows give no rows; repeated rows are copies;
other columns keep their values whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common, simhash, tokens

WORDS = 5
#: Near copies have at least PART / WHOLE of their joint shingles in common.
PART, WHOLE = 4, 5
#: Share of the bits that differ at this similarity (sets of one size): the angle by pi.
APART = math.acos(2 * PART / (PART + WHOLE)) / math.pi
FOUND = 0.95
FIRST, SECOND = 2, 16
SEED = 42
CHUNK = 1 << 15
PLACE = 48
MEMBER, HOME = 1, 2


def shape(rows):
    """(bits of a block, blocks) for so many rows."""
    width = max(simhash.CODED, math.ceil(math.log2(max(2, rows))))
    one = (1 - APART) ** width + width * APART * (1 - APART) ** (width - 1)
    return width, math.ceil(math.log(1 - FOUND) / math.log(1 - one))


def allowed(n_words):
    """Bits of so many words in which candidates may differ: 2.6 deviations above the mean at 0.8."""
    n = 64 * n_words
    return math.ceil(n * APART + 2.6 * math.sqrt(n * APART * (1 - APART)))


def checks(n_words):
    """Names of the columns with the words that are compared."""
    return [f"c{k}" for k in range(1, n_words + 1)]


def shingles(text, n_words=WORDS):
    """Sorted distinct 64-bit digests of the shingles of a text (bytes)."""
    import xxhash

    found = text.translate(simhash.LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(n_words, len(found))
    digest = xxhash.xxh64_intdigest
    made = [digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return np.unique(np.array(made, np.uint64))


def _mixed(values, salt):
    """Other 64-bit hashes of the values: a multiply and shift mix after adding the salt."""
    x = values + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bits(found, n_words):
    """The SimHash of a set of digests as 64 * n_words bits."""
    sums = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK]
        for k in range(n_words):
            drawn = np.unpackbits(_mixed(part, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums[64 * k : 64 * k + 64] += drawn.sum(0, dtype=np.int64)
    return 2 * sums > len(found)


def _described(width, n_blocks):
    """mapInArrow function: the text gives way to the node, two words to check, and the blocks."""
    import xxhash

    n_words = FIRST + math.ceil(width * n_blocks / 64)
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def one(text):
        found = shingles(text)
        drawn = bits(found, n_words)
        check = np.packbits(drawn[: 64 * FIRST]).view(">u8").astype(np.uint64)
        blocks = drawn[64 * FIRST : 64 * FIRST + width * n_blocks].reshape(n_blocks, width) @ weights
        return np.r_[np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)), check, blocks.astype(np.uint64)]

    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                texts = pc.fill_null(some.column("text").cast(pa.large_binary()), b"")
                made = np.stack([one(t.as_py()) for t in texts]).view(np.int64)
                blocks = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * n_blocks, pa.array(made[:, 1 + FIRST :].ravel()))
                columns = [some.column("doc_id"), some.column("sha"), *(pa.array(made[:, k].copy()) for k in range(1 + FIRST)), blocks]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "node", *checks(FIRST), "blocks"])

    return run


def _sketched(batches):
    """mapInArrow function: the words for the second meeting from the sets of shingles."""
    for batch in batches:
        if len(batch):
            found = (np.asarray(x.values).view(np.uint64) for x in batch.column("shingles"))
            made = np.stack([np.packbits(bits(x, SECOND)).view(">u8").astype(np.int64) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(c.copy()) for c in made.T)], ["node", *checks(SECOND)])


def _placed(width, n_words=FIRST):
    """mapInArrow function: a node at its home in each block, and at the anchors above that it reaches.
    A place is the number of the block and the anchor in one."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            blocks = np.array(batch.column("blocks").flatten()).view(np.uint64).reshape(len(batch), -1)
            carried = ["node", *checks(n_words), "root"]
            own = [batch.column(c).to_numpy() for c in carried]
            for k in range(blocks.shape[1]):
                rows, anchor, home = simhash.anchors(blocks[:, k], width)
                above = home | (anchor > anchor[: len(batch)][rows])  # homes come first, row by row
                rows, place, home = rows[above], (anchor[above] | np.uint64(k << PLACE)).view(np.int64), home[above]
                made = [place, home, *(c[rows] for c in own)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["place", "home", *carried])

    return run


def _distances(homes, members):
    """Differing bits of the words of every home and member; rows are (node, words, group)."""
    apart = np.zeros((len(homes), len(members)), np.uint16)
    for k in range(1, homes.shape[1] - 1):
        apart += np.bitwise_count(homes[:, k, None] ^ members[None, :, k])
    return apart


def forest(homes, members):
    """Candidate pairs that span all candidates between ``homes`` and ``members``: homes with the
    nearest neighbourhoods come first, and each reaches into groups it is not yet part of."""
    step, most = max(1, (1 << 20) // max(1, len(members))), allowed(homes.shape[1] - 2)
    parts = range(0, len(homes), step)
    closeness = [np.maximum(most + 1 - _distances(homes[a : a + step], members).astype(np.int64), 0).sum(1) for a in parts]
    homes = homes[np.argsort(-np.concatenate(closeness), kind="stable")]
    nodes = np.unique(np.r_[homes[:, 0], members[:, 0]])
    label = np.arange(len(nodes))
    of_home, of_member = np.searchsorted(nodes, homes[:, 0]), np.searchsorted(nodes, members[:, 0])
    found = []
    for a in parts:
        apart = _distances(homes[a : a + step], members)
        for k in np.flatnonzero((apart <= most).any(1)):
            near = np.flatnonzero(apart[k] <= most)
            near = near[np.argsort(apart[k][near], kind="stable")]
            groups, first = np.unique(label[of_member[near]], return_index=True)
            own = label[of_home[a + k]]
            fresh = groups != own
            if fresh.any():
                found += [(homes[a + k, 0], members[near[f], 0]) for f in first[fresh].tolist()]
                label[np.isin(label, groups[fresh])] = own
    return found


def between(homes, members):
    """All candidate pairs of two groups."""
    found = []
    step, most = max(1, (1 << 20) // max(1, len(members))), allowed(homes.shape[1] - 2)
    for a in range(0, len(homes), step):
        part = homes[a : a + step]
        h, m = np.nonzero((_distances(part, members) <= most) & (part[:, -1, None] != members[None, :, -1]))
        found += zip(part[h, 0].tolist(), members[m, 0].tolist())
    return found


def _pairs(pick, n_words):
    """mapInArrow function over rows sorted by cell: a cell may span batches."""

    def run(batches):
        held_key, homes, members = None, [], []

        def finish():
            h, m = np.concatenate(homes), np.concatenate(members)
            found = pick(h, m) if len(h) and len(m) else []
            if len(found):
                both = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both.max(1)), pa.array(both.min(1))], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("place", "part")])
            rows = np.stack([batch.column(c).to_numpy() for c in ("node", *checks(n_words), "root")], axis=1).view(np.uint64)
            role = batch.column("role").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), len(rows)]
            for a, b in zip(edges, edges[1:]):
                own = tuple(key[:, a])
                if own != held_key:
                    if held_key is not None:
                        yield from finish()
                    held_key, homes, members = own, [], []
                homes.append(rows[a:b][(role[a:b] & HOME) > 0])
                members.append(rows[a:b][(role[a:b] & MEMBER) > 0])
        if held_key is not None:
            yield from finish()

    return run


def candidates(spark, nodes, width, pick, cell=simhash.CELL, n_words=FIRST):
    """Distinct pairs (a, b) of ``pick`` over the cells of all anchors of ``nodes`` (node, c1, c2, ..., blocks, root).

    An anchor with more than ``cell`` rows is dealt out as a matrix of parts, homes by members."""
    carried = ["node", *checks(n_words), "root"]
    schema = "place long, home boolean, " + ", ".join(f"{c} long" for c in carried)
    placed = nodes.select(*carried, "blocks").mapInArrow(_placed(width, n_words), schema)
    sizes = placed.groupBy("place").agg(F.count("*").alias("members"), F.count_if("home").alias("homes"))
    parts = lambda n: F.ceil(F.greatest(n, F.lit(1)) / cell)
    large = common.written(spark, sizes.filter(F.col("members") > cell).select("place", parts("members").alias("n_j"), parts("homes").alias("n_i")), "near-large")
    own, n_i, n_j = F.xxhash64("node"), F.col("n_i"), F.col("n_j")
    many = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda i, j, role: F.struct((i * n_j + j).alias("part"), role.cast("byte").alias("role"))
    as_member = F.transform(many(n_i), lambda i: spot(i, F.pmod(own, n_j), F.lit(MEMBER)))
    as_home = F.transform(many(n_j), lambda j: spot(F.pmod(own, n_i), j, F.lit(HOME)))
    whole = F.struct(F.lit(0).cast("long").alias("part"), F.when(F.col("home"), MEMBER | HOME).otherwise(MEMBER).cast("byte").alias("role"))
    roles = F.when(n_j.isNull(), F.array(whole)).when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)
    dealt = placed.join(large, "place", "left").select("place", *carried, F.inline(roles))
    ordered = dealt.repartition("place", "part").sortWithinPartitions("place", "part")
    return ordered.mapInArrow(_pairs(pick, n_words), "a long, b long").filter("a <> b").distinct()


def _sets(batches):
    for batch in batches:
        for some in tokens.slices(batch):
            texts = pc.fill_null(some.column("text").cast(pa.large_binary()), b"")
            made = [shingles(t.as_py()).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([some.column("node"), lists], ["node", "shingles"])


def shingle_sets(spark, pairs, nodes, texts):
    """(node, shingles) of the nodes of all pairs; ``nodes`` (node, sha), ``texts`` (sha, text)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "sha"), "node")
    once = texts.join(wanted, "sha").groupBy("node").agg(F.first("text").alias("text"))
    return common.written(spark, once.mapInArrow(_sets, "node long, shingles array<long>"), "near-sets")


def verified(pairs, sets):
    """The pairs whose sets of shingles (node, shingles) are similar."""
    side = lambda name, values: sets.select(F.col("node").alias(name), F.col("shingles").alias(values))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common_ones = F.size(F.array_intersect("x", "y"))
    both = both.withColumn("same", common_ones).withColumn("all", F.size("x") + F.size("y") - F.col("same"))
    return both.filter(F.col("same") * WHOLE >= F.col("all") * PART).select("a", "b")


def groups(spark, docs, cell=simhash.CELL):
    """(doc_id, sha, root) of every row of ``docs`` (doc_id, sha, text): rows of one root are
    joined by verified links."""
    width, n_blocks = shape(docs.count())
    described = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "sha", "text").mapInArrow(
        _described(width, n_blocks), f"doc_id long, sha string, node long, {', '.join(f'{c} long' for c in checks(FIRST))}, blocks array<long>"
    )
    rows = common.written(spark, described, "near-rows")
    same = [F.first(c).alias(c) for c in (*checks(FIRST), "blocks")]
    nodes = common.written(spark, rows.groupBy("node").agg(F.min("sha").alias("sha"), *same), "near-nodes")
    texts = docs.select("sha", "text")

    tried = common.written(spark, candidates(spark, nodes.withColumn("root", F.lit(0).cast("long")), width, forest, cell), "near-tried")
    sets = shingle_sets(spark, tried, nodes, texts)
    held = common.written(spark, verified(tried, sets), "near-held")
    failed = tried.join(held, ["a", "b"], "left_anti")
    families = common.written(spark, simhash.components(spark, tried), "near-families").toDF("node", "family")
    open_ones = failed.select(F.col("a").alias("node")).join(families, "node", "left").select(F.coalesce("family", "node").alias("family")).distinct()
    with_family = nodes.join(families, "node", "left").withColumn("family", F.coalesce("family", "node"))
    grouped = simhash.components(spark, held)
    again = with_family.join(open_ones, "family", "left_semi").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = common.written(spark, again.select("node", "blocks", "root"), "near-again")
    # every node of an open family was tried, so its set is there
    sketched = sets.join(again.select("node"), "node", "left_semi").mapInArrow(_sketched, "node long, " + ", ".join(f"{c} long" for c in checks(SECOND)))
    again = common.written(spark, again.join(sketched, "node"), "near-sketched")
    more = common.written(spark, candidates(spark, again, width, between, cell, SECOND).join(failed, ["a", "b"], "left_anti"), "near-more")
    # the further links join groups, so only roots go through the stars again
    side = lambda name: grouped.select(F.col("node").alias(name), F.col("root").alias(f"of_{name}"))
    further = verified(more, sets).join(side("a"), "a", "left").join(side("b"), "b", "left")
    further = further.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = simhash.components(spark, further).toDF("root", "last")
    rooted = rows.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.join(joined, "root", "left").select("doc_id", "sha", F.coalesce("last", "root").alias("root"))


def without_near_copies(spark, docs, cell=simhash.CELL):
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    made = groups(spark, docs.select("doc_id", "text", digest(F.col("text")).alias("sha")), cell)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("least")
    stay = made.groupBy("root").agg(least).select(F.col("least.doc_id").alias("stay"), F.col("least.sha").alias("stay_sha"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    same = F.col("whole.doc_id").cast("long").eqNullSafe(F.col("stay")) & (F.col("own") == F.col("stay_sha"))
    once = Window.partitionBy("stay", "stay_sha").orderBy("own")
    found = whole.withColumn("own", digest(F.col("whole.text"))).join(stay, same).withColumn("copy", F.row_number().over(once))
    return found.filter("copy = 1").select("whole.*")
