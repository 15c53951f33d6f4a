"""Phrase collocations from FM-indexes over word ids (operator 12).

Texts are cut into pieces and these into words. A task gathers the pieces of a language into shards
of about ``SHARD`` words, numbers the words of a shard and stores its FM-index: the words, the
counts (the C array) and the Burrows-Wheeler transform over word numbers, each piece with its own
end mark, so nothing is found across pieces.

The transform is read in both directions: its stable sort is the step to the right in the text, the
inverse is the step to the left (the LF mapping). An n-gram is an interval of suffixes. Extending all
intervals to the left at once tells for each place the interval of the gram without its first word;
the gram without its last word is the interval it is nested in. So the intervals of depth n + 1 are
those of depth n split by what stands to the right, each with its count (its length), the gram it
extends to the right and the one it extends to the left. Shards are summed after each depth, and
the next depth goes only through grams that are frequent over all shards: an extension is never more
frequent than its parts.

Sums are ordinary aggregations over (gram, shard) rows; a gram has at most one row a shard. Frequent
words get numbers, so a pair is one 64-bit key, told exactly. The blobs of a shard and the frequent
grams of a shard meet by shard; both are bounded by the shard's size.

Cases: a null or blank text has no words; a null language is ``und``; a piece of one word has no
phrases; a very long text is cut between pieces into several shards; a very long piece is one
shard; repeated rows count each; ties go by phrase; no rows give no rows. Counts up to 10^15 are
exact (products are decimals of 38 digits).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common, tokens

#: Words of a shard, about.
SHARD = 1 << 21
#: Words that a task holds before it closes all its shards.
HELD = 1 << 22
LEAST = 10
COVER = 50
TOP = 2000
#: Frequent words that are numbered in one cell.
CELL = 10_000
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
LOWER = np.array([*range(65), *range(97, 123), *range(91, 256)], np.uint8)
KIND = np.array([2 if c in BREAKS else 1 if c in BLANKS else 0 for c in range(256)], np.uint8)
SHARD_SCHEMA = "shard long, lang string, words array<binary>, counts array<long>, n_pieces long, bwt binary"


def worded(texts):
    """Texts as (words of the slice, number of each word, words of each piece that has any)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    kind = KIND[data]
    inside = kind == 0
    begun = np.zeros(len(data) + 1, np.int64)  # breaks before each byte, ends of texts too
    np.cumsum(kind == 2, out=begun[1:])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = (starts[1:-1] - starts[0])[starts[1:-1] < starts[-1]]
    begins[edges] = inside[edges]
    begins = np.flatnonzero(begins)
    if not len(begins):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    piece = begun[begins] + np.searchsorted(edges, begins, side="right")
    sizes = np.add.reduceat(inside, begins, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = LOWER[data[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    coded = pc.dictionary_encode(words)
    heads = np.flatnonzero(np.r_[True, np.diff(piece) > 0])
    return coded.dictionary, coded.indices.to_numpy().astype(np.int32), np.diff(np.r_[heads, len(begins)])


def suffix_order(symbols, fixed):
    """Order of the suffixes of ``symbols``, by prefix doubling over those not yet told apart. The
    symbols under ``fixed`` are end marks, each there once, and one of them stands last."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = group
    several = ~(heads & np.r_[heads[1:], True])
    waiting, width = order[several], 1
    while len(waiting):
        key = rank[waiting] << 32 | rank[waiting + width]
        by = np.argsort(key, kind="stable")
        waiting, key = waiting[by], key[by]
        heads = np.r_[True, key[1:] != key[:-1]]
        base = key >> 32
        whole = np.r_[True, base[1:] != base[:-1]]
        place = np.arange(len(key))
        first = np.maximum.accumulate(np.where(whole, place, 0))
        rank[waiting] = base + np.maximum.accumulate(np.where(heads, place, 0)) - first
        waiting = waiting[~(heads & np.r_[heads[1:], True])]
        width *= 2
    out = np.empty(len(rank), np.int64)
    out[rank] = np.arange(len(rank))
    return out


def transform(numbers, pieces):
    """Burrows-Wheeler transform of pieces of word numbers, words counted from 1 and end marks 0."""
    ends = np.cumsum(pieces) + np.arange(len(pieces))
    symbols = np.empty(len(numbers) + len(pieces), np.int64)
    marks = np.zeros(len(symbols), bool)
    marks[ends] = True
    symbols[marks] = np.arange(len(pieces))
    symbols[~marks] = numbers + len(pieces)
    order = suffix_order(symbols, len(pieces))
    before = symbols[order - 1]  # the first piece follows the last end mark
    return np.where(before < len(pieces), 0, before - len(pieces) + 1).astype(np.uint32)


class Index:
    """FM-index of a shard, read in both directions."""

    def __init__(self, bwt, counts, n_pieces):
        self.n_pieces = n_pieces
        self.right = np.argsort(bwt, kind="stable")  # the suffix one word on, for every suffix
        self.first = np.concatenate([np.full(n_pieces, -1), np.repeat(np.arange(len(counts)), counts)])

    def extend(self, grams, step):
        """Intervals one word deeper. ``grams`` numbers the interval of each suffix at this depth, -1
        outside; ``step`` numbers what may stand to the right of its first word. Gives the numbers of
        the new intervals, and for each interval its count, the gram it extends to the right (without
        its last word) and the one it extends to the left (without its first)."""
        rest = step[self.right]
        inside = (grams >= 0) & (rest >= 0)
        place = np.flatnonzero(inside)
        left, right = grams[place], rest[place]
        heads = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(place)]
        number = np.full(len(grams), -1)
        number[place] = np.cumsum(heads) - 1
        starts = np.flatnonzero(heads)
        return number, np.diff(np.r_[starts, len(place)]), left[starts], right[starts]


def _closed(lang, parts, shard):
    """Shards of what was gathered of a language, cut between pieces; from ``shard`` on."""
    words = pc.dictionary_encode(pa.concat_arrays([p[0] for p in parts]))
    at, numbers = 0, []
    for own, number, _ in parts:
        numbers.append(words.indices.to_numpy()[at : at + len(own)][number])
        at += len(own)
    numbers, pieces = np.concatenate(numbers).astype(np.int64), np.concatenate([p[2] for p in parts])
    ends = np.cumsum(pieces)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SHARD, ends[-1], SHARD)) + 1, len(pieces)])
    for a, b in zip(cuts, cuts[1:]):
        some = numbers[ends[a] - pieces[a] : ends[b - 1]]
        own, number = np.unique(some, return_inverse=True)
        row = {
            "shard": [shard], "lang": [lang], "words": [words.dictionary.take(pa.array(own)).to_pylist()], "counts": [np.bincount(number)], "n_pieces": [b - a],
            "bwt": [zstandard.compress(transform(number, pieces[a:b]).tobytes(), 3)],
        }
        kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))
        shard += 1


def _indexed(batches):
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    held, sizes = {}, {}

    def close(lang):
        nonlocal shard
        sizes.pop(lang)
        for made in _closed(lang, held.pop(lang), shard):
            shard += 1
            yield made

    for batch in batches:
        for some in tokens.slices(batch):
            langs = pc.dictionary_encode(some.column("lang"))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                part = worded(some.column("text").filter(pc.equal(langs.indices, k)))
                if len(part[1]):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part[1])
            for lang in [x for x in sizes if sizes[x] >= SHARD or sum(sizes.values()) >= HELD]:
                yield from close(lang)
    for lang in list(sizes):
        yield from close(lang)


def indexes(spark, docs):
    """The FM-index of every shard of ``docs`` (text, lang), as a written table."""
    own = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return common.written(spark, own.mapInArrow(_indexed, SHARD_SCHEMA), "op12-index")


def _opened(row):
    counts = row.column("counts")[0].values.to_numpy()
    bwt = np.frombuffer(zstandard.decompress(row.column("bwt")[0].as_py()), np.uint32)
    return Index(bwt, counts, row.column("n_pieces")[0].as_py())


def _named(index, number, gram):
    """[suffix]: the global number of its first word, -1 where it is not frequent."""
    by_word = np.full(int(index.first.max()) + 2, -1)
    by_word[number] = gram
    return by_word[index.first]  # end marks read the last place


PAIRS = "shard long, pair long, n long"
TRIPLES = "first long, last long, n long"


def _pairs(shards, words):
    """Depth 2 in one shard: every pair of frequent words, both numbers in a key, with its count."""
    if not len(shards) or not len(words):
        return pa.table({c: pa.array([], pa.int64()) for c in ("shard", "pair", "n")})
    index = _opened(shards)
    named = _named(index, words.column("local").to_numpy(), words.column("word_id").to_numpy())
    _, n, left, right = index.extend(named, named)
    shard = np.full(len(n), shards.column("shard")[0].as_py())
    return pa.table({"shard": shard, "pair": left << 32 | right, "n": n})


def _triples(shards, pairs):
    """Depth 3 in one shard: the extensions of frequent pairs by frequent pairs, with the pair
    that each extends to the right and the one it extends to the left."""
    if not len(shards) or not len(pairs):
        return pa.table({c: pa.array([], pa.int64()) for c in ("first", "last", "n")})
    index = _opened(shards)
    local, word = (np.concatenate(x) for x in zip(*[_ids(pairs.column(c)) for c in ("words",)]))
    keys = np.sort(pairs.column("pair").drop_null().to_numpy())
    named = _named(index, local, word)
    number, _, left, right = index.extend(named, named)
    key = left << 32 | right
    place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
    frequent = keys[place] == key if len(keys) else np.zeros(len(key), bool)
    number = np.where(number >= 0, np.where(frequent, np.arange(len(key)), -1)[number], -1) if len(key) else number
    _, n, first, last = index.extend(number, number)
    return pa.table({"first": key[first], "last": key[last], "n": n})


def _ids(column):
    """Local and global numbers of words from rows that hold them as structs; others are null."""
    held = column.combine_chunks().drop_null()
    return held.field("local").to_numpy(), held.field("word_id").to_numpy()


def counted(spark, docs, least=LEAST):
    """Tables of all frequent words (lang, word, word_id, f), pairs (pair, f), triples (first, last,
    f), and the words of each language (lang, n)."""
    shards = indexes(spark, docs)
    places = shards.select("shard", "lang", F.posexplode("words").alias("local", "word"), "counts")
    places = places.select("shard", "lang", F.col("word").cast("string").alias("word"), F.col("local").cast("long").alias("local"), F.col("counts")[F.col("local")].alias("n"))
    places = common.written(spark, places, "op12-words")
    totals = places.groupBy("lang").agg(F.sum("n").alias("n"))
    words = places.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = common.written(spark, words, "op12-frequent")
    n_words = words.count()
    if n_words >= 1 << 31:
        raise ValueError("more frequent words than a pair's key can tell apart")
    cell = F.pmod(F.xxhash64("lang", "word"), F.lit(max(1, n_words // CELL)))
    words = common.running_sum(words.withColumn("cell", cell), [], "cell", ["lang", "word"], F.lit(1), "word_id").drop("cell")
    words = common.written(spark, words, "op12-numbered")
    known = places.join(words.select("lang", "word", "word_id"), ["lang", "word"]).select("shard", "local", "word_id")
    known = common.written(spark, known, "op12-known")

    n_shards = shards.count()
    tasks = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), n_shards // 8)
    by_shard = lambda frame: frame.repartition(tasks, "shard").groupBy("shard")
    blobs = shards.select("shard", "counts", "n_pieces", "bwt")
    found = by_shard(blobs).cogroup(by_shard(known)).applyInArrow(_pairs, PAIRS)
    sums = found.withColumn("f", F.sum("n").over(Window.partitionBy("pair"))).filter(F.col("f") >= least)
    found = common.written(spark, sums.select("shard", "pair", "f"), "op12-pairs")
    pairs = found.groupBy("pair").agg(F.max("f").alias("f"))

    word = F.struct("local", "word_id")
    steps = known.select("shard", word.alias("words"), F.lit(None).cast("long").alias("pair"))
    steps = steps.unionByName(found.select("shard", F.lit(None).cast("struct<local: bigint, word_id: bigint>").alias("words"), "pair"))
    triples = by_shard(blobs).cogroup(by_shard(steps)).applyInArrow(_triples, TRIPLES)
    triples = triples.groupBy("first", "last").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return words, common.written(spark, pairs, "op12-frequent-pairs"), common.written(spark, triples, "op12-triples"), totals


def _score(a, left, right):
    """floor(1,000,000 a a / (l r)), exact."""
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    return F.expr(f"cast(1000000 as decimal(7, 0)) * {wide(a)} * {wide(a)} div ({wide(left)} * {wide(right)})")


def candidates(words, pairs, triples):
    """Phrases of two and three words with a, and l, r and score of their lowest-scoring cut."""
    f = lambda frame, key, name: frame.select(F.col(key).alias(f"_{name}"), F.col("f").alias(name))
    head, tail = F.shiftright("pair", 32), F.col("pair").bitwiseAND((1 << 32) - 1)
    twos = pairs.select("pair", F.col("f").alias("a"), head.alias("w1"), tail.alias("w2"))
    twos = twos.join(f(words, "word_id", "l"), F.col("w1") == F.col("_l")).join(f(words, "word_id", "r"), F.col("w2") == F.col("_r"))
    twos = twos.select("pair", "a", "w1", "w2", "l", "r", _score("a", "l", "r").alias("score"))
    threes = triples.select(
        "first", "last", F.col("f").alias("a"), F.shiftright("first", 32).alias("w1"),
        F.shiftright("last", 32).alias("w2"), F.col("last").bitwiseAND((1 << 32) - 1).alias("w3"),
    )
    for frame, key, name, own in ((words, "word_id", "l1", "w1"), (pairs, "pair", "r1", "last"), (pairs, "pair", "l2", "first"), (words, "word_id", "r2", "w3")):
        threes = threes.join(f(frame, key, name), F.col(own) == F.col(f"_{name}")).drop(f"_{name}")
    cut = lambda k: F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    threes = threes.withColumn("cut", F.least(cut(1), cut(2)))
    return twos, threes.select("first", "last", "a", "w1", "w2", "w3", "cut.l", "cut.r", "cut.score")


def collocations(spark, docs, least=LEAST, cover=COVER, top=TOP):
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    words, pairs, triples, totals = counted(spark, docs, least)
    twos, threes = candidates(words, pairs, triples)
    inside = triples.select(F.explode(F.array("first", "last")).alias("_pair"), "f").groupBy("_pair").agg(F.max("f").alias("longest"))
    twos = twos.join(inside, F.col("pair") == F.col("_pair"), "left")
    twos = twos.filter(F.col("longest").isNull() | (100 * F.col("longest") < cover * F.col("a")))
    columns = ["w1", "w2", "w3", "a", "l", "r", "score"]
    both = twos.withColumn("w3", F.lit(None).cast("long")).select(*columns).unionByName(threes.select(*columns))
    name = lambda k: words.select(F.col("word_id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *(["lang"] if k == 1 else []))
    spelt = both.join(name(1), "w1").join(name(2), "w2").join(name(3), "w3", "left")
    spelt = spelt.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = common.written(spark, ranked, "op12-ranked")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


TWIN = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, phrase, len, count(*)::BIGINT AS f FROM (
    SELECT lang, k AS len, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM worded, range(1, 4) t(k) WHERE len(w) >= k) GROUP BY ALL),
frequent AS MATERIALIZED (SELECT * FROM grams WHERE f >= 10),
cuts AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w, k FROM frequent, range(1, 3) t(k) WHERE len > k),
scored AS (SELECT c.lang, c.phrase, c.len, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM cuts) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = c.head JOIN frequent r ON r.lang = c.lang AND r.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, part, max(f) AS longest FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
    FROM (SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE len = 3)) GROUP BY ALL),
left_over AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase WHERE i.longest IS NULL OR 100 * i.longest < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM left_over) JOIN n USING (lang) WHERE rank <= 2000
"""
