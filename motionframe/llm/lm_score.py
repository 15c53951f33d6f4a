"""Language-model scores by cross-entropy difference (operator 3).

Two bigram models, one of a target collection and one of the whole corpus (the background), are
matched: they share one vocabulary, one order and one smoothing, so their losses differ by the
counts alone. A document scores the mean over its words of target loss less background loss, in
nats: below zero, the words are likelier in the target.

Both models hold every word and every pair of neighbours of the corpus, as written tables that
grow with it: nothing of them is gathered on the driver or in a task. Texts are cut into slices of
some megabytes, one row each: its documents, its distinct words and the word at each place. Every
word of the corpus gets a number by a join. A slice then sends each of its distinct pairs once, as
sorted codes of two numbers dealt by hash to buckets of some ``SPLIT`` words of the corpus; a bucket
adds up the counts of a pair. Counts of words and of contexts are counts of pairs with the stand-in
``ANY``. A slice to be scored asks the buckets for the counts of its codes and gets them back in its
own order. A word or pair has one row a slice at most, so no key is frequent. A caller's
``vocabulary`` leaves the words from some count on, that many at most; all others, and words that
the models never saw, are one unknown word.

Cases: a null, empty or blank text has no words, a score of 0 and null losses; documents that the
target list repeats or that are missing do no harm; without any target the target model is the
smoothing alone; repeated rows and ties score alike up to the rounding of sums; no rows give no
rows; a null doc_id is never in the target. Words are numbered in 32 bits; more are refused.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from motionframe.llm import common, tokens

#: Frequent words that are paired by themselves: all.
PAIRED = None
#: Words of the corpus, on average, whose pairs go to one bucket.
SPLIT = 1 << 21
#: Share of the bigram estimate; the rest is the word's own frequency.
MIXED = 0.7
#: Added to every word's count.
ADDED = 0.5
#: Numbers of the unknown word, the beginning of a text and any word at all; words follow.
UNKNOWN, BEGIN, ANY = range(3)
FIRST = 3
GAPS = r"[\x20\x09-\x0D]+"
SLICE = "slice long, doc_id array<long>, sizes array<long>, n long"


def cut(texts):
    """Words of a batch, lower-cased, with the place of each document's first word."""
    # Lowered before the cast: of a slice that was cast, Arrow's kernel reads the wrong bytes.
    lowered = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    lists = pc.split_pattern_regex(lowered, GAPS)
    flat = lists.flatten()
    document = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    filled = pc.not_equal(flat, "")
    return flat.filter(filled), document[filled.to_numpy(zero_copy_only=False)]


def packed(numbers):
    """Numbers from 0 on as bytes: their lowest bytes, the next ones and so on, compressed."""
    wide = np.ascontiguousarray(numbers, "<u8")
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(wide), width], "<u4").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data):
    n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return wide.view("<u8")[:, 0].astype(np.int64)


def sealed(codes):
    """Sorted codes as bytes: the steps of their first numbers, then their second ones."""
    first = packed(np.diff(codes >> 32, prepend=0))
    return np.array([len(first)], "<u4").tobytes() + first + packed(codes & 0xFFFFFFFF)


def opened(data):
    size = 4 + int(np.frombuffer(data, "<u4", 1)[0])
    return np.cumsum(unpacked(data[4:size])) << 32 | unpacked(data[size:])


def _sliced(batches):
    """One row a slice: its documents with their numbers of words, its distinct words with their
    counts, and which of them stands at each place."""
    for batch in batches:
        for some in tokens.slices(batch):
            flat, document = cut(some.column("text"))
            code = pc.dictionary_encode(flat)
            if isinstance(code, pa.ChunkedArray):
                code = code.combine_chunks()
            places = code.indices.to_numpy().astype(np.int64)
            words = code.dictionary.cast(pa.string())
            columns = [
                [some.column("doc_id").to_pylist()],
                [np.bincount(document, minlength=len(some)).astype(np.int64)],
                [len(places)],
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                [np.bincount(places, minlength=len(words)).astype(np.int64)],
                [packed(places)],
            ]
            names = ["doc_id", "sizes", "n", "words", "counts", "places"]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), None, pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if k else c for c, k in zip(columns, kinds)], names)


def _coded(cut_slice, found):
    """Numbers of a slice's words and marks of its target documents, from what the joins found."""
    out = []
    place, number = (found.column(c).to_numpy() for c in ("place", "number"))
    for row in cut_slice.to_pylist():
        numbers, target = np.full(row["n_words"], UNKNOWN), np.zeros(len(row["doc_id"]), np.int64)
        numbers[place[number >= FIRST]] = number[number >= FIRST]
        target[place[number < FIRST]] = 1
        del row["n_words"]
        out.append(row | {"numbers": packed(numbers), "target": packed(target)})
    return pa.Table.from_pylist(out, _schema(cut_slice, "numbers", "target"))


def _schema(table, *more):
    fields = [f for f in table.schema if f.name != "n_words"]
    return pa.schema(fields + [pa.field(c, pa.binary()) for c in more])


class Pairs:
    """The distinct codes of a coded slice: pairs, words after any, contexts before any, all.

    ``of`` is the pair at each place, ``document`` its document; ``a`` and ``b`` are places of the
    two words of a pair in the counts of contexts and words; ``codes[order]`` go bucket by bucket,
    sorted within, and ``edges`` are where a bucket begins."""

    def __init__(self, row, buckets):
        sizes = np.array(row["sizes"], np.int64)
        self.document = np.repeat(np.arange(len(sizes)), sizes)
        names, own = np.unique(unpacked(row["numbers"]), return_inverse=True)
        self.n = len(names)
        places = own[unpacked(row["places"])]
        before = np.r_[self.n, places[:-1]][: len(places)]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.n
        pairs, self.of = np.unique(before * (self.n + 1) + places, return_inverse=True)
        self.a, self.b = np.divmod(pairs, self.n + 1)
        self.places, self.before = places, before
        heads = np.r_[names, BEGIN].astype(np.int64)
        joint = [heads[self.a] << 32 | heads[self.b], ANY << 32 | heads[: self.n], heads << 32 | ANY, [ANY << 32 | ANY]]
        self.codes = np.concatenate(joint).astype(np.int64)
        order = np.argsort(self.codes)
        bucket = (self.codes[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        bucket = (bucket % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        dealt = np.argsort(bucket, kind="stable")
        self.order = order[dealt]
        self.edges = np.searchsorted(bucket[dealt], np.arange(buckets + 1))

    def counts(self, chosen):
        """How often each code stands at the places that are chosen."""
        of = [(self.of, len(self.a)), (self.places, self.n), (self.before, self.n + 1)]
        return np.concatenate([np.bincount(x[chosen], minlength=k) for x, k in of] + [[chosen.sum()]])

    def dealt(self, *columns):
        """(bucket, sorted codes as bytes, the same part of each column as bytes)"""
        codes, columns = self.codes[self.order], [c[self.order] for c in columns]
        for k in np.flatnonzero(np.diff(self.edges)):
            part = slice(self.edges[k], self.edges[k + 1])
            yield int(k), sealed(codes[part]), *(packed(c[part]) for c in columns)


def _counted(buckets):
    """A slice's codes with their counts in all texts and in the target, one row a bucket."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                (row,) = batch.slice(k, 1).to_pylist()
                own = Pairs(row, buckets)
                chosen = unpacked(row["target"]).astype(bool)[own.document]
                made = zip(*own.dealt(own.counts(np.ones_like(chosen)), own.counts(chosen)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), *[pa.binary()] * 3))], ["bucket", "codes", "p0", "p1"])

    return run


def _added(rows):
    """The distinct codes of a bucket with the sums of their counts."""
    column = lambda c, read: np.concatenate([read(x) for x in rows.column(c).to_pylist()])
    codes, of = np.unique(column("codes", opened), return_inverse=True)
    sums = [np.bincount(of, weights=column(c, unpacked)).astype(np.int64) for c in ("p0", "p1")]
    made = [rows.column("bucket")[0].as_py(), sealed(codes), *map(packed, sums)]
    return pa.table({c: pa.array([x], t) for c, x, t in zip(("bucket", "codes", "p0", "p1"), made, (pa.int32(), *[pa.binary()] * 3))})


def _asked(buckets):
    """A slice's codes, one row a bucket."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                (row,) = batch.slice(k, 1).to_pylist()
                bucket, codes = zip(*Pairs(row, buckets).dealt())
                columns = [pa.array([row["slice"]] * len(bucket), pa.int64()), pa.array(bucket, pa.int32()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "bucket", "codes"])

    return run


def _answered(asked, held):
    """Counts of the codes that slices ask a bucket for, in their order; 0 where it has none."""
    read = (("codes", opened), ("p0", unpacked), ("p1", unpacked))
    codes, *sums = (f(held.column(c)[0].as_py()) if len(held) else np.zeros(0, np.int64) for c, f in read)
    codes = np.r_[codes, np.iinfo(np.int64).max]
    out = []
    for data in asked.column("codes"):
        wanted = opened(data.as_py())
        at = np.searchsorted(codes, wanted)
        hit = codes[at] == wanted
        out.append([packed(np.where(hit, np.r_[s, 0][at], 0)) for s in sums])
    columns = [asked.column("slice"), asked.column("bucket"), *(pa.array([x[k] for x in out], pa.binary()) for k in (0, 1))]
    return pa.Table.from_arrays(columns, ["slice", "bucket", "p0", "p1"])


def _judged(buckets, words):
    """Losses of the documents of a slice from the counts that it got back."""

    def run(coded, answers):
        made = {c: [] for c in ("doc_id", "n_words", "l0", "l1")}
        answers = answers.sort_by("bucket")
        for row in coded.to_pylist():
            own = Pairs(row, buckets)
            sizes = np.array(row["sizes"], np.int64)
            made["doc_id"] += row["doc_id"]
            made["n_words"] += row["sizes"]
            for k in (0, 1):
                counts = np.empty(len(own.codes))
                counts[own.order] = np.concatenate([unpacked(x) for x in answers.column(f"p{k}").to_pylist()])
                pair, word, context, total = np.split(counts, np.cumsum([len(own.a), own.n, own.n + 1]))
                alone = ((word + ADDED) / (total + ADDED * (words + 1)))[own.b]
                context = context[own.a]
                both = MIXED * pair / np.maximum(context, 1) + (1 - MIXED) * alone
                loss = -np.log(np.where(context > 0, both, alone))
                sums = np.bincount(own.document, weights=loss[own.of], minlength=len(sizes))
                made[f"l{k}"].extend(sums / np.maximum(sizes, 1))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(made.items(), kinds)})

    return run


class Models:
    """``terms``: word, number; ``pairs``: one row a bucket of codes with their counts in all texts
    (p0) and in the target (p1); ``buckets`` and ``words``: how many there are; ``coded``: the
    slices that the models were fitted on."""

    def __init__(self, terms, pairs, buckets, words, coded):
        self.terms, self.pairs, self.buckets, self.words, self.coded = terms, pairs, buckets, words, coded


def _level(n):
    """Counts in order, told apart below 4096 and to a 256th of a power of two above."""
    return F.when(n < 4096, n).otherwise(1024 + F.floor(F.log2(n.cast("double")) * 256)).cast("long")


def _listed(words, vocabulary):
    """The words from some count on, ``vocabulary`` at most."""
    leveled = words.withColumn("level", _level(F.col("n")))
    levels = {r["level"]: r["words"] for r in leveled.groupBy("level").agg(F.count("*").alias("words")).collect()}  # some 20,000 at most
    least, total = max(levels, default=0) + 1, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > vocabulary:
            break
        least = level
    return leveled.filter(F.col("level") >= least).drop("level")


def _numbered(spark, words):
    """word, number: from ``FIRST`` on, frequent words first as far as their part of the table goes,
    so that most numbers are small; and how many words there are."""
    ranked = words.sortWithinPartitions(F.desc("n"), "word").select("word", F.monotonically_increasing_id().alias("place"))
    placed = common.written(spark, ranked, "op3-terms")
    part, rank = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    parts, ranks, total = placed.agg(F.max(part) + 1, F.max(rank) + 1, F.count("*")).first()
    if (parts or 0) * (ranks or 0) >= (1 << 31) - FIRST:
        raise ValueError(f"{total} different words do not fit 32 bits")
    return placed.select("word", (rank * F.lit(parts or 1).cast("long") + part + FIRST).alias("number")), total


def _slices(spark, docs):
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(_sliced, "doc_id array<long>, sizes array<long>, n long, words array<string>, counts array<long>, places binary")
    path = common.new_path(spark, "op3-slices")
    return common.kept(spark, rows.withColumn("slice", F.monotonically_increasing_id()), path), path


def _known(spark, slices, terms, chosen=None):
    """The slices with the numbers of their words; documents of ``chosen`` are marked."""
    found = slices.select("slice", F.posexplode("words").alias("place", "word")).join(terms, "word").select("slice", "place", "number")
    if chosen is not None:
        marks = slices.select("slice", F.posexplode("doc_id").alias("place", "doc_id")).join(chosen, "doc_id")
        found = found.unionByName(marks.select("slice", "place", F.lit(0).cast("long").alias("number")))
    plain = slices.select("slice", "doc_id", "sizes", "n", "places", F.size("words").alias("n_words"))
    rows = plain.groupBy("slice").cogroup(found.withColumnRenamed("slice", "of").groupBy("of")).applyInArrow(_coded, f"{SLICE}, places binary, numbers binary, target binary")
    return common.written(spark, rows, "op3-coded")


def _size(slices):
    return slices.agg(F.sum("n")).first()[0] or 0


def fit(spark, docs, target_ids, vocabulary=None):
    """Count both models over the whole of ``docs`` (doc_id, text); ``target_ids`` has doc_id."""
    slices, path = _slices(spark, docs)
    words = slices.select(F.inline(F.arrays_zip("words", "counts"))).groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n"))
    terms, total = _numbered(spark, words if vocabulary is None else _listed(common.written(spark, words, "op3-words"), vocabulary))
    coded = _known(spark, slices, terms, target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    common.dropped(spark, path)
    buckets = max(1, -(-_size(coded) // SPLIT))
    sent = coded.mapInArrow(_counted(buckets), "bucket int, codes binary, p0 binary, p1 binary")
    pairs = sent.groupBy("bucket").applyInArrow(_added, "bucket int, codes binary, p0 binary, p1 binary")
    return Models(terms, common.written(spark, pairs, "op3-pairs"), buckets, total, coded)


def score_own(spark, models):
    """doc_id, n_words, target_loss, background_loss, score of every document that the models were fitted on."""
    return _scores(models.coded, models)


def score(spark, docs, models):
    """The same columns for every row of ``docs``."""
    slices, path = _slices(spark, docs)
    coded = _known(spark, slices, models.terms)
    common.dropped(spark, path)
    return _scores(coded, models)


def _scores(coded, models):
    parts = max(1, -(-_size(coded) // (SPLIT * models.buckets)))  # more texts than the models have: a bucket is met by parts of the slices
    part = F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int")
    asked = coded.mapInArrow(_asked(models.buckets), "slice long, bucket int, codes binary").withColumn("part", part)
    held = models.pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    answers = asked.groupBy("bucket", "part").cogroup(held.groupBy("bucket", "part")).applyInArrow(_answered, "slice long, bucket int, p0 binary, p1 binary")
    judged = _judged(models.buckets, models.words)
    losses = coded.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(judged, "doc_id long, n_words long, l0 double, l1 double")
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c))
    return losses.select("doc_id", "n_words", mean("l1").alias("target_loss"), mean("l0").alias("background_loss"), F.coalesce(mean("l1") - mean("l0"), F.lit(0.0)).alias("score"))
