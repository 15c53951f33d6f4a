"""Toxicity by subword-bag embeddings and a linear softmax (operator 2).

A word is the mean of the vectors of its character n-grams, a document the mean of its distinct words, and
a linear softmax over two classes reads the document. Vectors and softmax are trained together in
NumPy, so a spelling that no label showed still shares n-grams with those that were. As all of it
is linear up to the softmax, a trained model scores a word by one number per n-gram.

Training reads a bounded sample of labelled rows (``SAMPLE`` clean and toxic ones at most, the rows with
the smallest hash of their doc_id, texts up to ``LONGEST`` characters); scoring reads every whole
text in Arrow batches, each distinct word of a batch once.

Cases: null, empty and blank texts score by the bias alone; no labelled rows, or rows of one class
only, give a score of 0 or 1 throughout by that class (0 without any); repeated rows and ties score
alike; a label that is neither 0 nor 1 is not used; no rows give no rows; a null doc_id is not held out.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from motionframe.llm import common, tokens

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
#: Words whose n-grams are made in one step.
WORDS_AT_ONCE = 1 << 15
DIMENSION = 4
SAMPLE = (6000, 3000)
LONGEST = 50_000
#: Share of the sample's documents in whose words a bucket must occur; rarer ones stay zero, or
#: the model would learn single documents by heart.
LEAST_SHARE = 0.02
#: Steps of training, whatever the sample, and documents of a step.
STEPS = 420
BATCH = 256
RATE = 0.05
#: Factor on the mean of a document, so that few words among many can decide.
SHARPNESS = 64.0
#: Weight of a toxic row against one that is not.
TOXIC_WEIGHT = 2.0
#: Neutral words (zero vectors) added to every document, so that a few odd words don't decide alone.
PADDING = 200
DECAY = 1e-6
THRESHOLD = 0.3
EDGES = "\"'`.,;:!?()[]{}<>*_-–—…¡¿«»“”„"


def grams(words):
    """Bucket of every n-gram of "<word>" and of the word itself, word after word, and how many."""
    made = [_grams(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)] or [_grams([])]
    return tuple(np.concatenate(x) for x in zip(*made))


def _grams(words):
    n = len(words)
    text = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(code))
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int32)
    value, found, owners = np.zeros(len(code), np.uint64), [whole], [np.arange(n)]
    for k in range(1, min(max(GRAMS), len(code)) + 1):
        value = value[: len(code) - k + 1] * np.uint64(0x100000001B3) + code[k - 1 :]
        if k in GRAMS:
            inside = place[: len(value)] + k <= ends[: len(value)]
            mixed = (value[inside] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - 18)).astype(np.int32))
            owners.append(owner[: len(value)][inside])
    buckets, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=n)


def bags(texts):
    """Distinct words of a batch, and for each document in turn the numbers of its words, each
    once: a word that is repeated for its own sake weighs no more."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    cut = pc.utf8_split_whitespace(lowered)
    starts = cut.offsets.to_numpy().astype(np.int64)
    raw = pc.dictionary_encode(cut.flatten())
    bare = pc.dictionary_encode(pc.utf8_trim(raw.dictionary, EDGES))
    code = bare.indices.to_numpy()[raw.indices.to_numpy()]
    words = bare.dictionary.to_pylist()
    real = np.array([bool(w) for w in words], bool)
    document = np.repeat(np.arange(len(cut)), np.diff(starts))
    pair = np.unique(document * max(1, len(words)) + code)
    document, code = np.divmod(pair, max(1, len(words)))
    keep = real[code] if len(words) else np.zeros(0, bool)
    return words, code[keep], document[keep]


def means(values, owner, n, padding=0):
    """Mean of ``values`` by owner and so many zeros; 0 where there are none."""
    counts = np.bincount(owner, minlength=n) + padding
    return np.bincount(owner, values, n) / np.maximum(counts, 1)


class Model:
    """``weight``: what each n-gram bucket adds to the logit; ``bias``."""

    def __init__(self, weight, bias):
        self.weight, self.bias = weight, bias

    def scores(self, texts):
        n = len(texts)
        words, code, document = bags(texts)
        bucket, size = grams(words)
        by_word = means(self.weight[bucket], np.repeat(np.arange(len(words)), size), len(words))
        logit = SHARPNESS * means(by_word[code], document, n, PADDING) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts, labels, steps=STEPS, rate=RATE, seed=7):
    """Fit vectors and softmax jointly by Adam on batches of documents."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 500.0 if len(labels) and labels[0] else -500.0)
    rng = np.random.default_rng(seed)
    words, code, document = bags(texts)
    bucket, size = grams(words)
    first = np.cumsum(size) - size
    begin = np.searchsorted(document, np.arange(len(labels) + 1))
    vectors = np.zeros((DIMENSION, BUCKETS))  # so an n-gram that was never seen says nothing
    soft = rng.uniform(-1, 1, (DIMENSION, 2))
    usual = np.zeros(BUCKETS)
    within = np.bincount(code, minlength=len(words))
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = slice(at, at + WORDS_AT_ONCE)
        stop = first[part][-1] + size[part][-1]
        usual += np.bincount(bucket[first[at] : stop], np.repeat(within[part], size[part]), BUCKETS)
    usual = usual >= max(5, LEAST_SHARE * len(labels))
    bias = np.zeros(2)
    params = [vectors, soft, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    while step < steps:
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH)[: steps - step]:
            docs = order[at : at + BATCH]
            n = len(docs)
            counts = begin[docs + 1] - begin[docs]
            token = code[tokens.spread(begin[docs], counts)]
            owner = np.repeat(np.arange(n), counts)
            own, back = np.unique(token, return_inverse=True)
            gram = bucket[tokens.spread(first[own], size[own])]
            word_of = np.repeat(np.arange(len(own)), size[own])
            share = 1.0 / (counts + PADDING)
            hidden = np.stack([means(means(v[gram], word_of, len(own))[back], owner, n, PADDING) for v in vectors], 1)
            logits = SHARPNESS * hidden @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), labels[docs].astype(int)] -= 1
            p *= np.where(labels[docs] == 1, TOXIC_WEIGHT, 1.0)[:, None] / n
            to_hidden = SHARPNESS * p @ soft.T
            grads = [np.empty_like(vectors), SHARPNESS * hidden.T @ p, p.sum(0)]
            for d in range(DIMENSION):
                to_word = np.bincount(back, (to_hidden[:, d] * share)[owner], len(own)) / np.maximum(size[own], 1)
                grads[0][d] = np.bincount(gram, to_word[word_of], BUCKETS) * usual
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * q)
    side = soft[:, 1] - soft[:, 0]
    return Model((side @ vectors).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Rows whose labels are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs, labels, sizes=SAMPLE, longest=LONGEST):
    """Labelled texts to learn from: at most ``sizes`` rows of the classes 0 and 1. Repeated labels
    are one, and of an id with several texts the least text counts, so the bound holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text").between(1, longest))
    ids = known.join(usable.select("doc_id"), "doc_id", "left_semi")
    mix = F.xxhash64(F.lit("toxicity"), "doc_id")
    parts = [ids.filter(F.col("toxic") == c).orderBy(mix, "doc_id").limit(sizes[c]) for c in (0, 1)]
    drawn = F.broadcast(parts[0].union(parts[1])).join(usable, "doc_id")  # 9,000 narrow rows at most
    return drawn.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _scorer(shared):
    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                made = shared.value.scores(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(made)], ["doc_id", "score"])

    return run


def _fit(batches):
    """mapInArrow function over the whole sample, in one task."""
    rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("text", pa.string())]))
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    model = train(rows.column("text"), rows.column("toxic").to_numpy())
    weight = np.asarray(model.weight, "<f4").tobytes()
    yield pa.RecordBatch.from_pydict({"weight": pa.array([weight], pa.binary()), "bias": pa.array([float(model.bias)])})


def fit(spark, docs, labels):
    """Train on the bounded sample in a task; the model is 1 MB."""
    rows = sample(docs, labels).select("doc_id", "toxic", "text").repartition(1)
    fitted = common.written(spark, rows.mapInArrow(_fit, "weight binary, bias double"), "op2-model").first()
    if fitted is None:  # an empty sample has no task
        return train([], [])
    return Model(np.frombuffer(fitted["weight"], "<f4"), fitted["bias"])


def score(spark, docs, model, threshold=THRESHOLD):
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(shared, threshold):
    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                yield some.filter(pa.array(shared.value.scores(some.column("text")) < threshold))

    return run


def clean(spark, docs, labels, threshold=THRESHOLD):
    """The rows of ``docs`` that are not predicted toxic, each judged by its own text: ids may
    be null or repeated."""
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))
    return docs.mapInArrow(_keeper(model, threshold), docs.schema)
