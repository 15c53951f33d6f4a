"""Token files coded by a static range asymmetric numeral system (operator 4).

All blocks share one table of token frequencies, counted over the whole corpus. A block is
coded alone: its symbols are dealt to lanes in turn, each lane has a 64-bit state, and the
words that lanes put out at one step stand together in lane order, so one NumPy step codes all
lanes. Every ``CHECK_STEPS`` steps a checkpoint keeps the states and the place in the words:
decoding may begin there. Checksums cover the words and the ids.

The files are a Parquet table, one block a row (Spark's committer makes lost tasks harmless):
part, block, n_tokens, doc_ids (int64), lengths (uint32), lanes, words (uint32), states (uint64,
lanes for each checkpoint), places (int64, one for each checkpoint), words_crc32, ids_crc32;
numbers are little-endian. Beside it stands a table of (token, frequency).

Cases: a null or empty text is the end id alone; no rows give no blocks; equal or repeated rows
are coded each; rows with the same doc_id stand in the order
of their texts, a null doc_id comes first and is read back as null; a document is never
cut, so a very long one makes a block larger.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common, tokens

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
#: Symbols of a lane at least, where a block has that many.
LEAST_STEPS = 64
CHECK_STEPS = 256
#: Stands in the files for a null doc_id.
NO_ID = -(1 << 63)
BLOCK_TOKENS = 1 << 20
CHUNK_SCHEMA = "part int, block int, n_tokens long, doc_ids binary, lengths binary, ids binary, counts binary"
BLOCK_SCHEMA = (
    "part int, block int, n_tokens long, doc_ids binary, lengths binary, lanes int, words binary, "
    "states binary, places binary, words_crc32 long, ids_crc32 long"
)
READ_SCHEMA = "part int, block int, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary"


class Table:
    """Frequencies that add up to ``2 ** SCALE_BITS``; every counted token has at least one."""

    def __init__(self, frequency):
        self.frequency = frequency.astype(np.uint64)
        self.first = (np.cumsum(self.frequency) - self.frequency).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64))


def scaled(counts):
    """Counts by token as frequencies with the fixed total: rounded, at least one, and the
    difference taken from or given to the largest."""
    counts = np.asarray(counts, np.int64)
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    total = 1 << SCALE_BITS
    if len(seen) > total:
        raise ValueError("more distinct tokens than the scale has places")
    out[seen] = np.maximum(1, np.rint(counts[seen] / counts[seen].sum() * total)).astype(np.int64)
    order = seen[np.argsort(-out[seen], kind="stable")]
    rest = total - int(out.sum())
    for k in order if rest else ():
        change = rest if rest > 0 else max(rest, 1 - int(out[k]))
        out[k] += change
        rest -= change
        if not rest:
            break
    return out


def encode(ids, table):
    """One block: (lanes, words, states, places)."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // LEAST_STEPS)))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    out, emitted, checks = [], 0, []
    frequency, first = table.frequency[ids], table.first[ids]
    if n and not frequency.all():
        raise ValueError("a token is not in the frequency table")
    shift, half, low = np.uint64(63 - SCALE_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        f, c = frequency[t * lanes : (t + 1) * lanes], first[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << shift)
        word = (x[full] & low).astype("<u4")
        out.append(word)
        emitted += len(word)
        x[full] >>= half
        q = x // f
        x[:] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + c
        if t % CHECK_STEPS == 0:
            checks.append((emitted, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    checks.reverse()
    places = np.array([len(words) - e for e, _ in checks], "<i8")
    states = np.concatenate([s for _, s in checks]) if checks else np.zeros(0, np.uint64)
    return lanes, words, states.astype("<u8"), places


def decode(n, lanes, words, states, places, table, start=0, stop=None):
    """Ids ``start`` to ``stop`` of a block, from the checkpoint before ``start`` on."""
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    check = start // lanes // CHECK_STEPS
    state = states[check * lanes : (check + 1) * lanes].astype(np.uint64)
    at, begin = int(places[check]), check * CHECK_STEPS
    mask, bits, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    out = []
    for t in range(begin, -(-stop // lanes)):
        x = state[: min(lanes, n - t * lanes)]
        slot = x & mask
        s = table.symbol[slot]
        out.append(s)
        x[:] = table.frequency[s] * (x >> bits) + slot - table.first[s]
        low = x < LOW
        k = int(np.count_nonzero(low))
        x[low] = (x[low] << half) | words[at : at + k]
        at += k
    return np.concatenate(out)[start - begin * lanes : stop - begin * lanes]


def _chunks(path, end_id):
    """mapInArrow function: sorted documents to chunks of about ``BLOCK_TOKENS`` ids."""

    def run(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        docs, lengths, pool, held = [], [], [], 0
        end = np.array([end_id], tokens.encoder(path).kind)

        def flush():
            ids = np.concatenate(pool)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([np.array(docs, "<i8").tobytes()], pa.binary()),
                    "lengths": pa.array([np.array(lengths, "<u4").tobytes()], pa.binary()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "counts": pa.array([_counts(ids).tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            for piece in tokens.slices(batch):
                ids, starts = tokens.encoder(path).encode(piece.column("text"))
                for k, doc in enumerate(piece.column("doc_id").to_pylist()):
                    own = ids[starts[k] : starts[k + 1]]
                    docs.append(NO_ID if doc is None else doc)
                    lengths.append(len(own) + 1)
                    pool += [own, end]
                    held += len(own) + 1
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        block += 1
                        docs, lengths, pool, held = [], [], [], 0
        if held:
            yield flush()

    return run


def _ids(raw, n):
    """Ids of a chunk, written in two or four bytes each."""
    return np.frombuffer(raw, f"<u{len(raw) // max(1, n)}")


def _counts(ids):
    """(token, its number) of the tokens of a block, row by row."""
    n = np.bincount(ids)
    seen = np.flatnonzero(n)
    return np.stack([seen, n[seen]], 1).astype("<i8")


def _count(batches):
    """Counts of all blocks of a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("counts"):
            token, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, 2).T
            total = np.pad(total, (0, max(0, int(token[-1]) + 1 - len(total))))
            total[token] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"token": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})


def _coder(shared):
    def run(batches):
        table = Table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _ids(row["ids"], row["n_tokens"])
                lanes, words, states, places = encode(ids, table)
                made = {k: row[k] for k in ("part", "block", "n_tokens", "doc_ids", "lengths")}
                made |= {"lanes": lanes, "words": words.tobytes(), "states": states.tobytes(), "places": places.tobytes()}
                made |= {"words_crc32": zlib.crc32(made["words"]), "ids_crc32": zlib.crc32(ids.astype("<u4"))}
                yield pa.RecordBatch.from_pylist([made], BLOCK_ARROW)

    return run


BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()),
        ("lengths", pa.binary()), ("lanes", pa.int32()), ("words", pa.binary()), ("states", pa.binary()),
        ("places", pa.binary()), ("words_crc32", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)


def _reader(shared, with_ids):
    def run(batches):
        table = Table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"]) != row["words_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: the words differ from their checksum")
                numbers = [np.frombuffer(row[k], kind) for k, kind in (("words", "<u4"), ("states", "<u8"), ("places", "<i8"))]
                ids = decode(row["n_tokens"], row["lanes"], *numbers, table).astype("<u4")
                if zlib.crc32(ids) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: the ids differ from their checksum")
                docs = np.frombuffer(row["doc_ids"], "<i8")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                n = len(lengths)
                own = [ids[b - k : b] for b, k in zip(ends, lengths)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(n, row["part"], np.int32)),
                        "block": pa.array(np.full(n, row["block"], np.int32)),
                        "doc_id": pa.array(docs, mask=docs == NO_ID),
                        "place": pa.array(ends - lengths),
                        "n_tokens": pa.array(lengths),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        "ids": pa.array([x.tobytes() if with_ids else None for x in own], pa.binary()),
                    }
                )

    return run


def write(spark, docs, path, tokenizer=None, end_id=2):
    """Write ``docs`` (doc_id, text) as coded token files in ascending order of doc_id."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    chunks = common.written(spark, ordered.mapInArrow(_chunks(tokenizer, end_id), CHUNK_SCHEMA), "op4-ids")
    counts = chunks.select("counts").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = counts.toPandas()  # one row a token of the vocabulary
    counted = np.zeros(int(seen["token"].max()) + 1 if len(seen) else 0, np.int64)
    counted[seen["token"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    frequency = scaled(counted)
    rows = [(int(t), int(frequency[t])) for t in np.flatnonzero(frequency)]
    spark.createDataFrame(rows, "token long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    chunks.drop("counts").mapInArrow(_coder(spark.sparkContext.broadcast(frequency)), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def read(spark, path, with_ids=True):
    """Decode the files: documents (part, block, doc_id, place in the block, n_tokens, ids_crc32
    and, if asked for, ids), and the ids before each block (part, block, begin)."""
    seen = spark.read.schema("token long, frequency long").parquet(f"{path}/table").toPandas()
    frequency = np.zeros(int(seen["token"].max()) + 1 if len(seen) else 0, np.int64)
    frequency[seen["token"].to_numpy(np.int64)] = seen["frequency"].to_numpy(np.int64)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_start"))
    starts = places.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("begin"))
    decoded = blocks.mapInArrow(_reader(spark.sparkContext.broadcast(frequency), with_ids), READ_SCHEMA)
    return decoded, starts


def digests(spark, docs, tokenizer=None, end_id=2):
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written and read back."""
    path = common.new_path(spark, "op4-files")
    write(spark, docs, path, tokenizer, end_id)
    decoded, starts = read(spark, path, with_ids=False)
    rows = decoded.drop("ids")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
