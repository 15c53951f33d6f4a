"""Best-fit packing by a histogram of lengths (operator 6).

Best fit in descending order of length treats equal lengths alike, so it is run over counts:
ranges of sequences with the same room take so many pieces of a length each. That plan has as
many rows as there were such steps, whatever the number of documents. Pieces then take the
planned slots: a piece is numbered among those of its length (its place in its file part plus
the counts of earlier parts), and the number names the slot.

Cases: a null or empty text is the end id alone; no rows give no rows; repeated rows are packed
each; a null doc_id is kept; a text longer than a sequence is cut, the first piece the shorter.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common, tokens

CAPACITY = 2048
PIECE_SCHEMA = "part int, rank long, doc_id long, piece int, start long, length long, ids binary"
PLAN_SCHEMA = "length long, first_rank long, last_rank long, first_sequence long, each long, first_offset long"
#: Rows of a plan that may be broadcast: at most some 10 MB.
SMALL_PLAN = 200_000


def plan(counts, capacity):
    """Slots for ``counts`` pieces by length: rows (length, first_rank, last_rank,
    first_sequence, each, first_offset). Sequences from first_sequence on take ``each`` pieces
    of that length from first_offset on; the last one may take fewer."""
    rooms, ranges, rows, made = [], {}, [], 0  # rooms: sorted list of free room, ranges: its sequences
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, each = capacity, capacity // length
                first, many = made, -(-left // each)
                made += many
            else:
                room = rooms[at]
                each = room // length
                first, many = ranges[room].pop()
                if not ranges[room]:
                    del rooms[at]
            filled = min(many, left // each)
            part = left - filled * each if filled < many else 0
            taken = filled * each + part
            rows.append((length, rank, rank + taken - 1, first, each, capacity - room))
            begun = filled + (part > 0)
            left, rank = left - taken, rank + taken
            for free, at, n in (
                (room - each * length, first, filled),
                (room - part * length, first + filled, begun - filled),
                (room, first + begun, many - begun),
            ):
                if free and n:
                    if not ranges.setdefault(free, []):
                        bisect.insort(rooms, free)
                    ranges[free].append((at, n))
    return rows


def _pieces(path, end_id, capacity):
    """mapInArrow function: documents to pieces, numbered by length within the task."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in tokens.slices(batch):
                ids, bounds = tokens.encoder(path).encode(some.column("text"))
                n = np.diff(bounds) + 1
                pieces = -(-n // capacity)
                total = int(pieces.sum())
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - (pieces - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                fresh = np.r_[True, np.diff(ordered) > 0] if total else np.zeros(0, bool)
                firsts = np.flatnonzero(fresh)
                runs = np.diff(np.r_[firsts, total])
                rank = np.empty(total, np.int64)
                rank[order] = np.arange(total) - np.repeat(firsts, runs) + np.repeat(seen[ordered[firsts]], runs)
                seen[ordered[firsts]] += runs
                end = np.array([end_id], "<u4").tobytes()
                raw, last = ids.astype("<u4"), n[doc]
                own = []
                for k in range(total):
                    a, b = bounds[doc[k]] + start[k], bounds[doc[k]] + start[k] + length[k]
                    own.append(raw[a : b - 1].tobytes() + end if start[k] + length[k] == last[k] else raw[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(total, part, np.int32)),
                        pa.array(rank),
                        some.column("doc_id").take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(own, pa.binary()),
                    ],
                    ["part", "rank", "doc_id", "piece", "start", "length", "ids"],
                )

    return run


def pack(spark, docs, tokenizer=None, end_id=0, capacity=CAPACITY, carry=None):
    """Pieces of ``docs`` (doc_id, text) and their places: doc_id, piece, start, length,
    sequence_id, offset, and the columns of ``carry`` made from ``ids`` (its little-endian
    unsigned 32-bit ids), which are the ids themselves where nothing is said."""
    run = _pieces(tokenizer or tokens.default_tokenizer(), end_id, capacity)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)
    pieces = common.written(spark, pieces, "op6-pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = common.written(spark, bases, "op6-counts")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(rows, PLAN_SCHEMA)
    slots = F.broadcast(slots) if len(rows) <= SMALL_PLAN else slots
    carry = {"ids": F.col("ids")} if carry is None else carry
    narrow = pieces.select("part", "rank", "doc_id", "piece", "start", "length", *[v.alias(k) for k, v in carry.items()])
    numbered = narrow.join(bases.drop("n"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = numbered.join(slots, "length").filter(F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    k = F.col("rank") - F.col("first_rank")
    sequence = F.col("first_sequence") + F.floor(k / F.col("each")).cast("long")
    offset = F.col("first_offset") + (k % F.col("each")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", *carry, sequence.alias("sequence_id"), offset.alias("offset"))


def digests(spark, docs, tokenizer=None, end_id=0, capacity=CAPACITY):
    """The packing with a checksum in place of the ids."""
    return pack(spark, docs, tokenizer, end_id, capacity, {"ids_crc32": F.crc32("ids")})
