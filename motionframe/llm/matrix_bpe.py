"""Byte-level BPE on padded matrices (operator 13).

A text is split by the pattern; each match is a token itself or is merged from its bytes. Distinct
matches that a worker has not met are laid out as rows of integer matrices, one matrix for each
power of two in length, padded on the right. In each round every row merges its leftmost pair of
least rank: the ranks of all pairs stand in a matrix beside it, come from a hash table over pairs,
and only the two pairs beside a merge are looked up anew; the row is compacted by one place, and
rows without a pair leave the matrix.

Matches longer than ``LONG`` bytes are rows of their own, and there a round merges all pairs of the
least rank from left to right, up to the first merge beside which a pair of a lesser rank arises:
the same merges in the same order.

Texts are cut and numbered as in ``tokens``: at a space that a non-space follows, and around a line
feed between non-spaces. The pattern never matches across these places. Decoding puts the bytes of
the ids in a row.

Cases: null and empty texts have no ids; special strings are ordinary text; very long texts and
matches are encoded whole; repeated rows and ties alike; no rows give no rows; null doc_ids stay.
Letters and digits are those of the ``regex`` module's Unicode version; for characters that are
newer than the library's own version the split may differ from the library's.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motionframe.llm import tokens

LONG = 1024
#: No pair of this rank: above every id.
NONE = np.int32(np.iinfo(np.int32).max)
#: Bytes of matches that stand in the matrices at once.
MATRIX_BYTES = 4 << 20

_encoders = {}


def ranks_of(path):
    """Token bytes by rank of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Rank of the token that two tokens form, by open addressing over their joint key."""

    def __init__(self, ranks):
        pairs = [(a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.bits = max(4, int(len(made) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, slot = left << 32 | right, self._slot(left << 32 | right)
        waiting = np.arange(len(key))
        self.probes = 0
        while len(waiting):  # all waiting pairs try a slot; one of each free slot gets it, the others go on
            free = waiting[self.keys[slot[waiting]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], made[put]
            waiting = waiting[self.keys[slot[waiting]] != key[waiting]]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left, right):
        """Ranks of pairs of any shape; NONE for padding (-1) and for pairs that do not merge."""
        shape, out = left.shape, np.full(left.size, NONE, np.int32)
        a, b = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[open_] << 32 | b[open_]
        slot = self._slot(key)
        for _ in range(self.probes + 1):
            held = self.keys[slot]
            hit = held == key
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            if not on.any():
                break
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class MatrixEncoder(tokens.Encoder):
    """Ids of texts as the ``tiktoken`` library gives them for these ranks and pattern."""

    def __init__(self, path, pattern):
        import regex

        self.ranks = ranks_of(path)
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.table = PairTable(self.ranks)
        size = max(self.ranks.values()) + 1
        self._forget(np.uint16 if size <= 1 << 16 else np.uint32)
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.bytes = tokens.Pool(np.frombuffer(b"".join(by_rank), np.uint8), [len(t) for t in by_rank])

    def _merge_rows(self, matrix):
        """Ids of the rows of a padded matrix of byte ranks: (ids in a row, ids of each row)."""
        whole = np.full(matrix.shape, -1, np.int32)
        sizes = np.zeros(len(matrix), np.int64)
        rows = np.arange(len(matrix))
        length = (matrix >= 0).sum(1)
        ranks = self.table.ranks(matrix[:, :-1], matrix[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)  # the first of equals is the leftmost
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                whole[rows[done], : matrix.shape[1]] = matrix[done]
                sizes[rows[done]] = length[done]
                rows, matrix, ranks, length, at, best = (x[~done] for x in (rows, matrix, ranks, length, at, best))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            matrix[each, at] = best
            length -= 1
            width = int(length.max())
            place = np.arange(width)
            matrix = np.take_along_axis(matrix, np.minimum(place + (place > at[:, None]), matrix.shape[1] - 1), 1)
            matrix[place >= length[:, None]] = -1
            pairs = np.arange(width - 1)
            ranks = np.take_along_axis(ranks, np.minimum(pairs + (pairs >= at[:, None]), ranks.shape[1] - 1), 1)
            ranks[pairs >= length[:, None] - 1] = NONE
            for side in (at - 1, at):
                some = np.flatnonzero((side >= 0) & (side < length - 1))
                ranks[some, side[some]] = self.table.ranks(matrix[some, side[some]], matrix[some, side[some] + 1])
        return whole[whole >= 0].astype(self.kind), sizes

    def _merge_long(self, row):
        """Ids of one long match: a round merges the pairs of the least rank from left to right, up
        to the first merge that makes a pair of a lesser rank still, which is then the next."""
        ranks = self.table.ranks(row[:-1], row[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            found = np.flatnonzero(ranks == least)
            first = np.r_[True, np.diff(found) > 1]  # of pairs that overlap in a run, every other one
            run = np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))
            found = found[(np.arange(len(found)) - run) % 2 == 0]
            joined = np.r_[False, np.diff(found) == 2]
            before = np.where(found > 0, np.where(joined, least, row[found - 1]), -1)
            after = np.where(found + 2 < len(row), row[np.minimum(found + 2, len(row) - 1)], -1)
            own = np.full(len(found), least)
            lesser = (self.table.ranks(before, own) < least) | (self.table.ranks(own, after) < least)
            if lesser.any():
                found = found[: lesser.argmax() + 1]
            row[found] = least
            row, ranks = np.delete(row, found + 1), np.delete(ranks, found)
            place = found - np.arange(len(found))
            beside = np.unique(np.concatenate([place - 1, place]))
            beside = beside[(beside >= 0) & (beside < len(ranks))]
            ranks[beside] = self.table.ranks(row[beside], row[beside + 1])
        return row.astype(self.kind)

    def merged(self, matches):
        """Pool of the ids of distinct matches (bytes)."""
        ids, sizes = [None] * len(matches), np.zeros(len(matches), np.int64)
        rest, pools, order = [], [], []
        for k, match in enumerate(matches):
            rank = self.ranks.get(match)
            if rank is None:
                rest.append(k)
            else:
                ids[k], sizes[k] = rank, 1
        lengths = np.array([len(matches[k]) for k in rest], np.int64)
        single = np.flatnonzero(sizes == 1)
        pools.append(tokens.Pool(np.array([ids[k] for k in single], self.kind), np.ones(len(single), np.int64)))
        order.append(single)
        rest = np.array(rest, np.int64)
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
        for width in np.unique(bucket[lengths <= LONG]):
            some = rest[(bucket == width) & (lengths <= LONG)]
            step = max(1, MATRIX_BYTES >> int(width))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                flat = np.frombuffer(b"".join([matches[k] for k in part]), np.uint8)
                size = np.array([len(matches[k]) for k in part], np.int64)
                matrix = np.full((len(part), int(size.max())), -1, np.int32)
                matrix[np.arange(matrix.shape[1]) < size[:, None]] = self.single[flat]
                pools.append(tokens.Pool(*self._merge_rows(matrix)))
                order.append(part)
        for k in rest[lengths > LONG]:
            made = self._merge_long(self.single[np.frombuffer(matches[k], np.uint8)])
            pools.append(tokens.Pool(made, [len(made)]))
            order.append(np.array([k]))
        back = np.empty(len(matches), np.int64)
        back[np.concatenate(order).astype(np.int64)] = np.arange(len(matches))
        return tokens.Pool.stacked(pools).take(back)

    def _plain(self, texts):
        """Ids of texts, each split by the pattern; equal matches are merged once."""
        numbers, flat, counts = {}, [], []
        for text in texts:
            found = self.pattern.findall(text)
            counts.append(len(found))
            flat.extend([numbers.setdefault(m, len(numbers)) for m in found])
        by_match = self.merged([m.encode("utf-8", "surrogatepass") for m in numbers])
        code, counts = np.array(flat, np.int64), np.array(counts, np.int64)
        each = by_match.sizes[code]
        bounds = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(counts)
        return tokens.Pool(by_match.take(code).ids, bounds[ends] - bounds[ends - counts])

    def _fresh(self, pieces):
        return self._plain([w if w[:1] == "\n" else " " + w for w in pieces.to_pylist()])

    def decode(self, ids):
        """The bytes of ids in a row, and where each id's bytes begin, with the total at the end."""
        code = ids.astype(np.int64)
        size = self.bytes.sizes[code]
        return self.bytes.ids[tokens.spread(self.bytes.starts[code], size)], np.concatenate([[0], np.cumsum(size)])


def encoder(path, pattern):
    """The encoder of this worker for one rank file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = MatrixEncoder(path, pattern)
    return _encoders[path, pattern]


def _digester(path, pattern):
    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                own = encoder(path, pattern)
                ids, bounds = own.encode(some.column("text"))
                plain, place = own.decode(ids)
                wide, ends = ids.astype("<u4"), place[bounds]
                n = np.diff(bounds)
                sha = lambda x, edge, k: hashlib.sha256(memoryview(x[edge[k] : edge[k + 1]])).hexdigest()
                made = [[sha(x, edge, k) for k in range(len(n))] for x, edge in ((wide, bounds), (plain, ends))]
                columns = [some.column("doc_id"), pa.array(n), *map(lambda x: pa.array(x, pa.string()), made)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path, pattern):
    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                ids, bounds = encoder(path, pattern).encode(some.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def _decode(path, pattern):
    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            counts = np.asarray(lists.value_lengths().fill_null(0))
            plain, place = encoder(path, pattern).decode(lists.flatten().to_numpy(zero_copy_only=False))
            ends = place[np.concatenate([[0], np.cumsum(counts)])]
            texts = [plain[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def default_ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _own(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encoded(docs, path=None, pattern=None):
    """doc_id, ids (array<int>) of every row of ``docs`` (doc_id, text)."""
    path, pattern = (path, pattern) if path else default_ranks()
    return _own(docs).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decoded(rows, path=None, pattern=None):
    """doc_id, text of every row of ``rows`` (doc_id, ids); bytes that are no text become U+FFFD."""
    path, pattern = (path, pattern) if path else default_ranks()
    return rows.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, text string")


def digests(spark, docs, path=None, pattern=None):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text)."""
    path, pattern = (path, pattern) if path else default_ranks()
    return _own(docs).mapInArrow(_digester(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
