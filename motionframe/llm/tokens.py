"""Token ids of whole texts, fast: distinct pieces of a batch go through the tokenizer once.

A byte-level BPE never joins tokens across a space that a non-space follows, nor across a line
feed between non-spaces, so a text may be cut there and its ids are those of the pieces in a row. Invented or natural, most words repeat:
each Arrow batch is cut and numbered in C++, and the tokenizer sees only pieces that its worker
has not met. A worker keeps ``KEPT_PIECES`` pieces at most; frequent ones come early.
"""

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, about 40 bytes each. Further ones are encoded again.
KEPT_PIECES = 1_000_000
#: White space as the tokenizer sees it, but for the plain space.
OTHER = r"\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space in a row, or a space or line feed at the end: the plain cut would be wrong there.
IRREGULAR = rf"[ \n](?:[ {OTHER}]|$)|[{OTHER}]\n"
CUT = re.compile(r" (?=\S)")
JOINED = 64

_encoders = {}


def spread(starts, sizes):
    """Places of runs in a row: starts[0], starts[0] + 1, ... for sizes[0] places, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def _buffers(texts):
    """Places of large strings, with the end of the last, and their bytes."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return bounds, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _strings(bounds, data):
    """Large strings that stand one after the other in ``data``."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)])


def _tails(whole, heads):
    """What follows the beginning ``heads`` of each string."""
    bounds, data = _buffers(whole)
    starts = bounds[:-1] + pc.binary_length(heads).to_numpy()
    sizes = bounds[1:] - starts
    return _strings(np.concatenate([[0], np.cumsum(sizes)]), data[spread(starts, sizes)])


def _codes(texts):
    """A number for each string, the same for equal ones."""
    bounds, data = _buffers(texts)
    sizes = np.diff(bounds)
    out, filled = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(filled):
        starts = bounds[:-1][filled] - bounds[0]
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(int(bounds[-1] - bounds[0])) - np.repeat(starts, sizes[filled])
        out[filled] = np.add.reduceat(powers[place] * (data[bounds[0] : bounds[-1]] + np.uint64(1)), starts)
    return out


def _after_space(pieces):
    """Pieces with the space before them that they were cut at; a line feed stands for itself."""
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(none, pieces, space))


class Pool:
    """Ids of many pieces in one array: piece k has ``sizes[k]`` ids from ``starts[k]`` on."""

    def __init__(self, ids, sizes):
        self.ids, self.sizes = ids, np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, which):
        sizes = self.sizes[which]
        return Pool(self.ids[spread(self.starts[which], sizes)], sizes)

    @staticmethod
    def stacked(pools):
        return Pool(np.concatenate([p.ids for p in pools]), np.concatenate([p.sizes for p in pools]))


class Encoder:
    """Ids of texts by the ``tokenizers`` library, special strings in a text as its default."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: a byte-level vocabulary writes a byte as a character.
        self.bytes = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.bytes[list(vocabulary.values())] = [len(w) for w in vocabulary]
        self._forget(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _forget(self, kind):
        """No piece is remembered; ids are of this type."""
        self.kind = kind
        self.pieces = pa.array([], pa.large_string())
        self.known = Pool(np.zeros(0, kind), [])
        self.codes, self.by_code = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _plain(self, texts):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = [len(x) for x in found]
        return Pool(np.fromiter(chain.from_iterable(found), self.kind, sum(sizes)), sizes)

    def _letters(self, cores):
        """Ids of words of letters with their space or line feed: no token joins two of them, so many
        share a call, and the bytes of the tokens tell where a word ends."""
        if not len(cores):
            return Pool(np.zeros(0, self.kind), [])
        bounds, data = _buffers(cores)
        lines = _strings(np.append(bounds[:-1:JOINED], bounds[-1]), data).to_pylist()
        found = self._plain(lines)
        upto = np.concatenate([[0], np.cumsum(self.bytes[found.ids])])
        last = np.searchsorted(upto, bounds - bounds[0])
        if upto[-1] != bounds[-1] - bounds[0] or (upto[last] != bounds - bounds[0]).any():  # not a byte-level vocabulary
            return self._plain(cores.to_pylist())
        return Pool(found.ids, np.diff(last))

    def _fresh(self, pieces):
        """Ids of pieces that the worker has not met, with the space or line feed before them."""
        cores = pc.utf8_rtrim(pieces, ".,")
        simple = pc.utf8_is_alpha(pc.replace_substring_regex(cores, r"^\n", ""))
        whole, bare = pieces.filter(simple), cores.filter(simple)
        words = pc.dictionary_encode(bare)
        ends = pc.dictionary_encode(_tails(whole, bare))
        by_core, by_end = self._letters(_after_space(words.dictionary)), self._plain(ends.dictionary.to_pylist())
        core, end = words.indices.to_numpy().astype(np.int64), ends.indices.to_numpy().astype(np.int64) + len(by_core.sizes)
        paired = Pool.stacked([by_core, by_end]).take(np.stack([core, end], 1).ravel())
        made = Pool(paired.ids, paired.sizes.reshape(-1, 2).sum(1))
        rest = self._plain(_after_space(pieces.filter(pc.invert(simple))).to_pylist())
        simple = simple.to_numpy(zero_copy_only=False)
        order = np.empty(len(simple), np.int64)
        order[simple] = np.arange(len(made.sizes))
        order[~simple] = len(made.sizes) + np.arange(len(rest.sizes))
        return Pool.stacked([made, rest]).take(order)

    def _met(self, pieces, codes):
        """Place of each piece among the remembered ones, -1 where it is not there. Codes only say
        where to look: the pieces themselves are compared."""
        if not len(self.codes):
            return np.full(len(pieces), -1)
        order = np.argsort(codes)
        place = np.empty(len(codes), np.int64)
        place[order] = np.searchsorted(self.codes, codes[order])
        place = np.minimum(place, len(self.codes) - 1)
        at = np.where(self.codes[place] == codes, self.by_code[place], -1)
        like = np.flatnonzero(at >= 0)
        same = pc.equal(self.pieces.take(pa.array(at[like])), pieces.take(pa.array(like)))
        at[like[~same.to_numpy(zero_copy_only=False)]] = -1
        return at

    def _spaced(self, pieces):
        """Ids of each of the distinct pieces; the worker remembers them."""
        codes = _codes(pieces)
        at = self._met(pieces, codes)
        new = at < 0
        missing = pieces.filter(pa.array(new))
        if not len(missing):
            return self.known.take(at)
        fresh = self._fresh(missing)
        at[new] = len(self.known.sizes) + np.arange(len(missing))
        out = Pool.stacked([self.known, fresh]).take(at)
        room = min(max(0, KEPT_PIECES - len(self.pieces)), len(missing))
        if room:
            own = codes[new][:room]
            order = np.argsort(own, kind="stable")
            place = np.searchsorted(self.codes, own[order])
            self.codes = np.insert(self.codes, place, own[order])
            self.by_code = np.insert(self.by_code, place, len(self.pieces) + order)
            self.pieces = pa.concat_arrays([self.pieces, missing.slice(0, room)])
            self.known = Pool.stacked([self.known, fresh.take(np.arange(room))])
        return out

    def encode(self, texts):
        """texts: Arrow strings, null counts as empty. Gives all ids in a row and the place of
        each text's first id, with the total at the end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        if not n:
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, IRREGULAR)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")  # a piece keeps its line feed
        if pc.any(odd).as_py():
            by_hand = pa.array([CUT.split(t) for t in texts.filter(odd).to_pylist()], cut.type)
            place = np.arange(n)
            place[odd.to_numpy(zero_copy_only=False)] = n + np.arange(len(by_hand))
            cut = pa.concat_arrays([cut, by_hand]).take(pa.array(place))
        starts = cut.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        flat = cut.flatten()
        numbered = pc.dictionary_encode(flat)
        distinct = self._spaced(numbered.dictionary)
        code = numbered.indices.to_numpy().astype(np.int64)
        firsts = self._plain(flat.take(pa.array(starts[:-1])).to_pylist())
        code[starts[:-1]] = len(distinct.sizes) + np.arange(n)
        pool = Pool.stacked([distinct, firsts])
        each = pool.sizes[code]
        bounds = np.concatenate([[0], np.cumsum(each)])
        return pool.ids[spread(pool.starts[code], each)], bounds[starts]


def encoder(path):
    """The encoder of this worker for one tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def file_digest(path):
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(batch, max_bytes=6 << 20):
    """Cut a record batch so that no part holds more text than that, but for a single long text."""
    texts = batch.column("text").cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // max_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
