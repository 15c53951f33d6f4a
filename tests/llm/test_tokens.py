"""Token ids, files, counts and packing against the library on whole texts."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motionframe.llm import common, packing, rans, token_counts, tokens

PLAIN = Tokenizer.from_file(tokens.default_tokenizer())
ALPHABET = st.sampled_from([*"aBé1 .,-\n\t\x0b\x1c ª", "  ", "'s", "word", "<|endoftext|>", "日本"])


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join) | st.none(), max_size=6))
def test_encoder_equals_library(texts):
    ids, bounds = tokens.encoder(tokens.default_tokenizer()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("alike", [False, True])
def test_remembered_pieces_are_compared_not_only_their_codes(monkeypatch, alike):
    """Many words in a call, met again later; with one code for all of them the ids are the same."""
    if alike:
        monkeypatch.setattr(tokens, "_codes", lambda texts: np.zeros(len(texts), np.uint64))
    own = tokens.Encoder(tokens.default_tokenizer())
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice([*"abcdeé日"], rng.integers(1, 9))) + rng.choice(["", ".", ",.", "!"]) for _ in range(700)]
    for part in (made[:400], made[200:], made):
        texts = [" ".join(part), "\n".join(part), "", None]
        ids, bounds = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t) for t in texts]


def test_codes_are_those_of_the_strings_wherever_they_lie():
    words = pa.array(["", "a", "ab", "日本", "", "ab", "ba", "x" * 5000], pa.large_string())
    codes = tokens._codes(words)
    assert codes[2] == codes[5] and len(set(codes.tolist())) == 6
    assert (tokens._codes(words.slice(2, 5)) == codes[2:7]).all() and len(tokens._codes(words[:0])) == 0


def test_counts_of_blocks_are_added_up_in_a_task():
    blocks = [np.array(v, np.uint16) for v in ([5, 1, 1], [2], [9, 5])]
    batch = pa.RecordBatch.from_pydict({"counts": pa.array([rans._counts(b).tobytes() for b in blocks], pa.binary())})
    (got,) = rans._count([batch, batch])
    assert got.to_pydict() == {"token": [1, 2, 5, 9], "n": [4, 2, 4, 2]}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.data())
def test_rans_round_trip_and_checkpoints(values, data):
    ids = np.array(values * data.draw(st.sampled_from([1, 1, 300])), np.uint32)[:400_000]
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=301)))
    lanes, words, states, places = rans.encode(ids, table)
    assert (rans.decode(len(ids), lanes, words, states, places, table) == ids).all()
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert (rans.decode(len(ids), lanes, words, states, places, table, start, stop) == ids[start:stop]).all()


def test_scaled_frequencies_fill_the_scale():
    counts = np.r_[np.zeros(3, int), np.ones(5000, int), 10**12]
    made = rans.scaled(counts)
    assert made.sum() == 1 << rans.SCALE_BITS and (made[counts > 0] > 0).all() and not made[:3].any()


def test_damaged_block_is_refused(spark, docs):
    path = common.new_path(spark, "test-files")
    rans.write(spark, docs.limit(5), path)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    row = blocks[0].asDict()
    row["words"] = bytes([row["words"][0] ^ 1]) + bytes(row["words"][1:])
    spark.createDataFrame([row], rans.BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/damaged")
    spark.read.parquet(f"{path}/damaged").write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="checksum"):
        rans.read(spark, path)[0].collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_token_files(spark, which, request):
    rows = request.getfixturevalue(which)
    order = sorted(rows.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    expected, start = [], 0
    for r in order:
        ids = ids_of(r.text) + [2]
        expected.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rans.digests(spark, rows).collect()), key=lambda x: x[1]) == expected


@pytest.mark.parametrize("which,capacity", [("docs", 2048), ("awkward", 64), ("nothing", 64)])
def test_packing(spark, which, capacity, request):
    rows = request.getfixturevalue(which)
    expected = []
    for r in rows.select("doc_id", "text").collect():
        ids = ids_of(r.text) + [0]
        head = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        expected += [(str(r.doc_id), k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    made = packing.digests(spark, rows, capacity=capacity).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in made) == sorted(expected)
    places = sorted((r.sequence_id, r.offset, r.length) for r in made)
    used = {}
    for sequence, offset, length in places:
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + length
    assert all(v <= capacity for v in used.values())
    assert len(used) == plain_best_fit([r.length for r in made], capacity)


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b + n <= capacity]
        if fit:
            bins.remove(max(fit))
        bins.append(n + (max(fit) if fit else 0))
    return len(bins)


@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_equals_plain_best_fit(lengths):
    rows = packing.plan(Counter(lengths), 20)
    sequences = {f + (r - a) // e for _, a, b, f, e, _ in rows for r in range(a, b + 1)}
    assert len(sequences) == plain_best_fit(lengths, 20)


def test_token_counts_and_cache(spark, docs, awkward, nothing):
    cache = common.new_path(spark, "test-cache")

    def counted(rows):
        made = token_counts.count_tokens(spark, rows, cache).collect()
        return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in made)

    def plain(rows):
        found = []
        for r in rows.select("doc_id", "text").collect():
            n = len(ids_of(r.text))
            found.append((str(r.doc_id), len((r.text or "").encode()), n, n > 512))
        return sorted(found)

    assert counted(nothing) == []
    assert counted(awkward) == plain(awkward)
    some = docs.filter("doc_id < 60")
    assert counted(some) == plain(some)
    stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count()
    assert counted(some) == plain(some)
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count() == stored  # all were hits
