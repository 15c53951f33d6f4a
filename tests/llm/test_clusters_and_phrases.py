"""Centroids, phrases and matrix BPE against plain versions and the libraries."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from motionframe.llm import centroids, matrix_bpe, phrases


def plain_clusters(rows, k, rounds, dimension):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]
    centres = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [near(v) for _, v in kept]
    far_own = [far(v, centres[j]) for (_, v), j in zip(kept, own)]
    sums = Counter()
    for j, d in zip(own, far_own):
        sums[j] += d
    name = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    return sorted(((i, j, d, sums[j], sum(far_own), name(j)) for (i, _), j, d in zip(kept, own, far_own)), key=str)


def vectors(n, dimension, seed):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dimension)) + 3 * rng.integers(-1, 2, size=(n, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]
    rows += [(i, rows[0][1]) for i in (n, n + 1, n + 1)] + [(None, rows[1][1])]
    return rows + [(n + 2, None), (n + 3, []), (n + 4, [1.0]), (n + 5, [float("nan")] * dimension), (n + 6, [None] * dimension), (n + 7, [float("inf")] * dimension)]


@pytest.mark.parametrize("n,k,rounds", [(200, 8, 10), (5, 8, 3), (60, 3, 1)])
def test_clusters_equal_plain_rounds(spark, n, k, rounds):
    rows = vectors(n, 4, n)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    got = centroids.clusters(spark, frame, 4, k, rounds).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, k, rounds, 4)


def test_no_vectors_give_no_rows(spark):
    assert centroids.clusters(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_components_too_large_for_exact_distances_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark, frame).collect()


def test_bounds_spare_distances_and_history_loosens_less_than_drifts():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (8, 64))
    x = np.concatenate([c + rng.integers(-200, 200, (300, 64)) for c in centres])
    history = centres[None] + rng.integers(-300, 300, (1, 8, 64))
    seen = np.stack([centroids.squared(x, c) for c in history[0]], 1)
    at, own = np.zeros(seen.shape, np.int16), seen.argmin(1)
    evaluated = 0
    for _ in range(6):
        moved = np.stack([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else history[-1][j] for j in range(8)])
        history = np.concatenate([history, moved[None]])
        seen, at, own, n = centroids.rescan(x, seen, at, own.copy(), history)
        evaluated += n
        assert (own == np.stack([centroids.squared(x, c) for c in history[-1]], 1).argmin(1)).all()
    assert evaluated < 0.2 * 6 * len(x) * 8
    steps = np.sqrt((np.diff(history, axis=0).astype(float) ** 2).sum(2)).sum(0)
    assert (centroids.displacements(history)[0] <= steps * (1 + 1e-6)).all()


def plain_phrases(rows, least, cover, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    gram = (lang, tuple(w[i : i + k]))
                    counts[gram] = counts.get(gram, 0) + 1
    out = {}
    for (lang, g), a in counts.items():
        if len(g) < 2 or a < least:
            continue
        if len(g) == 2 and any(x == lang and len(h) == 3 and g in (h[:2], h[1:]) and c >= least and 100 * c >= cover * a for (x, h), c in counts.items()):
            continue
        cuts = [(1000000 * a * a // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    return sorted((x, i + 1, p.decode(), -a, l, r, n[x], -s) for x in out for i, (s, a, p, l, r) in enumerate(sorted(out[x])[:top]))


@pytest.mark.parametrize("shard", [7, 1 << 21])
def test_phrases_equal_plain_counts(spark, docs, awkward, shard, monkeypatch):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").limit(12).collect()]
    rows += [(r.text, r.lang) for r in awkward.select("text", "lang").collect()] + [("A a a a b a a a, a a", None), ("x\ty.z", "und")]
    made = phrases._indexed
    shard_of = lambda batches: (setattr(phrases, "SHARD", shard), (yield from made(batches)))
    monkeypatch.setattr(phrases, "_indexed", lambda batches: shard_of(batches))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, rank int").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(spark, frame, least=2, cover=50, top=40).collect())
    assert got == plain_phrases(rows, 2, 50, 40)


def test_phrases_of_no_rows(spark, nothing):
    assert phrases.collocations(spark, nothing).collect() == []


def test_order_of_suffixes_and_both_directions():
    pieces = [[0, 1, 0, 1, 2], [1], [0, 1, 0, 1, 2], [2, 2, 2, 2]]
    numbers = np.concatenate(pieces)
    index = phrases.Index(phrases.transform(numbers, np.array([len(p) for p in pieces])), np.bincount(numbers), len(pieces))
    pairs, n, left, right = index.extend(index.first, index.first)
    plain = Counter((a, b) for p in pieces for a, b in zip(p, p[1:]))
    assert {(a, b): c for a, b, c in zip(left.tolist(), right.tolist(), n.tolist())} == plain
    _, n, first, last = index.extend(pairs, pairs)
    triples = {(left[f], right[f], right[s]): c for f, s, c in zip(first, last, n.tolist())}
    assert triples == Counter(zip_ for p in pieces for zip_ in zip(p, p[1:], p[2:]))


@pytest.fixture(scope="module")
def library():
    path, pattern = matrix_bpe.default_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=matrix_bpe.ranks_of(path), special_tokens={})


def test_matrix_ids_equal_library(spark, docs, awkward, library):
    columns = ["doc_id", "text"]
    rows = docs.select(*columns).unionByName(awkward.select(*columns)).unionByName(
        spark.createDataFrame([(90, "ab" * 4000 + " x"), (91, " " * 3000), (92, "a" * 3001), (93, "\n\n a\t b\r\n'll don't 12ab…")], "doc_id long, text string")
    )
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in rows.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in matrix_bpe.digests(spark, rows).collect())


def test_matrix_round_trip_and_random_texts(spark, library):
    rng = np.random.default_rng(3)
    letters = list("aab  \n\t'sé.1中\x1c😀'tZ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(800)]
    own = matrix_bpe.MatrixEncoder(*matrix_bpe.default_ranks())
    ids, bounds = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = matrix_bpe.decoded(matrix_bpe.encoded(frame))
    assert sorted(tuple(r) for r in back.collect()) == list(enumerate(texts))


def test_matrix_without_rows(spark, nothing):
    assert matrix_bpe.digests(spark, nothing).collect() == []


def test_matrix_encoder_remembers_pieces_like_the_other_encoder(monkeypatch, library):
    """Words met before, new ones and ones that found no room: in each call the ids of the library."""
    monkeypatch.setattr(matrix_bpe.tokens, "KEPT_PIECES", 250)
    own = matrix_bpe.MatrixEncoder(*matrix_bpe.default_ranks())
    made = [f"w{k * k:x}é{k}" for k in range(400)]
    for part in (made[:200], made[100:], made):
        texts = [" ".join(part), "\n".join(part), "", None]
        ids, bounds = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t or "") for t in texts]
    assert len(own.pieces) == len(own.codes) == 250
