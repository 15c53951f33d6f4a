"""Near copies against all pairs: what is dropped is a copy, and nearly all copies are found."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.llm import near_copies


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def made_texts(rng, bases=60, copies=6, length=(30, 300)):
    """Texts with copies of up to 3 % changed words, some copies of copies."""
    texts = []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(*length))]
        texts.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for _ in range(round(len(base) * rng.random() * 0.03)):
                other[rng.randrange(len(other))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(other))
            if rng.random() < 0.3:
                base = other
    return texts


def grouped(spark, texts, cell=4096):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    made = near_copies.groups(spark, docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), cell)
    return {r.doc_id: r.root for r in made.collect()}


def plain_groups(texts):
    sets, root = [plain_sets(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = []
    for a, b in combinations(range(len(texts)), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            links.append((a, b))
            root[find(b)] = find(a)
    return links, [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("cell", [4096, 8])
def test_recall_and_precision_against_all_pairs(spark, cell):
    texts = made_texts(random.Random(11))
    links, whole = plain_groups(texts)
    root = grouped(spark, texts, cell)
    assert len(links) > 300
    assert sum(root[a] == root[b] for a, b in links) >= 0.95 * len(links)
    of = {}
    for k, r in root.items():
        of.setdefault(r, set()).add(whole[k])
    assert all(len(v) == 1 for v in of.values())  # no group joins what no chain of true links joins


def test_false_edges_lose_no_links(spark):
    """A crowd around one text: most copies are alike to the centre and not to each other."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    for _ in range(80):
        other = list(base)
        for at in rng.sample(range(300), 6):
            other[at] = f"x{rng.randint(0, 99999)}"
        texts.append(" ".join(other))
    links, _ = plain_groups(texts)
    assert 80 <= len(links) < 81 * 80 // 4
    root = grouped(spark, texts[::-1])
    assert sum(r == root[80] for r in root.values()) >= 0.95 * len(texts)


def test_words_to_check_let_similar_sets_pass_and_part_a_crowd():
    rng = np.random.default_rng(4)

    def passing(common, n_words):
        """Share of pairs of 150 digests with so many in common that pass so many words."""
        at, end = [], 150 - common
        for _ in range(300):
            drawn = rng.integers(0, 1 << 63, 150 + end).astype(np.uint64)
            x, y = (near_copies.bits(d, n_words) for d in (drawn[:150], drawn[end:]))
            at.append((x != y).sum() <= near_copies.allowed(n_words))
        return np.mean(at)

    assert near_copies.allowed(near_copies.FIRST) == 30
    for n_words in (near_copies.FIRST, near_copies.SECOND):
        assert passing(134, n_words) >= 0.97  # 134 of 166: a similarity of 0.81
    assert passing(115, near_copies.SECOND) <= 0.05 < passing(115, near_copies.FIRST)  # 0.62


def test_blocks_follow_the_rows():
    assert [near_copies.shape(n)[0] for n in (0, 1, 10**5, 10**10)] == [15, 15, 17, 34]
    for n in (1, 10**6, 10**10):
        width, blocks = near_copies.shape(n)
        q = 1 - near_copies.APART
        assert 1 - (1 - q**width - width * (1 - q) * q ** (width - 1)) ** blocks >= near_copies.FOUND


def test_anchors_meet_all_rows_within_one_bit():
    rng = np.random.default_rng(2)
    nodes = rng.integers(0, 1 << 17, 300).astype(np.uint64)
    nodes = np.r_[nodes, nodes ^ (np.uint64(1) << rng.integers(0, 17, 300).astype(np.uint64))]
    import pyarrow as pa

    n = len(nodes)
    blocks = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(nodes.view(np.int64)))
    zeros = pa.array(np.zeros(n, np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), zeros, zeros, zeros, blocks], ["node", "c1", "c2", "root", "blocks"])
    met = set()
    for made in near_copies._placed(17)([batch]):
        at = {}
        for place, home, node in zip(made["place"].to_pylist(), made["home"].to_pylist(), made["node"].to_pylist()):
            at.setdefault(place, ([], []))[0 if home else 1].append(node)
        for homes, others in at.values():
            met |= {frozenset((a, b)) for a in homes for b in homes + others if a != b}
    near = {frozenset((a, b)) for a, b in combinations(range(n), 2) if int(nodes[a] ^ nodes[b]).bit_count() <= 1}
    assert len(near) >= 300 and near <= met


def test_awkward_rows(spark, awkward, nothing):
    rows = near_copies.without_near_copies(spark, awkward).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "7", "8"]
    assert near_copies.without_near_copies(spark, nothing).collect() == []
    assert near_copies.without_near_copies(spark, awkward).columns == awkward.columns
