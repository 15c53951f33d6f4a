"""SimHash components against a plain all-pairs computation."""

import random
import re

import numpy as np
import pytest
import xxhash

from motionframe.llm import near_copies, simhash

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((str(doc), f"{prints[k]:016x}", least.get(find(k))) for k, (doc, _) in enumerate(rows))


def edited(rng):
    base = [rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta"]) + str(rng.randint(0, 400)) for _ in range(250)]
    rows, k = [], 0
    for _ in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"w{rng.randint(0, 9)}"
        rows.append((k, " ".join(text)))
        base, k = text, k + 1
    rows += [(k + 1, ""), (k + 2, " \n\t"), (k + 3, None), (k + 4, "one two"), (k + 5, "ONE two"), (k + 6, "ONE two"), (None, "one two")]
    rows += [rows[3], (k + 7, "x " * 20_000)]
    return rows


@pytest.mark.parametrize("cell", [4096, 8])
def test_components_equal_all_pairs(spark, cell):
    rows = edited(random.Random(5))
    made = simhash.clusters(spark, spark.createDataFrame(rows, "doc_id long, text string"), cell=cell)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in made.collect()) == plain_components(rows)


def test_links_of_random_bits(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40)
    values = {0}
    for s in seeds.tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            v = s
            for f in flips.tolist():
                v ^= 1 << f
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark, spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(spark, edges).collect()}
    order, seen, expected = sorted(signed), {}, []
    for v in order:
        if v in seen:
            continue
        reach, queue = {v}, [v]
        while queue:
            x = queue.pop()
            new = [y for y in order if y not in reach and ((x ^ y) & (1 << 64) - 1).bit_count() <= 4]
            reach.update(new)
            queue += new
        for y in reach:
            seen[y] = min(reach)
        expected.append(reach)
    assert {v: roots.get(v, v) for v in signed} == seen


def test_isolated_pairs_in_a_dealt_anchor(spark):
    """Pairs that only the first block finds, all at one anchor, which is dealt out as cells."""
    rng = np.random.default_rng(6)
    values = []
    for base in rng.integers(0, 1 << 42, 60).tolist():
        flips = np.r_[rng.choice(21, 2, replace=False), 21 + rng.choice(21, 2, replace=False)]
        values += [base << 22, (base ^ sum(1 << b for b in flips.tolist())) << 22]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    made = simhash.links(spark, spark.createDataFrame([(v,) for v in signed], "fp long"), cell=8).collect()
    near = {(max(x, y), min(x, y)) for k, x in enumerate(signed) for y in signed[:k] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4}
    assert len(near) == 60
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in made} == near


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, fp string, root int")
    assert simhash.clusters(spark, none).collect() == []
    assert near_copies.without_near_copies(spark, none).columns == none.columns
