"""URL lists, language-model scores and outliers against plain versions."""

import math
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionframe.llm import lm_score, outliers, url_filter
from tests.conftest import SF

DAY = datetime(2024, 1, 1)


def plain_judge(captures, entries):
    out = []
    for key, url, at in captures:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)([^#]*)", url or "")
        n = Counter()
        if m and at:
            host = re.sub(r":[0-9]*$", "", m[1].split("@")[-1]).lower().rstrip(".")
            parts = host.split(".")
            names = {("domain", ".".join(parts[k:])) for k in range(len(parts))} | {("url", host + m[2])}
            for lst, kind, pattern in {e[:3] for e in entries if None not in e}:
                past = sorted((t.replace(microsecond=0), on) for a, b, c, t, on in [e for e in entries if None not in e] if (a, b, c) == (lst, kind, pattern) and t.replace(microsecond=0) <= at)
                if (kind, pattern) in names and past:
                    last = past[-1][0]
                    n[lst] += all(on for t, on in past if t == last)
        out.append((key, n["block"], n["allow"], n["block"] == 0 or n["allow"] > 0))
    return sorted(out)


def test_url_lists(spark):
    rng = np.random.default_rng(3)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "e.net"]
    entries = []
    for _ in range(120):
        at = DAY + timedelta(minutes=int(rng.integers(0, 6000)), microseconds=int(rng.integers(0, 10**6)))
        kind, pattern = ("domain", str(rng.choice(hosts))) if rng.random() < 0.8 else ("url", "d.org/x?q=1")
        entries.append((str(rng.choice(["block", "block", "allow"])), kind, pattern, at, bool(rng.random() < 0.6)))
    entries += [entries[0], (None, "domain", "a.com", DAY, True), ("block", "domain", None, DAY, True), ("block", "domain", "e.net", None, True)]
    urls = ["http://a.com/", "https://u:p@B.a.com:80/x", "http://c.b.a.com?x#y", "ftp://d.org/x?q=1#top", "http://d.org./x", "not a url", "", None, "http:///", "http://za.com/"]
    captures = [(k, urls[k % 10], DAY + timedelta(minutes=int(rng.integers(0, 6000)))) for k in range(300)] + [(300, "http://a.com", None)]
    frames = (
        spark.createDataFrame(captures, "key long, url string, fetched_at timestamp"),
        spark.createDataFrame(entries, "list string, kind string, pattern string, at timestamp, listed boolean"),
    )
    made = url_filter.judge(*frames).select("key", "n_block", "n_allow", "kept").collect()
    assert sorted(map(tuple, made)) == plain_judge(captures, entries)
    assert url_filter.judge(frames[0].limit(0), frames[1]).collect() == []
    assert url_filter.judge(frames[0], frames[1].limit(0)).filter("kept").count() == len(captures)


def test_domains_of_many_labels(spark):
    """Every domain above a host is looked up, however many labels it has."""
    names = "a.b.c.d.e.f.g.h".split(".")
    captures = [(k, f"http://{'.'.join(names[k:])}/x", DAY) for k in range(8)]
    entries = [("block", "domain", "b.c.d.e.f.g.h", DAY, True), ("allow", "domain", "a.b.c.d.e.f.g.h", DAY, True)]
    frames = (
        spark.createDataFrame(captures, "key long, url string, fetched_at timestamp"),
        spark.createDataFrame(entries, "list string, kind string, pattern string, at timestamp, listed boolean"),
    )
    made = url_filter.judge(*frames).select("key", "n_block", "n_allow", "kept").collect()
    assert sorted(map(tuple, made)) == plain_judge(captures, entries)
    assert {r.key: (r.n_block, r.n_allow) for r in made} == {0: (1, 1), 1: (1, 0), **{k: (0, 0) for k in range(2, 8)}}


def plain_losses(rows, target, vocabulary, paired):
    """The same models by dictionaries."""
    lines = {k: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w] for k, t in rows}
    counts = Counter(w for x in lines.values() for w in x)
    least = min((n for n in counts.values() if sum(m >= n for m in counts.values()) <= vocabulary), default=1)
    listed = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= least]
    own_class = set(listed[:paired])
    lines = {k: [w if w in listed else None for w in x] for k, x in lines.items()}
    cls = lambda w: w if w in own_class or w == "<" else None
    losses = defaultdict(list)
    for use in (lambda k: k in target, lambda k: True):
        word, pair, context = Counter(), Counter(), Counter()
        for k, x in lines.items():
            if use(k):
                word.update(x)
                pair.update((cls(a), cls(b)) for a, b in zip(["<", *x], x))
                context.update(cls(a) for a in ["<", *x][:-1] if x)
        weight = {w: word[w] + lm_score.ADDED for w in [*listed, None]}
        rare = sum(n for w, n in weight.items() if cls(w) is None)
        for k, x in lines.items():
            total = 0.0
            for a, b in zip(["<", *x], x):
                own = weight[b] / sum(weight.values())
                within = 1 if cls(b) else weight[b] / rare
                seen = context[cls(a)]
                total -= math.log(lm_score.MIXED * pair[cls(a), cls(b)] / seen * within + (1 - lm_score.MIXED) * own if seen else own)
            losses[k].append(total / len(x) if x else None)
    return {k: (len(lines[k]), *v) for k, v in losses.items()}


def test_lm_scores(spark, nothing, awkward):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").collect()] + [(90, None), (91, " "), (92, "NEW words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = {k for k, _ in rows if k % 3 == 0}
    ids = spark.createDataFrame([(k,) for k in target] + [(0,), (None,), (555,)], "doc_id long")
    made = lm_score.score(spark, docs, lm_score.fit(spark, docs, ids, vocabulary=1500)).collect()
    expected = plain_losses(rows, target, 1500, lm_score.PAIRED)
    close = lambda a, b: a is b is None or abs(a - b) < 1e-9
    for r in made:
        n, t, b = expected[r.doc_id]
        assert r.n_words == n and close(r.target_loss, t) and close(r.background_loss, b)
        assert abs(r.score - ((t or 0) - (b or 0))) < 1e-9
    inside = [r.score for r in made if r.doc_id in target and r.n_words]
    outside = [r.score for r in made if r.doc_id not in target and r.n_words]
    assert np.mean(inside) < np.mean(outside)
    model = lm_score.fit(spark, nothing, ids)
    assert lm_score.score(spark, nothing, model).collect() == []
    assert {r.score for r in lm_score.score(spark, awkward, model).collect() if not r.n_words} == {0.0}


def test_lm_counts_every_word_and_pair(spark, monkeypatch):
    """More words than a fixed table of pairs holds, frequent keys dealt out."""
    monkeypatch.setattr(lm_score, "SPLIT", 5)
    rng = np.random.default_rng(8)
    rows = [(k, "the of " * 3 + " ".join(f"w{j}" for j in rng.integers(0, 2500, 120))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = {k for k, _ in rows if k % 3 == 0}
    model = lm_score.fit(spark, docs, spark.createDataFrame([(k,) for k in target], "doc_id long"))
    expected = plain_losses(rows, target, 10**9, None)
    made = lm_score.score(spark, docs, model).collect()
    assert len(made) == len(rows)
    for r in made:
        n, t, b = expected[r.doc_id]
        assert r.n_words == n and abs(r.target_loss - t) < 1e-9 and abs(r.background_loss - b) < 1e-9


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_base_counts(spark, which, request):
    rows = request.getfixturevalue(which)
    made = outliers.counts(rows).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = sorted((str(r.doc_id), plain_counts(r.text)) for r in rows.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), tuple(r[c] for c in columns)) for r in made) == expected


def test_repeats_at_the_edges(spark):
    texts = ["a b c a b c", "a a a a a", "a b c d a b c x b c d", "a b c", "", "x y z q x y z q x y z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source")
    assert {r.doc_id: r.n_repeat_words for r in outliers.counts(rows).collect()} == {k: plain_counts(t)[4] for k, t in enumerate(texts)}


def plain_mcd(x):
    """The same concentration steps with exact sorting by distance bin."""
    floor = np.array(outliers.FLOOR)
    q = [np.sort(x[:, k]) for k in range(5)]
    at = lambda s, p: s[max(0, math.ceil(p * len(s)) - 1)]
    scaled = np.stack([abs(x[:, k] - at(q[k], 0.5)) / (at(q[k], 0.75) - at(q[k], 0.25) + floor[k]) for k in range(5)], 1)
    best = None
    for d in (np.square(scaled).sum(1), scaled.max(1), scaled[:, 2:].sum(1)):
        for _ in range(outliers.STEPS + 1):
            bins = np.floor(np.log(d + 1e-6) * outliers.BINS_PER_E)
            edge = np.sort(bins)[math.ceil(outliers.SUPPORT * len(bins)) - 1]
            h = x[bins <= edge]
            s = outliers.CONSISTENCY * np.cov(h.T, bias=True)
            s[range(5), range(5)] = np.maximum(s.diagonal(), floor**2)
            y = x - h.mean(0)
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(s), y)
        if best is None or np.linalg.slogdet(s)[1] < best[0]:
            best = (np.linalg.slogdet(s)[1], d)
    return best[1]


def test_distances_equal_plain_estimate(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        n = int(rng.lognormal(5, 0.5)) + 50
        junk = k % 25 == 0
        words = rng.choice([f"w{j}" for j in range(900)], n).tolist()
        text = " ".join(f"{w}#$%&#" if junk else w for w in words)
        rows.append((k, text, "en", "a" if k % 3 else "b"))
    rows += [(600, " ".join(rng.choice(["p", "q", "r"], 5).tolist() + [f"v{j}" for j in range(60)]), "xx", None), (601, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    made = {r.doc_id: r for r in outliers.judge(spark, docs).collect()}
    counted = {k: plain_counts(t) for k, t, _, _ in rows}
    for source in "ab":
        ids = [k for k, _, _, s in rows if s == source and not made[k].base_failed]
        n, c, s, l, p = (np.array([counted[k][j] for k in ids], float) for j in range(5))
        x = np.stack([np.log1p(n), np.log(c / n), np.sqrt(s / c), np.log1p(l), np.sqrt(p / n)], 1)
        assert np.allclose([made[k].distance for k in ids], plain_mcd(x), rtol=0.02, atol=0.02)
    assert all(made[k].kept == (k % 25 != 0) for k in range(600) if not made[k].base_failed)
    assert made[600].kept and made[600].distance is None  # too few rows anywhere to judge by
    assert made[601].base_failed and not made[601].kept
    assert outliers.judge(spark, docs.limit(0)).collect() == []


def test_each_statistic_can_reject(spark):
    """In a group of plain texts one that repeats itself, is full of signs, of equal lines or far longer goes."""
    rng = np.random.default_rng(6)
    words = [f"w{j:05d}" for j in range(60_000)]
    text = lambda n: " ".join(rng.choice(words, n, replace=False))
    rows = [(k, text(int(rng.integers(150, 260)))) for k in range(2000)]
    repeated = text(155)
    odd = [repeated + " " + " ".join(repeated.split()[:45]), text(200) + "#$%&" * 10, "\n".join([text(180)] + ["one equal line"] * 21), text(5000)]
    mild = [text(200) + "\nsame\nsame", text(200) + " #1", text(420)]
    rows += [(3000 + k, t) for k, t in enumerate(odd)] + [(4000 + k, t) for k, t in enumerate(mild)]
    docs = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string")
    made = {r.doc_id: r for r in outliers.judge(spark, docs).collect()}
    assert not any(made[k].base_failed for k in range(3000, 3004))
    assert [made[k].kept for k in (3000, 3001, 3002, 3003, 4000, 4001, 4002)] == [False] * 4 + [True] * 3
    assert sum(made[k].kept for k in range(2000)) >= 1990


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_lm_words_and_pairs_are_sent_as_numbers(spark):
    """Distinct words once a slice, pairs as sorted codes: fit and score shuffle less than one and a half times the texts."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"word{j}ly" for j in rng.integers(0, 5000, 400))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = shuffled(spark)
    models = lm_score.fit(spark, docs, spark.createDataFrame([(k,) for k in range(0, 400, 3)], "doc_id long"))
    assert len(lm_score.score(spark, docs, models).collect()) == 400
    sent, size = shuffled(spark) - before, sum(len(t) for _, t in rows)
    assert 0 < sent < 1.5 * size, (sent, size)


def test_lm_scores_of_own_and_of_other_documents(spark, monkeypatch):
    """The documents of the fit score alike by either way; more documents than the models have, met in parts."""
    words = [f"w{k * k % 37}" for k in range(2000)]
    rows = [(k, " ".join(words[k * 7 : k * 7 + k % 40])) for k in range(200)] + [(None, "w1 new W4"), (3, "w1"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    target = spark.createDataFrame([(k,) for k in (3, 4, 50, 50)], "doc_id long")
    ranked = lambda frame: sorted([(str(r.doc_id), r.n_words, *(None if x is None else round(x, 9) for x in r[2:])) for r in frame.collect()], key=str)
    whole = lm_score.fit(spark, docs, target)
    assert ranked(lm_score.score_own(spark, whole)) == ranked(lm_score.score(spark, docs, whole))
    few = lm_score.fit(spark, docs.limit(20), target)
    expected = ranked(lm_score.score(spark, docs, few))
    monkeypatch.setattr(lm_score, "SPLIT", 200)
    assert ranked(lm_score.score(spark, docs, few)) == expected


def test_lm_cuts_a_slice_of_a_batch():
    """All slices of a batch but the first begin within its bytes."""
    texts = pa.array([f"Some WORDS Öl {k}\n" * (k % 3) for k in range(40)], pa.string())
    for some in (pa.array(["A b", None]), texts, texts.slice(7), texts.slice(20, 9), texts.cast(pa.large_string()).slice(5)):
        words, document = lm_score.cut(some)
        plain = [re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").split() for t in some.to_pylist()]
        assert words.to_pylist() == [w for x in plain for w in x]
        assert document.tolist() == [k for k, x in enumerate(plain) for _ in x]


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256, 0], [2**62 + 5, 3]])
def test_lm_numbers_packed_and_back(numbers):
    numbers = np.array(numbers, np.int64)
    assert (lm_score.unpacked(lm_score.packed(numbers)) == numbers).all()
    assert (lm_score.opened(lm_score.sealed(np.sort(numbers))) == np.sort(numbers)).all()
