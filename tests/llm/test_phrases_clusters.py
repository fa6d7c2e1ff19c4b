"""Collocations, substring dedup and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from studyweave.llm import clusters, collocations, repeats, words

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_packed_columns():
    rng = np.random.default_rng(1)
    for dtype in (np.uint64, np.uint32, np.uint16, np.int64):
        x = rng.integers(0, 60_000, 500).astype(dtype)
        assert (words.unpack(words.pack(x), 500, dtype) == x).all()
        x.sort()
        assert (words.unpack(words.pack(x, True), 500, dtype, True) == x).all()
    assert len(words.unpack(words.pack(np.zeros(0, np.uint32)), 0, np.uint32)) == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(words, "HASH_BYTES", 50)
    texts = ["one two  three", "", " two", "three" * 40 + " one", "two\tone\x0bthree"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(r) for r in raw[:-1]])
    h, s, e, owner = words.hashes(np.frombuffer(b"".join(raw), np.uint8), bounds)
    want = [(k, w) for k, r in enumerate(raw) for w in r.split()]
    assert [(o, b"".join(raw)[a:b]) for o, a, b in zip(owner.tolist(), s.tolist(), e.tolist())] == want
    assert len({w: x for (_, w), x in zip(want, h.tolist())}) == len(set(h.tolist())) == len({w for _, w in want})


# ---- substring dedup


def plain_repeats(rows, width):
    """What stays of each (doc_id, text), by a dictionary of all windows."""
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("width", [2, 13])
def test_repeats(spark, docs, rows, empty, width):
    got = in_order(repeats.find_repeats(docs, width).collect())
    assert got == in_order(plain_repeats([(i, t) for i, t, *_ in rows], width))
    assert any(r[2] for r in got)
    assert repeats.find_repeats(empty).count() == 0


def test_repeats_within_and_between(spark, monkeypatch):
    """Passages inside long texts, windows that repeat in one text, extreme ids, small groups of suffixes."""
    monkeypatch.setattr(repeats, "GROUP", 50)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "🙂", "x" * 500]
    passages = [rng.choices(vocabulary, k=rng.choice([12, 13, 14, 40])) for _ in range(12)]
    rows = []
    for i in rng.sample(range(-50, 400), 150):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choices(vocabulary, k=rng.randint(0, 30)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(-(2**63), " ".join(passages[3])), (2**63 - 1, " ".join(passages[3] * 3)), (None, " ".join(passages[3])), (777, "a " * 900), (778, "b " * 5 + "a " * 40), (779, "a " * 13), (778, "a " * 12)]
    got = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert in_order(got.collect()) == in_order(plain_repeats(rows, 13))


def test_drop_repeats(spark, docs, rows):
    left = repeats.drop_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    want = {(i, n): (r, h) for i, n, r, h in plain_repeats([(i, t) for i, t, *_ in rows], 13)}
    before = defaultdict(set)
    for i, t, *_ in rows:
        before[i].add(t)
    for r in left.collect():
        changed = r.text not in before[r.doc_id]
        hits = [h for (i, _), (lost, h) in want.items() if i == r.doc_id and (lost > 0) == changed]
        assert hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest() in hits or not changed


def test_splitters_are_prefixes():
    rng = np.random.default_rng(2)
    path, _ = repeats.paths(words.mix(rng.integers(0, 50, 20_000).astype(np.uint64)), 13)
    borders = repeats.splitters(path, 64)
    assert (np.diff(borders.astype(object)) > 0).all() and len(borders) > 30
    assert sum(int(b) % (1 << 38) == 0 for b in borders) > len(borders) / 2  # most borders need two or three words at most
    assert max(np.bincount(np.searchsorted(borders, path, side="right"))) < 20_000 / 10


# ---- collocations


def plain_collocations(rows, least, longest, best):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[p : p + k])) for p in range(len(w) - k + 1))
    often = {(lang, g): a for (lang, g), a in f.items() if len(g) > 1 and a >= least}
    inside = {(lang, g[x:y]) for (lang, g), b in often.items() for x in range(len(g)) for y in range(x + 2, len(g) + 1) if y - x < len(g) and 100 * b >= 100 * f[lang, g[x:y]]}
    found = defaultdict(list)
    for (lang, g), a in often.items():
        if (lang, g) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, c in found.items() for rank, (s, a, p, x, y) in enumerate(sorted(c)[:best], 1))


@pytest.mark.parametrize("narrow", [1_000_000, 0])
def test_collocations(spark, docs, rows, empty, narrow, monkeypatch):
    monkeypatch.setattr(collocations, "NARROW", narrow)
    monkeypatch.setattr(collocations, "RANGE", 200)
    plain = [(t, lang) for _, t, lang, *_ in rows]
    for least, best in ((3, 2000), (5, 7)):
        want = plain_collocations(plain, least, 5, best)
        assert len(want) > 5
        assert sorted(tuple(r) for r in collocations.collocations(docs, least, 5, best).collect()) == want
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs, 10**6).count() == 0


def test_collocations_in_pieces(spark, monkeypatch):
    """Overlaps, piece ends, languages, upper case outside ASCII, one phrase with most occurrences."""
    monkeypatch.setattr(collocations, "RANGE", 20)
    rng = random.Random(3)
    vocabulary = "New York new york city É é ß ha of the the the".split()
    rows = []
    for k in range(400):
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\r\n", "  "]) for w in rng.choices(vocabulary, k=rng.randint(0, 25)))
        rows.append((text if k % 50 else None, ["en", "de", None, ""][k % 4]))
    rows += [("ha " * 2000, "en"), ("united states of america " * 60, "en"), ("United States of America!" * 60, None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = plain_collocations(rows, 8, 5, 2000)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 8, 5).collect()) == want


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 10**12, 10**13, 3 * 10**12, 10**12 + 7
    row = spark.range(1).select(collocations._score(*(F.lit(x) for x in (a, n, left, right))).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


# ---- clustering


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    if not c:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            if members := [v for (_, v), o in zip(kept, own) if o == n]:
                c[n] = [sum(x) // len(members) for x in zip(*members)]
    last = [near(v) for _, v in kept]
    inertia = Counter()
    for d, n in last:
        inertia[n] += d
    fit = lambda x: x if x < 2**63 else None
    return [(i, n, fit(d), fit(inertia[n]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last)]


def vectors(seed, n, dim, grid=None):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    out = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.4) for x in rng.choice(middles)]
        out.append((i, [round(x * grid) / grid for x in v] if grid else v))
    return out


@pytest.mark.parametrize("rows,k,dim", [
    (vectors(1, 400, 8), 40, 8),
    (vectors(2, 300, 3, 2), 25, 3),  # many ties
    (vectors(3, 12, 4), 40, 4),  # fewer vectors than centroids
    ([(i, [float(i % 3), 1.0]) for i in range(90)], 10, 2),  # equal vectors start several centroids
    (vectors(4, 60, 4) + [(None, [0.5] * 4), (None, [0.5] * 4), (5, [9.0] * 4), (5, [9.0] * 4), (70, None), (71, []), (72, [1.0] * 3), (73, [float("nan")] * 4), (74, [float("inf"), 0.0, 0.0, 0.0]), (75, [None, 1.0, 1.0, 1.0])], 20, 4),
    (vectors(5, 50, 3) + [(90, [1e6, -1e6, 3e5]), (91, [1e6, -1e6, 3e5 + 0.125]), (92, [1e8, 0.0, 0.0]), (93, [3e9, 1.0, 1.0])], 20, 3),  # integers beyond exact doubles
])
def test_clusters(spark, rows, k, dim):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, own int").repartition(4)
    got = [tuple(r) for r in clusters.cluster(df, k, 5, dim).collect()]
    assert in_order(got) == in_order(plain_clusters(rows, k, 5, dim))


def test_clusters_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters.cluster(none).count() == 0
    assert clusters.cluster(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>"), dim=2).count() == 0


def test_filters_leave_little_to_measure():
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 800, (30, 16))
    q = np.rint(middles[rng.integers(0, 30, 4000)] + rng.normal(0, 60, (4000, 16)))
    c = [[int(v) for v in q[k]] for k in range(40)]
    groups = clusters.group_centroids(c)
    assert sorted(sum(groups, [])) == list(range(40)) and len(groups) > 1
    first = clusters.Assigner(c, groups, None)
    own, upper, lower = first.assign(q, np.zeros(4000, int), np.zeros(4000), np.zeros((4000, len(groups))))
    assert first.scanned == 4000 * 40
    for _ in range(5):
        new = [[int(v) for v in np.floor(q[own == k].mean(0))] if (own == k).any() else c[k] for k in range(40)]
        step = clusters.Assigner(new, groups, [clusters._distance(a, b) for a, b in zip(c, new)])
        own, upper, lower = step.assign(q, own.copy(), upper.copy(), lower.copy())
        c = new
        assert (own == clusters.squared(q, np.array(c, float)).argmin(1)).all()
    assert step.scanned < 4000 * 40 / 4
