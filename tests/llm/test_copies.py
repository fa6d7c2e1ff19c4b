"""Exact and near copies against brute force."""

import hashlib
import random
import re

import pytest

from studyweave.llm import components, exact_dedup, near_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact(spark, docs, rows, empty):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i if i is not None else 1 << 62))
    got = exact_dedup.find_copies(docs).collect()
    assert len(got) == len(rows)
    texts = {hashlib.sha256(n.encode()).hexdigest(): (len(g), min(g)[1]) for n, g in groups.items()}
    for r in got:
        size, keep = texts[r.text_sha256]
        assert r.group_size == size and (r.keep_id if r.keep_id is not None else 1 << 62) == keep and r.kept == (r.doc_id == r.keep_id)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(normal(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup.find_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_exact_large_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    hot = got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in hot] == [(0, 1000)]


def test_exact_rows_that_repeat(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (2, "ab", 8), (1, "ab", 9), (None, "x", 1), (None, "x", 1), (None, "y", 1), (3, "z", 1), (3, "other", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, copy_id int").withColumnRenamed("copy_id", "copy_hash").repartition(3)
    left = [tuple(r) for r in exact_dedup.drop_copies(d).collect()]
    assert sorted(left, key=repr) == sorted([(1, "a b", 7), (None, "x", 1), (None, "y", 1), (3, "z", 1), (3, "other", 1)], key=repr)


def test_exact_extreme_ids(spark):
    ends = [-(2**63), 2**63 - 1, -1, 0, None]
    rows = [(i, t) for t in ("same", "other ") for i in ends] + [(2**63 - 1, "last"), (None, "last"), (None, "none"), (-(2**63), "more ")] + [(5, "more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(df.repartition(parts)).collect()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for i in ends:
            for t in ("same", "other"):
                assert got[i, sha(t)] == (-(2**63), 5, i == -(2**63))
        assert got[2**63 - 1, sha("last")] == (2**63 - 1, 2, True) and got[None, sha("last")] == (2**63 - 1, 2, False)
        assert got[None, sha("none")] == (None, 1, True) and got[5, sha("more")] == (-(2**63), 2, False)
        assert sorted(r.text.strip() for r in exact_dedup.drop_copies(df.repartition(parts)).collect()) == ["last", "more", "none", "other", "same"]


def test_exact_over_borders(spark, monkeypatch):
    """Many texts that begin alike, held by more rows than a range takes, and texts of white space before them."""
    rng = random.Random(6)
    begin = "the same beginning of very many texts that goes on for more than the splitters can tell apart"
    rows = [(i, " " * rng.choice([0, 0, 400]) + begin + str(rng.randrange(40)) + " " * rng.randrange(3)) for i in range(1500)] + [(2000 + i, f"text {i % 200}") for i in range(500)]
    rng.shuffle(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    ids, up = sorted(sets), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near(spark, docs, rows, empty, width):
    want = brute([(i, t) for i, t, *_ in rows], width, 80)
    got = near_dedup.near_copies(docs, width, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    by_id = {i: {len(shingles(t, width)) for j, t, *_ in rows if j == i} for i, *_ in rows}
    assert all(r.n_shingles in by_id[r.doc_id] for r in got)
    assert near_dedup.near_copies(empty).count() == 0 and near_dedup.drop_near_copies(docs).columns == docs.columns


def test_near_at_the_threshold(spark):
    """Pairs at and just under 80 %, chains, and a passage that many documents share."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    passage = rng.choices(words, k=60)
    for _ in range(40):
        size = rng.choice([5, 9, 13, 50, 120, 400])
        base = rng.choices(words, k=size)
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, size // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy + (passage if rng.random() < 0.4 else []))))
            n += 1
            base = copy if rng.random() < 0.5 else base
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows, 4, 80)


@pytest.mark.parametrize("percent,exact", [(35, False), (80, True)])
def test_near_other_thresholds(spark, percent, exact):
    rng = random.Random(percent)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for n in range(30):
        base = rng.choices(words, k=rng.choice([4, 60, 200]))
        other = base[: int(len(base) * rng.uniform(0.3, 1))]
        rows += [(3 * n, " ".join(base)), (3 * n + 1, " ".join(other + rng.choices(words, k=rng.randint(0, len(base) // 2)))), (3 * n + 2, " ".join(rng.choices(words, k=40)))]
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, percent, exact)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows, 4, percent)


def test_near_common_text(spark, monkeypatch):
    """Documents that share most of their words without being copies, and copies among them, in lists that are long."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", 8)
    rng = random.Random(13)
    words = [f"w{k}" for k in range(5000)]
    common = rng.choices(words, k=170)
    rows = [(n, " ".join(common + rng.choices(words, k=rng.choice([15, 30, 45])))) for n in range(150)]
    rows += [(500 + n, " ".join(common + words[:20] + rng.choices(words, k=3))) for n in range(30)] + [(600, " ".join(common[:150])), (601, " ".join(common))]
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows, 4, 80)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
