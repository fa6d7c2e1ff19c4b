"""Similarity join, alias groups and mentions against all pairs."""

import random
import re
import time
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from compare import SF
from pyspark.sql import functions as F

from studyweave.functions import rules
from studyweave.operators import mentions, similar
from studyweave.plans import catalog, graph_queries


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def spoiled(rng, name):
    name = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(name) + 1)
        name[at : at + rng.randint(0, 2)] = rng.choices("abcde xyz", k=rng.randint(0, 2))
    return "".join(name)


@pytest.mark.parametrize("least", [0.65, 0.85, 0.9, 1.0])
def test_alike_equals_all_pairs(spark, least):
    rng = random.Random(int(100 * least))
    names = {"".join(rng.choices("abcde xyz", k=rng.randint(1, 30))) for _ in range(40)}
    names = sorted(names | {spoiled(rng, n) for n in names for _ in range(3)} | {"a", "ab", "aa", "é", "éa"})
    df = spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "low string")
    got = {(r.low, r.other): r.ratio for r in similar.alike(df, df, least).collect()}
    assert got == {(a, b): ratio(a, b) for a in names if a for b in names if b and ratio(a, b) >= least}


def test_segments_cover_a_name():
    for least in (0.6, 0.78, 0.9):
        for n in range(1, 80):
            cut = similar.segments(n, least)
            assert cut[0][0] == 0 and cut[-1][1] == n and all(a < b for a, b in cut) and all(x[1] == y[0] for x, y in zip(cut, cut[1:]))
    with pytest.raises(ValueError):
        similar.alike(None, None, 0.5)


def plain_groups(rows, least):
    """Groups by comparing all pairs."""
    names = sorted(n for n, _ in rows)
    up = {n: n for n in names}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bare = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    for a, b in combinations(names, 2):
        x, y = sorted((a.lower(), b.lower()))
        if bare(a) == bare(b) or ratio(x, y) >= least:
            up[top(b)] = top(a)
    groups = {}
    for n, m in rows:
        groups.setdefault(top(n), []).append((-m, len(n), n))
    return {n: (min(g)[2], len(g)) for g in groups.values() for _, _, n in g}


def test_alias_groups_of_every_part_name(spark):
    rows = [(r.name, r.mentions) for r in graph_queries._spelt_names(spark, SF).collect()]
    want = plain_groups(rows, 0.9)
    got = {r.name: (r.canonical, r.members) for r in catalog.queries()["alias_groups"](spark, SF).collect()}
    assert got == want and sum(n > 1 for _, n in want.values()) > 100


def test_alias_groups_in_chains(spark):
    rows = [("heat transfer", 5), ("heat transfers", 9), ("heat transfersx", 1), ("HEAT-TRANSFER", 9), ("entropy", 2), ("x", 1), ("X", 1), ("", 4), (None, 1), ("ß", 1), ("é", 2)]
    got = {r.name: (r.canonical, r.members) for r in similar.alias_groups(spark.createDataFrame(rows, "name string, mentions long")).collect()}
    assert got == plain_groups([r for r in rows if r[0]], 0.9)
    assert got["heat transfersx"] == ("HEAT-TRANSFER", 4)
    assert similar.alias_groups(spark.createDataFrame([], "name string, mentions long")).count() == 0


def test_rewritten_edges(spark):
    groups = spark.createDataFrame([("a", "A", 2), ("A", "A", 2), ("b", "b", 1)], "name string, canonical string, members long")
    edges = spark.createDataFrame([("a", "b", "R", 0.4), ("A", "b", "R", 0.6), ("a", "A", "R", 1.0), ("b", "new", "R", 0.2)], "src string, dst string, type string, confidence double")
    got = {tuple(r) for r in similar.rewrite_aliases(edges, groups).collect()}
    assert got == {("A", "b", "R", 0.6), ("b", "new", "R", 0.2), ("a", "A", "ALIAS_OF", 1.0)}


def test_rewrite_on_whole_tables(spark):
    groups = {r.name: r.canonical for r in catalog.queries()["alias_groups"](spark, SF).collect()}
    got = {(r.src, r.dst, r.type) for r in catalog.queries()["alias_rewrite"](spark, SF).collect()}
    brands = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        brands.setdefault(r.p_brand, set()).add(r.p_name)
    want = {(groups[min(names)], groups[n], "RELATED_TO") for names in brands.values() for n in names if groups[min(names)] != groups[n]}
    assert got == want | {(n, c, "ALIAS_OF") for n, c in groups.items() if n != c}


CHUNKS = "doc_id long, idx int, full_text string, own array<string>"
NAMES = "doc_id long, name string, idx int, place int"


def test_earlier_names(spark, monkeypatch):
    monkeypatch.setattr(mentions, "SLOT_CHUNKS", 7)
    rng = random.Random(3)
    letters = "abAB "
    chunks, names = [], []
    for d in range(4):
        for i in range(30 if d else 60):
            chunks.append((d, i, None if rng.random() < 0.05 else "".join(rng.choices(letters, k=rng.randint(0, 12))), rng.choice([None, [], ["ab"], ["a", "B"]])))
        mine = {"".join(rng.choices(letters, k=rng.randint(0, 4))) for _ in range(25)}
        names += [(d, n, rng.randrange(25), rng.randrange(4)) for n in sorted(mine)] + [(d, None, 0, 0)]
    want = {}
    for d, i, text, own in chunks:
        held = sorted((f, p, n) for x, n, f, p in names if x == d and n is not None and text is not None and f < i and n.lower() in text.lower() and n not in (own or []))
        want[d, i] = [n for _, _, n in held]
    c, n = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(names + [(99, "a", 0, 0)], NAMES)
    assert {(r.doc_id, r.idx): r.named for r in mentions.earlier_names(c, n).collect()} == want
    assert {(r.doc_id, r.idx): r.named for r in mentions.earlier_names(c, n, 3).collect()} == {k: v[:3] for k, v in want.items()}
    assert mentions.earlier_names(c.limit(0), n).count() == 0
    assert all(r.named == [] for r in mentions.earlier_names(c, n.limit(0)).collect())


def test_many_names_in_one_large_resource(spark):
    """20,000 names over 10 MB of one resource: as many substring tests would be 100,000,000."""
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(250)), lambda k: F.concat(F.lit("term"), F.pmod(F.xxhash64(F.col("id"), k), F.lit(40_000)).cast("string")))).alias("full_text"), F.array().cast("array<string>").alias("own"))
    names = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("term"), F.col("id").cast("string"), F.lit(" ")).alias("name"), F.lit(0).alias("idx"), F.col("id").cast("int").alias("place"))
    began = time.time()
    found = mentions.earlier_names(rows, names).select(F.sum(F.size("named")).alias("n"), F.count("*").alias("rows")).first()
    assert found.rows == 5000 and 500_000 < found.n < 700_000 and time.time() - began < 60


def test_alias_threshold_of_chunks_is_lower():
    assert rules.ALIAS < rules.FUZZY < 0.9
