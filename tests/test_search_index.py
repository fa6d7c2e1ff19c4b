"""The stored text index against plain readings: stems, cover density, top-k with skipping, updates."""

import glob
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from compare import SF

from studyweave.functions.stems import STOP, Stems, stem
from studyweave.operators import retrieval, text_index
from studyweave.operators.text_index import TextIndex
from studyweave.plans import catalog
from studyweave.plans.search_queries import _asks

# Published pairs of words and stems.
PAIRS = """consign consign consigned consign consignment consign consist consist consistency consist consolation consol consolatory consolatori consolidate consolid
consoling consol conspicuous conspicu conspiracy conspiraci conspirator conspir constable constabl constancy constanc knack knack knavish knavish kneaded knead
knees knee knightly knight knitting knit knives knive generate generat general general generously generous communism communism happy happi cry cri by by say say
cries cri ties tie gas gas gaps gap this this kiwis kiwi hopping hop hoping hope luxuriated luxuri falling fall sensational sensat relational relat electricity electr
adjustment adjust adoption adopt rate rate controlling control roll roll agreed agre feed feed skies sky dying die triplicate triplic formative format
hopefulness hope analogies analog vietnamization vietnam replacement replac irritant irrit probate probat cease ceas proceeds proceed inning inning""".split()


def test_stems():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2]))
    terms = Stems(most=3)
    assert terms["the"] is None and [terms[w] for w in ("running", "runs", "a", "runs")] == ["run", "run", None, "run"] and len(terms) <= 3
    assert len(STOP) > 120


def plain_density(hits):
    """Every pair of places that holds all terms and nothing smaller that does."""
    wanted, total = {t for _, t, _ in hits}, 0.0
    full = lambda a, b: {t for _, t, _ in hits[a : b + 1]} == wanted
    for a in range(len(hits)):
        for b in range(a, len(hits)):
            if full(a, b) and not full(a + 1, b) and not full(a, b - 1):
                noise = hits[b][0] - hits[a][0] - (b - a)
                total += (b - a + 1) / sum(1 / w for _, _, w in hits[a : b + 1]) / (1 + noise)
            if full(a, b):
                break
    return total


def plain_ranked(asks, chunks, k):
    """(query, chunk, score, rank) over (id, [(field text, weight)])."""
    terms = lambda text: [None if w in STOP else stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
    read = {i: [(p, t, w) for p, (t, w) in enumerate((t, w) for text, w in fields for t in terms(text)) if t is not None] for i, fields in chunks}
    out = []
    for q, text in asks:
        wanted = set(terms(text)) - {None}
        found = []
        for i, words in read.items():
            hits = [h for h in words if h[1] in wanted]
            if wanted and {t for _, t, _ in hits} == wanted:
                found.append((-round(plain_density(hits), 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_density_is_that_of_all_windows():
    rng = random.Random(1)
    for _ in range(300):
        m = rng.randint(1, 4)
        hits = sorted({rng.randrange(60): (rng.randrange(m), rng.choice("ABCD")) for _ in range(rng.randint(1, 25))}.items())
        lists = [np.array([4 * p + "DCBA".index(c) for p, (t, c) in hits if t == x]) for x in range(m)]
        if all(len(x) for x in lists):
            assert abs(text_index.cover_density(lists) - plain_density([(p, t, text_index.CLASSES[c]) for p, (t, c) in hits])) < 1e-9


def test_ranked_text_on_whole_tables(spark):
    """Every ask over every document, by a search of all windows."""
    from studyweave.plans.retrieval_queries import _chunks

    asks = [(r.query_id, r.text) for r in _asks(spark, SF).collect()]
    chunks = [(r.chunk_id, [(r.role, 1.0), (r.full_text, 0.4)]) for r in _chunks(spark, SF).collect()]
    got = sorted(tuple(r) for r in catalog.queries()["ranked_text"](spark, SF).select("query_id", "chunk_id", "score", "rank").collect())
    want = sorted(plain_ranked(asks, chunks, 10))
    assert len(want) > 50
    assert [(q, i, pytest.approx(s, abs=2e-6), r) for q, i, s, r in want] == got


CHUNKS = "chunk_id long, full_text string, cell string"
WORDS = "river stone light garden market window letter morning silver thunder copper valley harbour candle meadow winter forest bridge island shadow".split()


def some_chunks(n=3000, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 12)) + (["the"] * 3) + ([f"rare{i // 300}"] if i % 300 < 4 else [])), "x") for i in range(-200, n)]
    return rows + [(5_000_000, None, "x"), (5_000_001, "", None), (None, "river", "x"), (2**40, "river " * 5000, "x")]


def test_search_equals_a_full_scan_and_skips(spark, tmp_path):
    chunks = spark.createDataFrame(some_chunks(), CHUNKS)
    queries = spark.createDataFrame([(1, "rare3 river"), (2, "Rare7, rare2"), (3, "the"), (4, None), (5, "nowhere"), (6, "copper candle winter island")], "query_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i"), stemmed=False).build(chunks)
    best, reads = index.search_with_reads(queries, 10)
    vectors = chunks.where("chunk_id is not null").withColumns({"embedding": text_index.F.array().cast("array<double>"), "resource_id": text_index.F.lit("r"), "page_number": text_index.F.lit(1)})
    full = retrieval.hybrid_search(queries.withColumn("embedding", text_index.F.array().cast("array<double>")), vectors, 10, 0.0, 1.0, page_proximity=False).where("bm25 > 0")
    assert sorted((r.query_id, r.chunk_id, r.bm25, r["rank"]) for r in best.collect()) == sorted((r.query_id, r.chunk_id, r.bm25, r["rank"]) for r in full.collect())
    assert {r.query_id for r in reads.collect()} == {1, 2, 3, 6}
    first, reads = index.search_with_reads(queries, 3)
    assert {(r.query_id, r.chunk_id) for r in first.collect()} == {(r.query_id, r.chunk_id) for r in best.where("rank <= 3").collect()}
    read = {r.query_id: (r.cells, r.read) for r in reads.collect()}
    assert read[1][0] >= 14 and read[1][1] <= 3  # the rare word's cell is enough
    assert index.search(spark.createDataFrame([], queries.schema)).count() == 0
    empty = TextIndex(spark, str(tmp_path / "e")).build(chunks.limit(0))
    assert empty.search(queries).count() == 0 and empty.ranked(queries).count() == 0


def test_update_writes_only_folders_of_changes(spark, tmp_path):
    rows = some_chunks(20_000, 3)
    path = str(tmp_path / "i")
    chunks = spark.createDataFrame(rows, CHUNKS)
    index = TextIndex(spark, path).build(chunks)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/part=*/*.parquet")}
    now = [(i, "entirely new stones", c) if i == 3 else (i, t, c) for i, t, c in rows if i is not None and i != 5 and i < 5_000_000] + [(9_000, "again", "x")]
    now = spark.createDataFrame(list({r[0]: r for r in now}.values()), CHUNKS)
    index.update(now, spark.createDataFrame([(3,), (5,), (9_000,), (5_000_000,), (5_000_001,), (2**40,), (None,)], "chunk_id long"))
    same = {f for f, t in before.items() if os.path.exists(f) and os.path.getmtime(f) == t}
    parts = defaultdict(set)
    for f in before:
        parts[f in same].add(re.search("part=(-?[0-9]+)", f)[1])
    assert parts[False] == {"0", "1", str(5_000_000 // 8192), str(2**40 // 8192)} and len(parts[True]) >= 2
    fresh = TextIndex(spark, str(tmp_path / "f")).build(now)
    asks = spark.createDataFrame([(1, "stone"), (2, "entire stones"), (3, "rare3"), (4, "river the light"), (5, "again")], "query_id long, text string")
    for way in ("search", "ranked"):
        assert sorted(map(tuple, getattr(index, way)(asks).collect())) == sorted(map(tuple, getattr(fresh, way)(asks).collect()))
    assert {r.chunk_id for r in index.ranked(asks).where("query_id = 2").collect()} == {3}


def test_probing_finds_nearly_all(spark):
    """Two thirds of the lists hold at least nine tenths of the exact nearest, over every benchmark vector, which have hardly any clusters."""
    from studyweave.operators.vector_index import VectorIndex
    from studyweave.plans.retrieval_queries import _chunks, _queries

    sf = os.path.join(os.path.dirname(SF), "sf0.1")
    queries, chunks = _queries(spark, sf), _chunks(spark, sf).where("embedding is not null")
    index = VectorIndex.build(spark, text_index.staged(spark.range(1), "x").inputFiles()[0].rsplit("/", 1)[0] + "-vectors", chunks, 64)
    exact = {(r.query_id, r.chunk_id) for r in retrieval.hybrid_search(queries.where("embedding is not null"), chunks, 10, 1.0, 0.0, page_proximity=False).collect()}
    lists = len(index.centroids)
    assert lists > 30
    found = {(r.query_id, r.chunk_id) for r in index.search(queries, 10, -(-2 * lists // 3)).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) > 500
    assert {(r.query_id, r.chunk_id) for r in index.search(queries, 10, lists).collect()} == exact


def test_vector_index_of_odd_rows(spark, tmp_path):
    from studyweave.operators.vector_index import VectorIndex

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(400)] + [(400 + i, [1.0, 2.0, 3.0]) for i in range(300)]
    odd = [(900, None), (901, []), (902, [0.0] * 3), (903, [1.0] * 4), (904, [float("nan")] * 3), (905, [None, 1.0, 1.0]), (None, [1.0] * 3)]
    ddl = "chunk_id long, embedding array<double>"
    index = VectorIndex.build(spark, str(tmp_path / "v"), spark.createDataFrame(rows + odd, ddl), 3, lists=9)
    index.extend(spark.createDataFrame([(1000, [3.0, 2.0, 1.0]), (1001, None)], ddl))
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, None), (4, [0.0] * 3), (5, [1.0])], "query_id long, embedding array<double>")
    every = {i: np.array(v) / np.linalg.norm(v) for i, v in [*rows, (1000, [3.0, 2.0, 1.0])]}
    for probes in (9, 100):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.sim) for r in index.search(queries, 5, probes).collect()}
        want = {}
        for q, v in ((1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])):
            unit = np.array(v) / np.linalg.norm(v)
            for n, (s, i) in enumerate(sorted((-round(float(unit @ u), 6), i) for i, u in every.items())[:5], 1):
                want[q, n] = (i, -s)
        assert got == want
    assert os.path.isdir(tmp_path / "v" / "list=0")
    none = VectorIndex.build(spark, str(tmp_path / "n"), spark.createDataFrame(odd, ddl), 3)
    assert none.search(queries, 5, 3).count() == 0
