"""Operators on literal rows and against plain Python."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from studyweave.operators import graph, learner, linking, quality, retrieval, reward
from studyweave.streaming import learners

CHUNK = "doc_id long, idx int, chunk_id string, section_title string, section_level int, full_text string, key_concepts array<string>, prerequisites array<string>, topic array<string>, content_type string"


def chunk_rows(spark):
    rows = [(1, 0, "a", "Introduction", 1, "t0", ["heat"], [], ["x"], "summary"), (1, 1, "b", "Methods", 2, "t1", ["flux"], ["Heat"], ["y"], "definition"), (1, 2, "c", "", 2, "t2", ["law"], ["flux", "none"], ["y"], "example"), (1, 3, "d", "", 2, "t3", ["heat"], ["law"], ["z"], "unknown")]
    return spark.createDataFrame(rows, CHUNK)


def test_links_and_prerequisites(spark):
    c = chunk_rows(spark)
    got = linking.links(c).orderBy("idx").collect()
    assert [(r.previous_chunk_id, r.next_chunk_id, r.parent_section_id) for r in got] == [(None, "b", "Introduction"), ("a", "c", "Methods"), ("b", "d", "Methods"), ("c", None, "Methods")]
    edges = linking.prerequisite_links(c, ["key_concepts"])
    assert sorted((r.idx, r.term, r.prereq_idx) for r in edges.collect()) == [(1, "heat", 0), (2, "flux", 1), (3, "law", 2)]
    assert sorted((r.idx, r.depth) for r in linking.chain_depth(c, edges).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_transitions(spark):
    c = linking.continuity(chunk_rows(spark), F.lit(0.1))
    got = linking.topic_transitions(c).orderBy("idx").collect()
    assert [r.is_topic_start for r in got] == [False, True, True, True]
    assert [r.transition_confidence for r in got] == [0.0, 0.75, 0.6, 0.6]
    assert [r.is_topic_end for r in got] == [True, True, True, False]


def test_diff(spark):
    old = spark.createDataFrame([("i1", "r", 1, 0, "a", 0), ("i2", "r", 1, 0, "later copy", 1), ("i3", "r", 2, None, None, 2), ("i4", "r", 3, 0, "gone", 3)], "id string, resource_id string, page_number int, source_offset int, full_text string, pos long")
    new = spark.createDataFrame([("r", 1, 0, "first", 0), ("r", 1, 0, "a", 1), ("r", 2, 0, "", 2), ("r", None, 5, "new", 3)], "resource_id string, page_number int, source_offset int, full_text string, pos long")
    got = {(r.page_number, r.source_offset): (r.action, r.id) for r in linking.diff(new, old).collect()}
    assert got == {(1, 0): ("unchanged", "i1"), (2, 0): ("unchanged", "i3"), (3, 0): ("delete", "i4"), (0, 5): ("insert", None)}


def test_mastery_fold_equals_steps(spark):
    rng, rows, want = random.Random(3), [], {}
    for user in range(4):
        m = 0.0
        for k in range(60):
            right = rng.random() < (0.3, 0.9, 0.5, 0.1)[user]
            rows.append((user, "c", datetime(2025, 1, 1) + timedelta(hours=7 * k), k, right))
            m = min(1.0, max(0.0, m + (0.1 if right else -0.05)))
        want[user] = round(m, 6)
    rng.shuffle(rows)
    got = learner.mastery(spark.createDataFrame(rows, "user_id long, concept string, ts timestamp, seq long, right boolean"))
    assert {r.user_id: r.mastery for r in got.collect()} == want


def test_levels(spark):
    df = spark.createDataFrame([(x,) for x in (None, -0.1, 0.0, 0.3, 0.6, 0.8, 1.0, 1.01)], "m double")
    assert [r[0] for r in df.select(learner.level(F.col("m"))).collect()] == ["beginner", "beginner", "beginner", "developing", "proficient", "mastering", "mastering", "beginner"]


def test_graph_prune(spark):
    # an isolated node, a hub, a weak edge, one without confidence and a cycle of three
    nodes = spark.createDataFrame([(k,) for k in [1, 2, 3, 4, 9, *range(20, 26)]], "key long")
    e = [(1, 2, "P", 0.9), (2, 3, "P", 0.5), (3, 1, "P", 0.8), (3, 4, "P", None), (1, 4, "P", 0.1)] + [(20, k, "P", 0.9) for k in range(21, 26)]
    edges = spark.createDataFrame(e, "src long, dst long, type string, confidence double")
    n, left = graph.prune(nodes, edges, most_degree=4, cycle_length=4)
    assert sorted(r.key for r in n.collect()) == [1, 2, 3, 4, 21, 22, 23, 24, 25]
    assert sorted((r.src, r.dst) for r in left.collect()) == [(1, 2), (3, 1), (3, 4)]


def plain_components(edges):
    """Nodes that reach each other, by reachability of all pairs."""
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)

    def reach(x):
        seen, stack = set(), [x]
        while stack:
            for y in after.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        return seen

    r = {x: reach(x) for x in after}
    return {x: max(y for y in r[x] if x in r.get(y, ())) for x in r if x in r[x]}


@pytest.mark.parametrize("n,m,trims", [(30, 40, 30), (30, 90, 30), (60, 70, 1), (25, 24, 0)])
def test_strong_components(spark, n, m, trims):
    rng = random.Random(n + m)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = plain_components(edges)
    assert {r.node: r.component for r in graph.strong_components(df, trims).collect()} == want
    on = {(a, b) for a, b in edges if a != b and want.get(a) is not None and want.get(a) == want.get(b)}
    assert {(r.src, r.dst) for r in graph.cyclic_edges(df).collect()} == on


def test_graph_without_cycles_ends_after_trimming(spark):
    edges = spark.range(1_000_000).select((F.col("id") % 200_000).alias("src"), (F.col("id") % 200_000 + 1 + F.pmod(F.xxhash64("id"), F.lit(90_000))).alias("dst"))
    assert graph.cyclic_edges(edges.where("dst > src")).isEmpty()


def test_most_cycles(spark):
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src long, dst long")
    every = sorted((len(r.path), r.path) for r in graph.cycles(edges, 4).collect())
    assert len(every) == 15 + 40 + 90
    assert [r.path for r in graph.cycles(edges, 4, most=20).collect()] == [p for _, p in every[:20]]


def test_pairs_of_large_and_repeated_chunks(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIR_ROWS", 3)
    chunks = [("a", list("abcdefgh")), ("a", ["a", "z", "a"]), ("b", ["b", "a", None]), ("c", ["x"]), ("d", []), ("e", None)]
    got = {(r.a, r.b): r.chunks for r in graph.co_occurrence(spark.createDataFrame(chunks, "chunk string, concepts array<string>")).where("a is not null and b is not null").collect()}
    want = {}
    for names in (sorted(set("abcdefghz")), ["a", "b"]):
        for p in combinations(names, 2):
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_cycles_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 5), (5, 6)], "src long, dst long")
    assert sorted(tuple(r.path) for r in graph.cycles(edges, 5).collect()) == [(1, 2), (1, 2, 3)]


def test_merges(spark):
    rows = spark.createDataFrame([("k", "First", 1, 1), ("k", "Second", 5, 2), ("", "none", 1, 3)], "key string, display_name string, seen int, seq int")
    assert [tuple(r) for r in graph.merge_nodes(rows).collect()] == [("k", "First", 1, 5, 2)]
    e = spark.createDataFrame([("a", "b", "P", 0.2, "c1", 1), ("a", "b", "P", 0.9, "c2", 2), ("a", "a", "P", 1.0, "c", 3)], "src string, dst string, type string, confidence double, evidence string, seq int")
    assert [tuple(r) for r in graph.merge_edges(e).collect()] == [("a", "b", "P", 0.9, "c1")]


HIT = "query_id long, chunk_id string, resource_id string, page_number int, source_offset int, snippet string, role string, score double, sim double, bm25 double, rank int"


def test_reranking(spark):
    rows = [(1, "a", "r1", 1, 0, "s", "example", 0.40, 0.1, 0.0, 1), (1, "b", "r1", 1, 10, "s", "definition", 0.30, 0.35, 0.0, 2), (1, "c", "r2", None, 0, "s", None, 0.1, None, 0.1, 3), (2, "d", "r2", 1, 0, "s", None, 0.0, 0.0, 0.0, 1)]
    hits = spark.createDataFrame(rows, HIT)
    assert sorted(r.chunk_id for r in retrieval.relevant(hits).collect()) == ["a", "b"]
    assert sorted(r.chunk_id for r in retrieval.relevant(hits, relax=True).collect()) == ["a", "b", "d"]
    got = {r.chunk_id: (r.score, r["rank"]) for r in retrieval.pedagogy_boost(hits, ["definition", "example"]).where("query_id = 1").collect()}
    assert got == {"a": (0.6, 1), "b": (0.55, 2), "c": (0.1, 3)}
    assert sorted(r.chunk_id for r in retrieval.spread_pages(hits).collect()) == ["a", "c", "d"]


def test_hybrid_search_against_plain(spark):
    rng = random.Random(5)
    words = ["heat", "flux", "rod", "law", "cold"]
    chunks = [(i, "r", i % 15, " ".join(rng.choices(words, k=rng.randint(0, 9))), None if i % 4 == 0 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    asked = [(q, " ".join(rng.choices(words, k=2)), [rng.uniform(-1, 1) for _ in range(4)]) for q in range(3)]
    c = spark.createDataFrame(chunks, "chunk_id long, resource_id string, page_number int, full_text string, embedding array<double>")
    got = retrieval.hybrid_search(spark.createDataFrame(asked, "query_id long, text string, embedding array<double>"), c, 5).collect()
    import math

    mean = sum(len(t.split()) for _, _, _, t, _ in chunks) / 40
    for q, text, v in asked:
        scores = []
        for cid, _, page, t, e in chunks:
            dot = 0.0 if e is None else sum(a * b for a, b in zip(v, e)) / math.dist(v, [0] * 4) / math.dist(e, [0] * 4)
            bm = 0.0
            for w in set(text.split()):
                df, tf = sum(w in x[3].split() for x in chunks), t.split().count(w)
                bm += math.log(1 + (40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / mean))
            scores.append((-(0.7 * dot + 0.3 * bm / (1 + bm)) * max(1, 1 + max(0, 10 - page) * 0.02), cid))
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in sorted(scores)[:5]]


RESPONSE = "response string, focus_concept string, learning_path array<string>, intent string, affect string, action string, retrieved_ids array<string>, cited_ids array<string>"


def test_rewards(spark):
    good = "Heat is energy because molecules move. For example, a metal rod warms when one end is held in a flame, and so the other end gets warm in time as well. Can you explain why this is so in your own words now?"
    rows = [(good, "heat", ["heat", "tensor"], "question", "neutral", "explain", ["c1"], ["c1"]), ("tensor", "heat", ["heat", "tensor"], "answer", "unsure", "explain", ["c1"], ["zz"]), (None, None, [], None, None, None, [], [])]
    a, b, c = reward.score_responses(spark.createDataFrame(rows, RESPONSE)).collect()
    assert a.rubric == 1.0 and a.total >= 0.65 and a.flags == []
    assert b.gating == 0.2 and b.intent_score == 0.7 and b.grounding == 0.4
    assert {"advanced_concept_drift", "unknown_grounding_ids", "grounding_low", "gating_below_threshold"} <= set(b.flags)
    assert c.grounding == 0.5 and c.style == 0.5


def test_preferences_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 0.9, 0.1), (1, 2, 0.9, 0.1), (2, 0, None, None)], "observation_id long, candidate int, total double, critic_confidence double")
    got = {r.observation_id: (r.chosen, r.scores) for r in reward.preferences(df).collect()}
    assert got == {1: (1, [0.7, 0.86, 0.86]), 2: (0, [0.4])}


def test_redaction(spark):
    df = spark.createDataFrame([((1, "m"), ("s", 2))], "user struct<user_id:int,message:string>, session struct<session_id:string,turn_index:int>")
    out = reward.redact(df)
    assert out.schema["user"].dataType.names == ["message"] and out.schema["session"].dataType.names == ["turn_index"]


def test_quality_report(spark):
    f = "array<struct<id:string,latex:string,type:string,variables:array<string>>>"
    ddl = f"full_text string, domain array<string>, topic array<string>, subtopic array<string>, prerequisites array<string>, learning_objectives array<string>, formulas {f}, context struct<previous_chunk_summary:string>, relationships struct<previous_chunk_id:string>, continuity struct<s:double>, sequence struct<p:int>, complexity struct<b:int>"
    full = ("t", ["d"], ["t"], ["s"], ["p"], ["o"], [("i", "l", "t", ["x"])], ("p",), ("a",), (0.1,), (1,), (2,))
    r = quality.report(spark.createDataFrame([full, (None,) * 12], ddl)).first()
    assert (r.total, r.formulas_preserved, r.tags_hierarchical, r.checks_passed, r.least_richness, r.most_richness, r.grade) == (2, 100.0, 50.0, 3, 0, 100, "F")
    assert quality.report(spark.createDataFrame([], ddl)).first().grade == "F"


def test_streamed_explains(spark, tmp_path):
    rows = [(1, t, a) for t, a in enumerate(["explain", "explain", "ask", "explain"])] + [(2, 0, "hint")]
    spark.createDataFrame(rows, "session_id long, turn long, action string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, turn long, action string").parquet(str(tmp_path / "in"))
    out = learners.run_once(learners.explain_stream(stream), str(tmp_path / "out"))
    assert sorted((r.session_id, r.turn, r.consecutive_explains) for r in out.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 1), (2, 0, 0)]


def test_semantic_chunks_over_blocks(spark):
    """Documents cut into blocks of any size give the spans of the fold over the whole document."""
    import random

    from studyweave.operators import chunking

    rng, rows, texts = random.Random(4), [], {}
    for doc in [*range(12), None]:
        texts[doc] = [(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 9))), rng.choice([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], None])) for _ in range(rng.choice([1, 2, 5, 40, 90]))]
        rows += [(doc, k, s, v) for k, (s, v) in enumerate(texts[doc])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, embedding array<double>")

    def near(u, v):
        return sum(x * y for x, y in zip(u, v)) / sum(x * x for x in u) ** 0.5 / sum(x * x for x in v) ** 0.5 if u and v else 0.0

    for least, most, overlap, block in ((8, 20, 1, 7), (5, 12, 0, 3), (6, 30, 3, 2), (4, 3, 2, 4), (8, 20, 1, 512)):
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.idx, r.source_offset, r.full_text) for r in chunking.semantic_chunks(df, 0.5, least, most, overlap, block).collect())
        want = []
        for doc, parts in texts.items():
            spans = chunking.semantic_spans([len(s.split()) for s, _ in parts], [near(u, v) for (_, u), (_, v) in zip(parts, parts[1:])], 0.5, least, most, overlap)
            want += [((doc is None, doc or 0), k, sum(len(s) + 1 for s, _ in parts[:a]), " ".join(s for s, _ in parts[a:b])) for k, (a, b) in enumerate(spans)]
        assert got == sorted(want), (least, most, overlap, block)
    assert chunking.semantic_chunks(df.limit(0)).count() == 0


def test_late_answers(spark, tmp_path):
    """Shuffled files give the fold in order of time; what the watermark has passed is settled, older answers are left out."""
    import datetime as dt
    import random

    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3), rng.choice("ab"), t0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 12)), k, rng.random() < 0.6) for k in range(400)]
    rows += [(1, "a", t0 + dt.timedelta(hours=h), 1000 + h, h % 2 == 0) for h in range(30)] + [(2, "a", rows[0][2], 5000, True), (2, "a", None, 5001, True)]
    ddl = "user_id long, concept string, ts timestamp, seq long, right boolean"

    def run(files, late):
        folder = tmp_path / f"in-{late.split()[0]}"
        for k, part in enumerate(files):
            path = str(folder / f"{k:03}")
            spark.createDataFrame(part, ddl).coalesce(1).write.parquet(path)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")
        with learners.rocksdb(spark):
            return learners.run_once(learners.late_mastery_stream(stream, late), str(tmp_path / f"out-{late.split()[0]}"), "update").collect()

    def want(rows):
        out = {}
        for user, concept, ts, seq, right in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[3])):
            m, n, c = out.get((user, concept), (0.0, 0, 0))
            out[user, concept] = (min(1.0, max(0.0, m + (0.1 if right else -0.05))), n + 1, c + right)
        return out

    def last(out):
        found = {}
        for r in sorted(out, key=lambda r: (r.attempts, r.batch)):
            found[r.user_id, r.concept] = (r.mastery, r.attempts, r.correct)
        return found

    def same(a, b):
        assert a.keys() == b.keys()
        for k in a:
            assert abs(a[k][0] - b[k][0]) < 1e-9 and a[k][1:] == b[k][1:], k

    rng.shuffle(rows)
    same(last(run([rows[k::5] for k in range(5)], "40 days")), want(rows))  # nothing is settled
    # bounded disorder: rows up to about a day from their place
    near = sorted((r for r in rows if r[2]), key=lambda r: r[2] + dt.timedelta(hours=rng.randint(0, 24)))
    size = len(near) // 6
    out = run([near[k * size : (k + 1) * size if k < 5 else None] for k in range(6)], "2 days")
    same(last(out), want(near))
    assert min(r.waiting for r in out if r.batch == max(x.batch for x in out)) < max(r.attempts for r in out)
    # far behind the watermark: left out
    old = (1, "a", t0 - dt.timedelta(days=90), 9999, True)
    same(last(run([near[: len(near) // 2], near[len(near) // 2 :], [old]], "3 days")), want(near))


def test_pairs_of_all_concepts(spark):
    from itertools import combinations

    from studyweave.operators import graph

    chunks = {1: list("gfedcba"), 2: list("fg"), 3: ["a", "a"], 4: []}
    d = spark.createDataFrame(list(chunks.items()) + [(5, None)], "chunk int, concepts array<string>")
    want = {}
    for concepts in chunks.values():
        for pair in combinations(sorted(set(concepts)), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r.a, r.b): (r.weight, r.chunks) for r in graph.co_occurrence(d, 0.5).collect()} == {p: (n * 0.5, n) for p, n in want.items()}


def test_whole_responses_count(spark, tmp_path):
    """What stands after 200 characters of a turn changes the scores of queries without SQL."""
    from studyweave.plans import catalog

    def run(name, end):
        path = tmp_path / f"{name}-{len(end)}"
        turns = [(3, 0, "assistant", "plain text " * 20 + end), (4, 1, "assistant", "plain text " * 20)]
        spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(path / "conversations.parquet"))
        return {tuple(r) for r in catalog.queries()[name](spark, str(path)).collect()}

    for name in ("stepwise_rubric", "evaluation_deltas"):
        assert run(name, "") != run(name, "For example, a rod warms up because heat flows. Can you explain why?")


def test_spans_that_hold_a_point(spark):
    """Nested, overlapping, empty and very long spans against all pairs; candidates stay few."""
    rng = random.Random(12)
    spans = [(d, a := rng.randrange(-500, 5000), a + rng.choice([0, 1, 2, 3, 7, 50, 900, 10_000_000]), f"s{k}") for k in range(300) for d in [k % 3]] + [(1, None, 5, "x"), (1, 5, None, "x"), (1, 9, 3, "x")]
    points = sorted({(rng.randrange(3), rng.randrange(-600, 6000)) for _ in range(300)}) + [(1, None), (None, 5)]
    got = linking.spans_at(spark.createDataFrame(points, "doc_id long, offset int"), spark.createDataFrame(spans, "doc_id long, start int, stop int, title string"))
    want = sorted((d, p, a, t) for d, p in points for x, a, b, t in spans if d == x and None not in (p, a, b) and a <= p < b)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 1000
    many = spark.createDataFrame([(1, 10 * k, 10 * k + 10, "s") for k in range(20_000)], "doc_id long, start int, stop int, title string")
    at = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 10 + 3).cast("int").alias("offset"))
    met = linking.spans_at(at, many)
    assert met.count() == 20_000  # one resource: all pairs would be 400,000,000
    assert linking.spans_at(at.limit(0), many).count() == 0 and linking.spans_at(at, many.limit(0)).count() == 0


def test_hits_keep_missing_resources_and_pages(spark):
    chunks = spark.createDataFrame([(1, None, None, "heat flux", [1.0, 0.0]), (2, "r", 0, "heat", [0.0, 1.0]), (3, "r", 7, None, None)], "chunk_id long, resource_id string, page_number int, full_text string, embedding array<double>")
    asks = spark.createDataFrame([(9, "heat", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    got = retrieval.hybrid_search(asks, chunks, 3)
    assert got.schema["page_number"].dataType.simpleString() == "int"
    assert {r.chunk_id: (r.resource_id, r.page_number) for r in got.collect()} == {1: (None, None), 2: ("r", 0), 3: ("r", 7)}
