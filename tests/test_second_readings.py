"""Queries without SQL against a second, plain reading of the whole small tables."""

import math
import re
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from compare import SF

from studyweave.functions import rules
from studyweave.operators import chunking, quality, tutoring
from studyweave.plans import catalog
from test_functions import spans_by_hand


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def parts(spark):
    return {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}


def result(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_fuzzy_concepts(spark, parts):
    forms = sorted({sorted(g)[0] for g in rules.SYNONYMS})
    known = {v.lower(): sorted(g)[0] for g in rules.SYNONYMS for v in g}
    got = {r.name: r.form for r in result(spark, "fuzzy_concepts")}
    assert set(parts.values()) <= set(got) and len(got) > len(set(parts.values()))
    for name, form in got.items():
        flat = re.sub("[‘’′]", "'", " ".join(name.split()))
        best = max(forms, key=lambda f: SequenceMatcher(None, name.lower(), f.lower()).ratio())
        near = best if SequenceMatcher(None, name.lower(), best.lower()).ratio() >= rules.FUZZY else flat
        assert form == (rules.ACRONYMS.get(name.strip().upper()) or known.get(flat.lower()) or near)


def test_alias_pairs(spark, parts):
    orders = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r.l_orderkey, set()).add(parts[r.l_partkey])
    pairs = {p for names in orders.values() for p in combinations(sorted(names), 2)}
    got = {(r.a, r.b): r.alias for r in result(spark, "alias_pairs")}
    assert set(got) == pairs
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    for (a, b), alias in got.items():
        assert alias == (bare(a) == bare(b) or SequenceMatcher(None, a.lower(), b.lower()).ratio() >= rules.ALIAS)


def formulas_by_marks(text):
    """Runs of characters that some pattern's match covers; matches that touch make one run."""
    marks = [0] * (len(text) + 2)
    for p in rules.FORMULA_PATTERNS:
        for m in re.finditer(p, text):
            marks[m.start()] += 1
            marks[m.end() + 1] -= 1  # one further, so that neighbours that touch join
    out, depth = [], 0
    for i, step in enumerate(marks):
        before, depth = depth, depth + step
        if before == 0 and depth > 0:
            out.append([i, None])
        if before > 0 and depth == 0:
            out[-1][1] = i - 1
    return [tuple(x) for x in out]


def test_formula_positions(spark, documents):
    got = {}
    for r in result(spark, "formula_positions"):
        got.setdefault(r.doc_id, []).append((r.begin, r.stop))
        assert documents[r.doc_id][r.begin : r.stop] == r.formula
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, t in documents.items() if (x := formulas_by_marks(t))}


def test_formula_aware_chunks(spark, documents):
    got = {}
    for r in result(spark, "formula_aware_chunks"):
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in documents.items():
        rows, found = sorted(got.get(doc, []), key=lambda r: r.idx), formulas_by_marks(text)
        assert sum(r.has_formula for r in rows) == len(found)
        for r, (a, b) in zip(rows, found):
            assert text[a:b].strip() in r.chunk and r.begin >= max(0, a - 200) and r.stop <= min(len(text), b + 200)
        if not found:
            assert " ".join(r.chunk for r in rows).split() == text.split()


def test_semantic_chunks(spark, documents):
    got = {}
    for r in result(spark, "semantic_chunks"):
        got.setdefault(r.doc_id, []).append((r.idx, r.source_offset, r.full_text))
    for doc, text in documents.items():
        parts = [s for s in (p.strip(" \t\n\r\f") for p in re.split(r"(?<=[.!?\n])[ \t\n\r\f]+", text)) if s]
        vectors = [[len(re.findall(f"[{c}]", s)) for c in ("aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz", " .,;")] for s in parts]
        near = []
        for u, v in zip(vectors, vectors[1:]):
            size = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
            near.append(sum(x * y for x, y in zip(u, v)) / size if size else 0.0)
        if any(abs(x - 0.9) < 1e-9 for x in near):
            continue
        counts = [max(1, len([w for w in re.split(r"[ \t\n\r\f]+", s) if w])) for s in parts]
        spans = spans_by_hand(counts, near, 0.9, 60, 240, 1)
        want = [(k, sum(len(p) + 1 for p in parts[:a]), " ".join(parts[a:b])) for k, (a, b) in enumerate(spans)]
        assert sorted(got.get(doc, [])) == want


def test_planned_chunks(spark, documents):
    rows = result(spark, "planned_chunks")
    plain = {(r.unit_id, r.idx): r for r in result(spark, "unit_chunks")}
    cut = {r.unit_id for r in rows if r.has_equation}
    assert {(r.unit_id, r.idx) for r in rows if r.unit_id not in cut} == {k for k in plain if k[0] not in cut}
    for r in rows:
        if r.unit_id not in cut:
            assert r.full_text == plain[r.unit_id, r.idx].full_text
        assert r.pedagogy_role and r.token_count == len(r.full_text.split()) and r.text_snippet == r.full_text[:300]


def test_units_of_odd_spans(spark):
    page = "Short start. " + "word " * 700 + "$a + b = c$ end."
    spans = [(1, page, 0, 5, "x"), (2, page, -3, 90, "x"), (3, page, 40, 40, "x"), (4, page, 0, 400, "summary"), (5, page, 13, 3400, "summary"), (6, page, 3400, 9999, None), (7, None, 0, 50, "x")]
    units = spark.createDataFrame(spans, "unit_id long, page string, start int, stop int, kind string")
    got = chunking.unit_chunks(units).collect()
    assert {r.unit_id for r in got} == {4, 5, 6} and all("$a + b = c$" in r.full_text for r in got if r.has_equation)
    clamped = chunking.structural_chunks(units.select(units.unit_id.alias("span_id"), "page", "start", "stop", units.kind.alias("section_title"))).collect()
    assert {r.span_id: r.source_offset for r in clamped} == {2: 0, 4: 0, 5: 13, 6: 3400}


def test_responses_without_chunks(spark):
    ddl = "action string, concept string, level string, chunks array<struct<id:string,snippet:string>>, difficulty string, question_type string"
    rows = [("explain", None, "beginner", None, None, None), ("review", "heat", "beginner", [(None, "word " * 80)], None, None), ("question", None, "x", [("c1", " first\nsecond ")], "very_hard", "multiple_choice")]
    a, b, c = tutoring.respond(spark.createDataFrame(rows, ddl)).collect()
    assert a.response == rules.NO_CHUNKS and a.confidence == 0.2 and a.source_ids == []
    assert b.response.split("\n")[1].endswith("word…") and len(b.response.split("\n")[1]) <= 142 and b.source_ids == []
    assert c.response == "Multiple Choice for this concept (very hard):\n[Chunk 1 | c1] first\nWhat step should come next?" and c.source_ids == ["c1"]


def test_observed_measures(spark):
    from pyspark.sql import functions as F

    rows, seen = quality.observed(spark.range(10), "stage-one", most=F.max("id"))
    assert rows.count() == 10 and seen.get == {"rows": 10, "most": 9}
