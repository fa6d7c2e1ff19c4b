"""Text functions on literal rows."""

from pyspark.sql import functions as F


from studyweave.functions import text as T
from studyweave.operators import chunking
from studyweave.operators.similar import known_forms
from studyweave.sources import io


def values(spark, rows, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, text string" + (", title string" if isinstance(rows[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_roles(spark):
    rows = [("Energy is defined as work.", ""), ("Proof: obvious", ""), ("for example a rod", ""), ("we obtain x", ""), ("used in cars", ""), ("Exercise: do it", ""), ("to summarize", ""), ("plain", "Worked Example"), ("plain", None)]
    assert values(spark, rows, T.pedagogy_role(F.col("text"), F.col("title"))) == ["definition", "proof", "example", "derivation", "application", "problem", "summary", "example", "explanation"]


def test_formula_types(spark):
    rows = ["a = b", "\\frac{dy}{dx}", "\\int x", "\\sum_i", "\\lim x", "\\begin{bmatrix}", "x \\leq y"]
    assert values(spark, rows, T.formula_type(F.col("text"))) == ["algebraic", "differential_equation", "integral", "summation", "limit", "matrix", "inequality"]


def test_sentences_and_tokens(spark):
    rows = ["One. Two!  Three?\nFour", "", "   ", "no end", "a.\n b"]
    assert values(spark, rows, T.sentences(F.col("text"))) == [["One.", "Two!", "Three?", "Four"], [], [], ["no end"], ["a.", "b"]]
    assert values(spark, rows, T.token_count(F.col("text"))) == [4, 1, 1, 2, 2]


def test_canonical_and_synonyms(spark):
    assert values(spark, ["  Fourier's-Law ", "Café Déjà", None, "x_y"], T.canonical_name(F.col("text"))) == ["fourier s law", "cafe deja", "", "x y"]
    assert values(spark, ["FFT", "Heat Xfer", "heat transfer", "other  name"], T.synonym(F.col("text"))) == ["Fast Fourier Transform", "Heat Transfer", "Heat Transfer", "other name"]
    forms = spark.createDataFrame([("fourier law",), ("entropy",)], "form string")
    got = known_forms(spark.createDataFrame([("Fourier Laws",), ("zzz",), (None,)], "name string"), forms)
    assert {r.name: r.form for r in got.collect()} == {"Fourier Laws": "fourier law", "zzz": None, None: None}


def test_noise(spark):
    assert values(spark, ["ab", "page 3", "theory", "heat flux", "1990", "##!!??", None], T.is_noise_concept(F.col("text"))) == [True, True, True, False, True, True, True]


def test_references_and_figures(spark):
    (r,) = values(spark, ["See Eq. 2.1, (3.4) and Figure 7, Table 2, Section 1.5; Chapter 9."], T.cross_references(F.col("text")))
    assert (r.equations, r.figures, r.tables, r.sections, r.chapters) == (["Eq. 2.1", "Eq. 3.4"], ["Fig. 7"], ["Table 2"], ["Section 1.5"], ["Chapter 9"])
    (f,) = values(spark, ["Figure 1: curve of Heat Flux versus time. Table 2: Values of things."], T.figures(F.col("text")))
    assert [(x.label, x.kind) for x in f] == [("Figure 1", "graph"), ("Table 2", "table")]


def test_variables(spark):
    assert values(spark, ["\\alpha x_1 + \\frac{y^2}{z} = energy"], T.variables(F.col("text"))) == [["x_1", "y^2", "z"]]


def test_difficulty_and_minutes(spark):
    df = spark.createDataFrame([("the laplacian of a field", ["integral", "algebraic"], ["a", "b"], ["Field Theory"])], "t string, f array<string>, p array<string>, c array<string>")
    (s,) = df.select(T.difficulty_score(F.col("t"), F.col("f"), F.col("p"), F.col("c"))).first()
    assert s == 10 + 8 + 10 + 10 + 25
    assert df.select(T.study_minutes(F.col("t"), F.lit(1), F.lit(2))).first()[0] == int(5 + 5 / 200 + 2 + 4 + 2)


def spans_by_hand(counts, sims, tau, least, most, overlap):
    """Another reading of the rule, sentence after sentence."""
    out, begin, tokens = [], 0, 0
    for i, n in enumerate(counts):
        tokens += n
        if tokens >= most or (i < len(sims) and sims[i] < tau and tokens >= least):
            out.append((begin, i + 1))
            begin = max(i + 1 - overlap, 0) if i + 1 >= overlap else i + 1
            tokens = sum(counts[begin : i + 1])
    return out + ([(begin, len(counts))] if begin < len(counts) else [])


def test_semantic_spans():
    import random

    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 12)
        counts, sims = [rng.randint(1, 9) for _ in range(n)], [rng.random() for _ in range(max(0, n - 1))]
        least, most, overlap = rng.randint(1, 10), rng.randint(10, 25), rng.randint(0, 1)
        assert chunking.semantic_spans(counts, sims, 0.5, least, most, overlap) == spans_by_hand(counts, sims, 0.5, least, most, overlap)


def test_formula_chunks(spark):
    text = "Intro sentence here. Then $a + c$ holds. After it more. " + "tail " * 80
    df = spark.createDataFrame([(1, text), (2, "plain one. plain two."), (3, None)], "doc_id long, text string")
    out = chunking.formula_aware_split(df).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.has_formula) for r in out] == [(1, True), (1, False), (2, False)]
    assert "$a + c$" in out[0].chunk


def test_packing_keeps_all_words(spark):
    df = spark.createDataFrame([(1, "a b c. d e. " * 20), (2, ""), (3, None)], "doc_id long, text string")
    out = chunking.split_documents(df, 7).orderBy("idx").collect()
    assert " ".join(r.chunk for r in out).split() == ("a b c. d e. " * 20).split()
    assert all(len(r.chunk.split()) <= 7 for r in out)


def test_json_and_files(spark, tmp_path):
    assert values(spark, ['x ```json\n{"a": [1,],}\n``` y', 'so {"b": 2} end', "none"], io.extracted_json(F.col("text"))) == ['{"a": [1]}', '{"b": 2}', ""]
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.TXT").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    up = io.uploads(spark, str(tmp_path))
    assert sorted(r.kind for r in up.collect()) == ["pdf", "text", "text"]
    assert sorted(r.text for r in io.text_pages(up).collect()) == ["", "héllo"]


def test_records(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = io.read_records(spark, str(tmp_path / "r.jsonl"), StructType().add("a", "integer"))
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert [r._bad for r in bad.collect()] == ["not json"]


def test_pages_with_math(spark):
    pages = spark.createDataFrame([("p", 1, "one"), ("p", 2, "two")], "path string, page_number int, text string")
    math = spark.createDataFrame([("p", 2, 1, "b"), ("p", 2, 0, "a")], "path string, page_number int, pos int, latex string")
    assert [r.text for r in io.with_math(pages, math).orderBy("page_number").collect()] == ["one", "two\n\nMATH:\na\nb"]


def test_axes(spark):
    cases = [("Plot: X-axis: Time (s), y axis speed; more", "graph", ("time (s)", "speed")), ("Curve of mean heat versus time of day", "graph", ("time of", "mean heat")), ("x axis: km. heat versus cold", "graph", ("km", "heat")), ("plain", "graph", (None, None)), ("heat versus time", "diagram", None), (None, "graph", (None, None))]
    rows = spark.createDataFrame([(c, k) for c, k, _ in cases], "caption string, kind string").select(T.axes(F.col("caption"), F.col("kind")).alias("a")).collect()
    assert [None if r.a is None else tuple(r.a) for r in rows] == [w for _, _, w in cases]
