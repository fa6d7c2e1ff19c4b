"""What a query must not do more than once, or for more rows than need it."""

import contextlib
import io
import re

import pyarrow as pa
from compare import SF
from pyspark.sql import functions as F

from studyweave.operators import chunking, retrieval
from studyweave.operators.text_index import TextIndex
from studyweave.plans import catalog
from studyweave.plans.inputs import chunks
from studyweave.sources import ledger


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return re.sub("DataFilters.*", "", out.getvalue())  # which repeat the filters


def test_texts_are_cut_into_sentences_once(spark):
    """Chunks, and so all queries over them: no filter cuts every text a second time."""
    assert plan(chunks(spark, SF)).count("split(coalesce(text") == 1


def test_one_block_documents_need_no_tables(spark, monkeypatch):
    """Only the blocks of documents of several blocks are told to each other."""
    rows, staged = {}, chunking.staged

    def counted(df, tag):
        out = staged(df, tag)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(chunking, "staged", counted)
    df = spark.createDataFrame([(d, k, f"some words {k}", [1.0, float(k)]) for d in range(5) for k in range(3 if d else 9)], "doc_id long, pos int, sentence string, embedding array<double>")
    assert chunking.semantic_chunks(df, block=4).count() == 5
    assert rows["block-edges"] == 3  # of the one document with nine sentences


def test_planned_chunks_are_not_joined(spark):
    p = plan(catalog.queries()["planned_chunks"](spark, SF))
    assert "Join" not in p and "substring(page" in p


def test_formula_patterns_wait_for_their_signs(spark):
    """The patterns run only on texts that hold an equals sign, a dollar sign or an environment."""
    df = spark.createDataFrame([(1, "plain words. " * 3), (2, "f(x) = 3 holds here"), (3, None)], "doc_id long, text string")
    p = plan(chunking.formula_aware_split(df, 5))
    assert "Contains(" in p and "aggregate(slice(" not in p
    assert [(r.doc_id, r.begin, r.has_formula) for r in chunking.formula_aware_split(df, 5).orderBy("doc_id", "begin").collect()] == [(1, 0, False), (1, 25, False), (2, 0, True)]


def test_index_words_are_made_distinct_as_strings(spark):
    """Spark compares structs each with each."""
    assert "array_distinct(concat" not in plan(catalog.queries()["search_index"](spark, SF))


def test_relations_are_named_once(spark):
    assert plan(catalog.queries()["pedagogy_relations"](spark, SF)).count("translate(") == 2


def test_formula_graph_searches_texts_once(spark):
    assert "documents.parquet" not in plan(catalog.queries()["formula_graph"](spark, SF))


def test_ranges_are_found_in_one_pass(spark):
    """Rows of a job may be costly to make."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(100).select(F.col("id").alias("k")).mapInArrow(count, "k long")
    assert ledger.key_ranges(rows, "k", 4) == [(0, 25), (25, 50), (50, 75), (75, 100)]
    assert made.value == 100


def test_index_makes_blocks_of_texts(spark, tmp_path):
    """Postings are no rows of their own: what is sorted by term are blocks; and texts travel without their vectors."""
    index = TextIndex(spark, str(tmp_path / "index"), stemmed=False)
    rows = spark.createDataFrame([(k, "some words here and some more") for k in range(600)], "chunk_id long, full_text string")
    p = plan(index._rows(rows))
    assert p.count("MapInArrow") == 1 and "Exchange" in p.split("MapInArrow")[1] and "Exchange" not in p.split("MapInArrow")[0]
    assert index.build(rows).blocks().count() == 3 * 6  # five words and the empty term in each of three cells


def test_cells_are_scored_for_all_queries_at_once(spark, tmp_path):
    """A block travels once however many queries ask for it, and a task hands on the best k of a query."""
    index = TextIndex(spark, str(tmp_path / "index"), stemmed=False).build(spark.createDataFrame([(k, f"alpha beta w{k % 7}") for k in range(2000)], "chunk_id long, full_text string"))
    cells = spark.range(8).crossJoin(spark.range(5).select(F.col("id").alias("query_id"))).select("query_id", F.col("id").alias("cell"))
    assert index._met(["alpha"], cells, ["ids"]).where("term is not null").count() == 8
    asks = spark.createDataFrame([(q, "alpha beta") for q in range(5)], "query_id long, text string")
    assert [(r.query_id, r.chunk_id) for r in index.ranked(asks, 2).orderBy("query_id", "rank").collect()] == [(q, c) for q in range(5) for c in (0, 1)]


def test_names_are_sought_in_one_stream(spark):
    """No frame per resource, and texts are cut into chunks once."""
    p = plan(catalog.queries()["implicit_prerequisites"](spark, SF))
    assert "CoGroup" not in p and "documents.parquet" not in p


def test_slices_follow_the_queries(spark):
    """A slice's table of chunks by asked terms has a bounded size, however many terms are asked for."""
    asks = [(q, " ".join(f"w{k}" for k in range(100)), [1.0]) for q in range(1000)]
    table = pa.table({"query_id": [a[0] for a in asks], "text": [a[1] for a in asks], "embedding": pa.array([a[2] for a in asks])})
    block = retrieval._Block(table, {f"w{k}": 1.0 for k in range(100)}, 10.0)
    assert block.rows * len(block.terms) <= retrieval.SLICE_NUMBERS
