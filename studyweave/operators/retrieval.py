"""Hybrid retrieval: vector similarity and text relevance blended, then re-ranked per query.

Query tables are small by contract (a stated set of questions); they go to the tasks in blocks of a checked size in
bytes. Every chunk is scored against every query, a block of queries and a batch of chunks as one matrix product - no
candidate limit - and only the best k per query and task become rows.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from ..sources.staging import staged

#: Bytes of queries (vectors and texts) in one block, and chunks in one matrix product.
BLOCK_BYTES = 4_000_000
SLICE = 256
#: Numbers in one table of a slice: with many queries or long ones it takes fewer chunks.
SLICE_NUMBERS = 1_000_000
#: Stands for a missing page while the best chunks are gathered; no page has this number.
NO_PAGE = -(2**62)
_WORD = re.compile("[a-z0-9]+")
#: BM25 parameters.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _term_weights(vocabulary: set[str], chunks: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the queries' terms and the chunks' mean length, in one pass over the texts."""
    ws = chunks.select(tokens(F.coalesce("full_text", F.lit(""))).alias("ws"))
    # each chunk also counts for the empty term, which no text has: that gives their number and mean length
    each = ws.select(F.size("ws").alias("size"), F.explode(F.concat(F.array_distinct("ws"), F.array(F.lit("")))).alias("term"))
    asked = F.broadcast(chunks.sparkSession.createDataFrame([(t,) for t in sorted(vocabulary | {""})], "term string"))  # a block of queries has a checked size
    found = {r.term: r for r in each.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("size").alias("size")).collect()}
    every = found.pop("", None)
    return {t: math.log(1 + (every.df - r.df + 0.5) / (r.df + 0.5)) for t, r in found.items()}, every.size / every.df if every else 0.0


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of the arrays of that size, zero rows for others, nulls and zero vectors."""
    out = np.zeros((len(lists), dim))
    rows = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    if len(rows) and dim:
        x = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        size = np.sqrt((x * x).sum(1))
        out[rows] = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
    return np.nan_to_num(out)


class _Block:
    """A block of queries as the tasks hold it: vectors by size, and each query's terms as places in the vocabulary."""

    def __init__(self, table: pa.Table, idf: dict[str, float], mean_size: float):
        lists = table.column("embedding").combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(sizes, kind="stable")
        self.ids, self.mean_size = table.column("query_id").to_numpy()[order], mean_size
        self.vectors = [(int(d), _matrix(lists.take(pa.array(order[sizes[order] == d])), int(d))) for d in np.unique(sizes)]
        self.place = {t: k for k, t in enumerate(idf)}
        self.idf = np.array([*idf.values(), 0.0])
        texts = table.column("text").to_pylist()
        # the place after the last term is always zero; every query has it, so that none is empty
        terms = [[*(self.place[t] for t in sorted(set(_WORD.findall((texts[q] or "").lower()))) if t in self.place), len(idf)] for q in order.tolist()]
        self.terms, self.starts = np.concatenate([np.zeros(0, int), *terms]).astype(int), np.cumsum([0, *map(len, terms)])[:-1]
        self.rows = min(SLICE, max(8, SLICE_NUMBERS // max(1, len(self.terms))))

    def similarity(self, embeddings: pa.Array) -> np.ndarray:
        """Queries by chunks; vectors of another size, nulls and zeros have none."""
        return np.concatenate([v @ _matrix(embeddings, d).T for d, v in self.vectors])

    def relevance(self, texts: list) -> np.ndarray:
        """BM25 of queries by chunks."""
        tf, size = np.zeros((len(texts), len(self.idf))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = _WORD.findall((text or "").lower())
            size[i] = len(words)
            for w in words:
                if (k := self.place.get(w)) is not None:
                    tf[i, k] += 1
        weight = self.idf * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / (self.mean_size or 1.0)))[:, None])
        return np.add.reduceat(weight[:, self.terms], self.starts, axis=1).T


def _scored(block: _Block, k: int, sim_weight: float, text_weight: float, factor: float, proximity: bool):
    """Of each query the task's k best chunks, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # score, chunk, sim, bm25, resource's number and page of the best so far, a row per query
        names: dict[str | None, int] = {}  # resources of the task
        for batch in batches:
            for low in range(0, batch.num_rows, block.rows):
                part = batch.slice(low, block.rows)
                page = part.column("page_number").to_numpy(zero_copy_only=False).astype(float)
                near = np.maximum(1.0, 1 + np.maximum(0, 10 - np.nan_to_num(page, nan=10.0)) * 0.02) if proximity else 1.0
                sim, text = np.round(block.similarity(part.column("embedding")), 6), block.relevance(part.column("full_text").to_pylist())
                bm25 = np.round(text / (1 + text), 6)
                score = np.round((sim_weight * sim + text_weight * bm25) * factor * near, 9)
                code = np.array([names.setdefault(r, len(names)) for r in part.column("resource_id").to_pylist()])
                at_page = part.column("page_number").fill_null(NO_PAGE).to_numpy(zero_copy_only=False)
                new = [score, np.broadcast_to(part.column("chunk_id").to_numpy(), score.shape), sim, bm25, *(np.broadcast_to(x, score.shape) for x in (code, at_page))]
                both = [np.concatenate(x, 1) for x in zip(held, new)] if held else new
                top = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                held = [np.take_along_axis(x, top, 1) for x in both]
        if held:
            n = held[0].shape[1]
            resource, page = pa.array(list(names), pa.string()).take(pa.array(held[4].ravel())), held[5].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, n)), *(pa.array(x.ravel()) for x in held[:4]), resource, pa.array(page, mask=page == NO_PAGE)], ["query_id", "score", "chunk_id", "sim", "bm25", "resource_id", "page_number"])

    return run


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with columns of their chunks: only chunks that are hit travel. The hits of stated queries are few; their ids are
    staged and go to the tasks if they take less than BLOCK_BYTES."""
    hits = staged(hits, "hits")
    ids = hits.select("chunk_id").distinct()
    found = chunks.join(F.broadcast(ids) if 16 * hits.count() <= BLOCK_BYTES else ids, "chunk_id", "left_semi")
    return hits.join(found, "chunk_id")


def _block(queries: DataFrame, chunks: DataFrame, texts: DataFrame, k: int, sim_weight: float, text_weight: float, factor: float, page_proximity: bool) -> DataFrame:
    """The k best chunks of a block of queries, which is read to the driver; pairs of all chunks and queries are never rows."""
    table = queries.select(F.col("query_id").cast("long").alias("query_id"), "text", F.col("embedding").cast("array<double>").alias("embedding")).toArrow().combine_chunks()
    vocabulary = {t for text in table.column("text").to_pylist() for t in _WORD.findall((text or "").lower())}
    block = _Block(table, *_term_weights(vocabulary, texts))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("page_number").cast("long").alias("page_number"), F.col("resource_id").cast("string").alias("resource_id"), "full_text", F.col("embedding").cast("array<double>").alias("embedding"))
    ddl = "query_id long, score double, chunk_id long, sim double, bm25 double, resource_id string, page_number long"
    best = rows.mapInArrow(_scored(block, k, sim_weight, text_weight, factor, page_proximity), ddl) if table.num_rows else chunks.sparkSession.createDataFrame([], ddl)
    typed = [F.col(c).cast(chunks.schema[c].dataType).alias(c) for c in ("resource_id", "page_number")]
    return _ranked(best, k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", *typed, "sim", "bm25", "score", "rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 10, sim_weight: float = 0.7, text_weight: float = 0.3, resource: str | None = None, boost: float = 1.0, page_proximity: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, resource_id, page_number, sim, bm25, score, rank of each query's k best chunks.

    ``queries``: query_id, text, embedding; ``chunks``: chunk_id, resource_id, page_number, full_text, embedding.
    ``vectors`` (chunk_id, embedding; ids once each) may come by themselves: terms are then weighed without a join, and
    texts travel once, neither sorted nor spilled, since a task hashes its vectors. A missing vector has similarity 0. With ``resource``, only its chunks are searched and ``boost`` applies.
    Relevance is BM25 / (1 + BM25), so both parts are within one. Weights must not be negative. Ids are numbers.
    """
    if resource is not None:
        chunks = chunks.where(F.col("resource_id") == resource)
    size = 8 * F.coalesce(F.size("embedding"), F.lit(0)) + 8 * F.coalesce(F.length("text"), F.lit(0)) + 64
    parts = max(1, -(-(queries.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    blocks = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [queries]
    texts = chunks
    if vectors is not None:
        chunks = chunks.select("chunk_id", "resource_id", "page_number", "full_text").join(vectors.select("chunk_id", "embedding").hint("shuffle_hash"), "chunk_id", "left")
        chunks = staged(chunks, "chunks") if parts > 1 else chunks
    return reduce(DataFrame.unionByName, (_block(q, chunks, texts, k, sim_weight, text_weight, boost if resource is not None else 1.0, page_proximity) for q in blocks))


def substring_search(queries: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
    """query_id, chunk_id, snippet, score (1.0), rank: the first k chunks by id that hold the text, ignoring case.

    The mode for when there are no vectors. The stated queries are a block of checked size that meets all chunks.
    """
    n, chars = queries.agg(F.count("*"), F.sum(F.length("text"))).first()
    if n * 64 + (chars or 0) > BLOCK_BYTES:
        raise ValueError("ask fewer queries at once")
    asked = queries.where(F.coalesce("text", F.lit("")) != "").select("query_id", F.lower("text").alias("_t")).toArrow()
    rows = chunks.select("chunk_id", F.left("full_text", F.lit(300)).alias("snippet"), F.lower("full_text").alias("_low"))
    kinds = {"query_id": queries.schema["query_id"].dataType, **{c: rows.schema[c].dataType for c in ("chunk_id", "snippet")}}
    found = rows.where("_low is not null").mapInArrow(_first_holders(asked, k), StructType([StructField(c, t) for c, t in kinds.items()]))
    return _ranked(found.withColumn("score", F.lit(1.0)), k, F.col("chunk_id"))


def _first_holders(queries: pa.Table, k: int):
    """Of each query the task's first k chunks by id (a null id before all) that hold its text; others never become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = list(zip(queries.column("query_id").to_pylist(), queries.column("_t").to_pylist()))
        held: list[list[tuple]] = [[] for _ in asked]  # (place, snippet) in order
        kinds = [queries.schema.field("query_id").type]
        for batch in batches:
            ids = batch.column("chunk_id").to_pylist()
            # by id, so that a full query needs no look at the later chunks of the batch
            places = [(False,) if c is None else (True, c) for c in ids]
            rows = sorted(range(len(ids)), key=places.__getitem__)
            texts, snippets = batch.column("_low").to_pylist(), batch.column("snippet")
            kinds[1:] = [batch.schema.field(c).type for c in ("chunk_id", "snippet")]
            for (_, text), best in zip(asked, held):
                for i in rows:
                    if len(best) >= k and places[i] >= best[-1][0]:
                        break
                    if text in texts[i]:
                        insort(best, (places[i], snippets[i].as_py()), key=itemgetter(0))
                        del best[k:]
        found = [(q, place[1] if place[0] else None, snippet) for (q, _), best in zip(asked, held) for place, snippet in best]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["query_id", "chunk_id", "snippet"])

    return run


def relevant(hits: DataFrame, score: float = 0.35, sim: float = 0.30, bm25: float = 0.15, relax: bool = False) -> DataFrame:
    """Hits that reach any threshold; with ``relax``, a query none of whose hits does keeps those of at least 0."""
    passes = lambda a, b, c: F.coalesce(F.col("score") >= a, F.lit(False)) | F.coalesce(F.col("sim") >= b, F.lit(False)) | F.coalesce(F.col("bm25") >= c, F.lit(False))
    if not relax:
        return hits.where(passes(score, sim, bm25))
    marked = hits.withColumn("_ok", passes(score, sim, bm25)).withColumn("_any", F.max("_ok").over(W.partitionBy("query_id")))
    return marked.where(F.col("_ok") | (~F.col("_any") & passes(0.0, 0.0, 0.0))).drop("_ok", "_any")


def pedagogy_boost(hits: DataFrame, roles: list[str], only: bool = False, relax: bool = True) -> DataFrame:
    """Scores raised for wanted roles, the first by 0.25 and each later one by 0.05 less, at least 0.12; re-ranked.

    ``only`` keeps wanted roles; with ``relax``, a query that has none keeps all.
    """
    place = F.array_position(F.array(*map(F.lit, roles)), F.coalesce("role", F.lit("")))
    if only:
        hits = hits.withColumn("_any", F.max(place > 0).over(W.partitionBy("query_id"))).where((place > 0) | (~F.col("_any") if relax else F.lit(False))).drop("_any")
    raised = F.when(place > 0, F.greatest(F.lit(0.12), 0.25 - (place - 1) * 0.05)).otherwise(0.0)
    scored = hits.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)) + raised, 9))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each chunk per query; hits without chunk go."""
    first = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("rank"))
    return hits.where(F.col("chunk_id").isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")


def spread_pages(hits: DataFrame, per_page: int = 1) -> DataFrame:
    """At most ``per_page`` hits of a page per query, the best ones (a report's limit)."""
    n = F.row_number().over(W.partitionBy("query_id", "resource_id", F.coalesce("page_number", F.lit(0))).orderBy("rank"))
    return hits.withColumn("_n", n).where(F.col("_n") <= per_page).drop("_n")


def consolidate(hits: DataFrame, window: int = 2, target_chars: int | None = None) -> DataFrame:
    """(query_id, resource_id, page_number, part, chunk_ids, snippet): hits of a page joined in order of offset.

    Windows of ``window`` hits cut at 600 characters, or hits until ``target_chars`` is reached, cut at
    max(target_chars, 1200). Hits without offset come last.
    """
    key = ["query_id", "resource_id", "page_number"]
    rows = hits.withColumn("page_number", F.coalesce("page_number", F.lit(0)))
    order = [F.col("source_offset").isNull(), F.col("source_offset"), F.col("chunk_id")]
    if not target_chars:
        placed = rows.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).withColumn("part", F.floor((F.col("n") - 1) / window).cast("int"))
        groups = placed.groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id", "snippet"))).alias("hs"))
        return groups.select(*key, "part", F.col("hs.chunk_id").alias("chunk_ids"), F.left(F.array_join("hs.snippet", " "), F.lit(600)).alias("snippet"))
    item = F.struct(order[0].alias("late"), F.col("source_offset"), F.col("chunk_id"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("hs"))
    kind = "array<struct<ids:array<string>,text:string,size:int>>"
    start = F.array().cast(kind)

    def step(done, h):
        last = F.element_at(done, -1)
        one = F.struct(F.array(h["chunk_id"].cast("string")).alias("ids"), h["snippet"].alias("text"), F.length(h["snippet"]).alias("size"))
        more = F.struct(F.array_append(last["ids"], h["chunk_id"].cast("string")).alias("ids"), F.concat(last["text"], F.lit(" "), h["snippet"]).alias("text"), (last["size"] + F.length(h["snippet"])).alias("size"))
        return F.when((F.size(done) > 0) & (last["size"] < target_chars), F.array_append(F.slice(done, 1, F.size(done) - 1), more)).otherwise(F.array_append(done, one))

    guarded = lambda done, h: F.when(F.size(done) == 0, F.array(F.struct(F.array(h["chunk_id"].cast("string")).alias("ids"), h["snippet"].alias("text"), F.length(h["snippet"]).alias("size")))).otherwise(step(done, h))
    packed = listed.select(*key, F.posexplode(F.aggregate("hs", start, guarded)).alias("part", "p"))
    return packed.select(*key, "part", F.col("p.ids").alias("chunk_ids"), F.left("p.text", F.lit(max(target_chars, 1200))).alias("snippet"))


def with_neighbours(hits: DataFrame, k: int, window: int = 1, per_page: int = 4) -> DataFrame:
    """(query_id, chunk_id, place): hits in order of rank, each with those next to it on its page, at most
    max(2k, 8) a query and ``per_page`` a page.

    A hit's turn is the rank of the best hit that brings it in. The caps take hits in that order, those of a
    turn in order of offset.
    """
    page = ["query_id", "resource_id", "page_number"]
    order = W.partitionBy(*page).orderBy(F.col("source_offset").isNull(), "source_offset", "chunk_id")
    turn = F.min("rank").over(order.rowsBetween(-window, window))
    rows = hits.withColumn("_turn", turn).withColumn("_n", F.row_number().over(W.partitionBy(*page).orderBy("_turn", F.col("source_offset").isNull(), "source_offset", "chunk_id")))
    kept = rows.where(F.col("_n") <= per_page).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("_turn", F.col("source_offset").isNull(), "source_offset", "chunk_id")))
    return kept.where(F.col("place") <= max(2 * k, 8)).select("query_id", "chunk_id", "place")


def tutor_retrieve(queries: DataFrame, chunks: DataFrame, roles: list[str], k: int = 15, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid search for max(10, 4k) hits, relevance with relaxing, role boost, neighbours. Blank queries find nothing.

    ``chunks`` also has role and source_offset.
    """
    asked = queries.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    hits = with_chunks(hybrid_search(asked, chunks, max(10, 4 * k), vectors=vectors), chunks.select("chunk_id", "role", "source_offset"))
    return with_neighbours(pedagogy_boost(relevant(hits, relax=True), roles), k)


def search_bench(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ids, scores) in order of rank; queries without hits have empty arrays."""
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hs"))
    found = found.select("query_id", F.col("hs.chunk_id").alias("ids"), F.col("hs.score").alias("scores"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("ids", "scores")))


def best_per_concept(hits: DataFrame, count: int) -> DataFrame:
    """One hit for each of the first ``count`` queries (concepts) that have any, in order of query_id (a quiz)."""
    first = spread_pages(relevant(hits)).withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("_n = 1").drop("_n")
    return first.orderBy("query_id").limit(count)


def doubt_context(hits: DataFrame, target_chars: int = 1200, lines: int = 6, chars: int = 320) -> DataFrame:
    """(query_id, context, citations): relevant hits, each chunk once, packed per page; the first ``lines`` packs as
    numbered lines of ``chars`` characters (the answer's limit), the first three cited."""
    packs = consolidate(distinct_hits(relevant(hits)), target_chars=target_chars)
    n = F.row_number().over(W.partitionBy("query_id").orderBy("resource_id", "page_number", "part"))
    packs = packs.withColumn("n", n).where(F.col("n") <= lines)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.left("snippet", F.lit(chars)), F.lit(" (chunk_id:"), F.get("chunk_ids", F.lit(0)), F.lit(", page:"), F.col("page_number").cast("string"), F.lit(")"))
    g = packs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), F.get("chunk_ids", F.lit(0)).alias("cid")))).alias("ls"))
    return g.select("query_id", F.array_join("ls.line", "\n").alias("context"), F.slice("ls.cid", 1, 3).alias("citations"))


def weak_references(weak: DataFrame, hits: DataFrame, per_concept: int = 2) -> DataFrame:
    """(user_id, concept, chunk_id, snippet) for each learner's weaknesses (user_id, concept, query_id): the best hits,
    one of a page, 200 characters each."""
    best = spread_pages(hits).withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= per_concept)
    return weak.join(best, "query_id").select("user_id", "concept", "chunk_id", F.left("snippet", F.lit(200)).alias("snippet"))
