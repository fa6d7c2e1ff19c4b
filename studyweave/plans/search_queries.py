"""Queries of stored search indexes: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.staging import shared_path
from .inputs import table
from .registry import Registry
from .retrieval_queries import _HITS, _chunks, _queries, _texts

REGISTRY = Registry()
add = REGISTRY.add
_BEST = f"with {_HITS}, t as (select query_id, chunk_id, round(b / (1 + b), 6) as bm25 from bm), r as (select *, row_number() over (partition by query_id order by bm25 desc, chunk_id)::int as rank from t) select query_id, chunk_id, bm25, rank from r where rank <= 10"


@add(_BEST)
def indexed_search(spark, sf_dir):
    """Top 10 by BM25 over an index of all chunks."""
    index = TextIndex(spark, shared_path(spark, "text-index"), stemmed=False).build(_texts(spark, sf_dir))
    return index.search(_queries(spark, sf_dir), 10).select("query_id", "chunk_id", "bm25", "rank")


@add(_BEST)
def updated_index_search(spark, sf_dir):
    """The same from an index of an older state, brought up to date with the chunks that differ."""
    now = _texts(spark, sf_dir)
    n = F.col("chunk_id")
    # the older state lacks some chunks, has others with another text, and some that are gone by now
    old = now.where(n % 5 != 0).withColumn("full_text", F.when(n % 7 == 0, F.concat(F.lit("old words "), "full_text")).otherwise(F.col("full_text")))
    old = old.unionByName(now.where(n % 11 == 0).withColumn("chunk_id", n + 10_000_000))
    index = TextIndex(spark, shared_path(spark, "text-index"), stemmed=False).build(old)
    key = lambda rows: rows.select("chunk_id", F.xxhash64("full_text").alias("h"))
    changed = key(now).withColumnRenamed("h", "h_now").join(key(old), "chunk_id", "full_outer").where(~F.col("h").eqNullSafe(F.col("h_now")))
    return index.update(now, changed).search(_queries(spark, sf_dir), 10).select("query_id", "chunk_id", "bm25", "rank")


def _asks(spark, sf_dir):
    """Every benchmark text as a whole, and its first two and last two words."""
    b = table(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    asks = F.array(F.col("text"), F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, -2, 2), " "))
    return b.where(F.size(words) > 1).select("item_id", F.posexplode(asks).alias("kind", "text")).select((3 * F.col("item_id") + F.col("kind")).alias("query_id"), "text")


@add()
def ranked_text(spark, sf_dir):
    """Top 10 chunks with all stems of an ask, by cover density; titles weigh more than bodies."""
    chunks = _texts(spark, sf_dir).withColumn("title", F.col("role"))
    index = TextIndex(spark, shared_path(spark, "text-index"), (("title", "A"), ("full_text", "B")), True).build(chunks)
    return index.ranked(_asks(spark, sf_dir), 10).select("query_id", "chunk_id", "score", "rank")


def _vector_index(spark, sf_dir):
    return VectorIndex.build(spark, shared_path(spark, "vector-index"), _chunks(spark, sf_dir), dim=64)


@add()
def probed_search(spark, sf_dir):
    """Top 10 by similarity in the two thirds of the lists that are nearest to each benchmark item's vector."""
    index = _vector_index(spark, sf_dir)
    return index.search(_queries(spark, sf_dir), 10, probes=-(-2 * len(index.centroids) // 3)).select("query_id", "chunk_id", "sim", "rank")


@add(f"""with {_HITS}, r as (select query_id, pa.chunk_id, sim, row_number() over (partition by query_id order by sim desc, pa.chunk_id)::int as rank
    from pa join ck using (chunk_id) where embedding is not null and query_id in (select query_id from qs where qv is not null)) select query_id, chunk_id, sim, rank from r where rank <= 10""")
def probed_search_all(spark, sf_dir):
    """The same with all lists: the exact way."""
    index = _vector_index(spark, sf_dir)
    return index.search(_queries(spark, sf_dir), 10, probes=len(index.centroids)).select("query_id", "chunk_id", "sim", "rank")
