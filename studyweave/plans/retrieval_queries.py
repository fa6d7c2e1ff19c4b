"""Queries of hybrid search and re-ranking: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import retrieval as R
from .inputs import CUES, CUES_SQL, _quoted, table
from .registry import Registry
from ..functions import rules
from ..functions import text as T
from .inputs import sql_ladder

REGISTRY = Registry()
add = REGISTRY.add
ROLES = ["definition", "example", "summary"]


def _queries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(v, "query_id", "left")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _chunks(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id")
    return _described(table(spark, sf_dir, "documents").join(v.hint("shuffle_hash"), "doc_id", "left"), "embedding")


def _texts(spark, sf_dir):
    """The chunks without their vectors: no join."""
    return _described(table(spark, sf_dir, "documents"))


def _described(d, *more):
    cues = F.array(*(F.lit(c) for c, _, _ in CUES))
    cue = F.element_at(cues, (F.col("doc_id") % len(CUES) + 1).cast("int"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("resource_id"), (F.col("doc_id") % 20).cast("int").alias("page_number"), F.col("doc_id").cast("int").alias("source_offset"), F.coalesce("text", F.lit("")).alias("full_text"), *more, T.pedagogy_role(cue).alias("role"))


def _hits(spark, sf_dir, k=50):
    extra = _texts(spark, sf_dir).select("chunk_id", "role", "source_offset", F.left("full_text", F.lit(300)).alias("snippet"))
    return R.with_chunks(R.hybrid_search(_queries(spark, sf_dir), _texts(spark, sf_dir), k, vectors=_vectors(spark, sf_dir)), extra)


_HITS = f"""{CUES_SQL}, ck as (select doc_id as chunk_id, coalesce(source, '') as resource_id, (doc_id % 20)::int as page_number, doc_id::int as source_offset, coalesce(text, '') as full_text, embedding::double[] as embedding,
        {sql_ladder('lower(cue)', rules.ROLE_LADDER, _quoted(rules.ROLE_DEFAULT))} as role from documents left join embeddings on vec_id = doc_id join cues on doc_id % {len(CUES)} = k),
    qs as (select item_id as query_id, text, embedding::double[] as qv from benchmark left join embeddings on vec_id = item_id),
    asked as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from qs),
    ws as (select chunk_id, regexp_extract_all(lower(full_text), '[a-z0-9]+') as ws from ck), st as (select count(*) as chunks, avg(len(ws)) as mean_size from ws),
    po as (select chunk_id, len(ws) as size, unnest(ws) as term from ws), ps as (select term, chunk_id, size, count(*) as tf from po where term in (select term from asked) group by all),
    df as (select term, count(*) as df from ps group by term),
    bm as (select query_id, chunk_id, sum(ln(1 + (chunks - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * size / mean_size))) as b from asked join ps using (term) join df using (term), st group by all),
    pa as (select query_id, chunk_id, resource_id, page_number, source_offset, role, left(full_text, 300) as snippet, round(coalesce(list_sum(list_transform(list_zip(qv, embedding), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(qv, lambda z: z * z))) * sqrt(list_sum(list_transform(embedding, lambda z: z * z)))), 0), 6) as sim from qs, ck),
    sc as (select pa.*, round(coalesce(b / (1 + b), 0), 6) as bm25 from pa left join bm using (query_id, chunk_id)),
    s2 as (select *, round((0.7::double * sim + 0.3::double * bm25) * greatest(1.0::double, 1 + greatest(0, 10 - page_number) * 0.02::double), 9) as score from sc),
    ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s2), hits as (select * from ranked where rank <= 50)"""


@add(f"with {_HITS} select query_id, chunk_id, resource_id, page_number, sim, bm25, score, rank from hits where rank <= 10")
def hybrid_search(spark, sf_dir):
    return R.hybrid_search(_queries(spark, sf_dir), _texts(spark, sf_dir), 10, vectors=_vectors(spark, sf_dir))


@add(f"with {_HITS} select query_id, chunk_id, score from hits where score >= 0.35 or sim >= 0.3 or bm25 >= 0.15")
def relevance_filter(spark, sf_dir):
    return R.relevant(_hits(spark, sf_dir)).select("query_id", "chunk_id", "score")


@add(f"with {_HITS}, m as (select *, score >= 0.9 or sim >= 0.9 or bm25 >= 0.95 as ok from hits), a as (select *, max(ok) over (partition by query_id) as any_ok from m) select query_id, chunk_id, score from a where ok or (not any_ok and (score >= 0 or sim >= 0 or bm25 >= 0))")
def relaxed_filter(spark, sf_dir):
    return R.relevant(_hits(spark, sf_dir), 0.9, 0.9, 0.95, relax=True).select("query_id", "chunk_id", "score")


_BOOST = f"{_HITS}, bo as (select * exclude (score, rank), round(score + case role when 'definition' then 0.25 when 'example' then 0.2 when 'summary' then 0.15 else 0 end::double, 9) as score from hits), boosted as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from bo)"


@add(f"with {_BOOST} select query_id, chunk_id, role, score, rank from boosted")
def pedagogy_rerank(spark, sf_dir):
    return R.pedagogy_boost(_hits(spark, sf_dir), ROLES).select("query_id", "chunk_id", "role", "score", "rank")


@add(f"with {_HITS}, n as (select *, row_number() over (partition by query_id, resource_id, page_number order by rank) as n from hits) select query_id, chunk_id, rank from n where n <= 1")
def page_diversity(spark, sf_dir):
    return R.spread_pages(_hits(spark, sf_dir)).select("query_id", "chunk_id", "rank")


@add(f"with {_HITS}, d as (select query_id, chunk_id, rank from hits union all select query_id, case when bm25 > 0 then chunk_id end, rank + 50 from hits), n as (select *, row_number() over (partition by query_id, chunk_id order by rank) as n from d where chunk_id is not null) select query_id, chunk_id, rank::int as rank from n where n = 1")
def hit_dedup(spark, sf_dir):
    """Hits of two searches, the second one's only those by text, without chunk otherwise."""
    h = _hits(spark, sf_dir)
    again = h.select("query_id", F.when(F.col("bm25") > 0, F.col("chunk_id")).alias("chunk_id"), (F.col("rank") + 50).alias("rank"))
    return R.distinct_hits(h.select("query_id", "chunk_id", "rank").union(again)).select("query_id", "chunk_id", "rank")


@add(f"""with {_HITS}, n as (select *, row_number() over (partition by query_id, resource_id, page_number order by source_offset is null, source_offset, chunk_id) as n from hits), g as (select *, ((n - 1) // 2)::int as part from n)
    select query_id, resource_id, page_number, part, string_agg(chunk_id::varchar, '|' order by n) as chunk_ids, left(string_agg(snippet, ' ' order by n), 600) as snippet from g group by query_id, resource_id, page_number, part""")
def microchunk_windows(spark, sf_dir):
    c = R.consolidate(_hits(spark, sf_dir))
    return c.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), "|"))


@add(f"""with recursive {_HITS}, n as (select query_id, resource_id, page_number, chunk_id, length(snippet) as size, row_number() over (partition by query_id, resource_id, page_number order by source_offset is null, source_offset, chunk_id) as n from hits),
    f as (select query_id, resource_id, page_number, chunk_id, n, size as used, 0 as part from n where n = 1
      union all select n.query_id, n.resource_id, n.page_number, n.chunk_id, n.n, case when f.used < 500 then f.used + n.size else n.size end, case when f.used < 500 then f.part else f.part + 1 end from f join n on n.query_id = f.query_id and n.resource_id = f.resource_id and n.page_number = f.page_number and n.n = f.n + 1)
    select query_id, resource_id, page_number, part::int as part, string_agg(chunk_id::varchar, '|' order by n) as chunk_ids from f group by query_id, resource_id, page_number, part""")
def microchunk_packing(spark, sf_dir):
    c = R.consolidate(_hits(spark, sf_dir), target_chars=500)
    return c.select("query_id", "resource_id", "page_number", "part", F.array_join("chunk_ids", "|").alias("chunk_ids"))


@add(f"""with {_HITS}, k as (select * from hits where rank <= 5) select item_id as query_id, coalesce(string_agg(chunk_id::varchar, '|' order by rank), '') as ids, coalesce(max(score), 0) as best from benchmark left join k on query_id = item_id group by item_id""")
def search_bench(spark, sf_dir):
    q = _queries(spark, sf_dir)
    b = R.search_bench(R.hybrid_search(q, _texts(spark, sf_dir), 5, vectors=_vectors(spark, sf_dir)), q)
    return b.select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("ids"), F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best"))


@add(f"""with {_HITS}, r as (select * from hits where score >= 0.35 or sim >= 0.3 or bm25 >= 0.15), p as (select *, row_number() over (partition by query_id, resource_id, page_number order by rank) as n from r), o as (select *, row_number() over (partition by query_id order by rank) as m from p where n = 1)
    select query_id, chunk_id, snippet from o where m = 1 order by query_id limit 5""")
def quiz_pick(spark, sf_dir):
    return R.best_per_concept(_hits(spark, sf_dir), 5).select("query_id", "chunk_id", "snippet")


@add(f"""with {_HITS.replace('rank <= 50)', 'rank <= 12)')}, m as (select *, score >= 0.35 or sim >= 0.3 or bm25 >= 0.15 as ok from hits), a as (select *, max(ok) over (partition by query_id) as any_ok from m), r as (select * from a where ok or (not any_ok and (score >= 0 or sim >= 0 or bm25 >= 0))),
    bo as (select * exclude (score, rank), round(score + case role when 'definition' then 0.25 when 'example' then 0.2 when 'summary' then 0.15 else 0 end::double, 9) as score from r), b2 as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bo),
    t as (select *, min(rank) over (partition by query_id, resource_id, page_number order by source_offset is null, source_offset, chunk_id rows between 1 preceding and 1 following) as turn from b2),
    n as (select *, row_number() over (partition by query_id, resource_id, page_number order by turn, source_offset, chunk_id) as n from t), p as (select *, row_number() over (partition by query_id order by turn, source_offset, chunk_id)::int as place from n where n <= 4)
    select query_id, chunk_id, place from p where place <= 8""")
def tutor_retrieval(spark, sf_dir):
    return R.tutor_retrieve(_queries(spark, sf_dir), _texts(spark, sf_dir), ROLES, k=3, vectors=_vectors(spark, sf_dir))


@add(f"""with recursive {_HITS.replace('rank <= 50)', 'rank <= 12)')}, rel as (select * from hits where score >= 0.35 or sim >= 0.3 or bm25 >= 0.15),
    n as (select query_id, resource_id, page_number, chunk_id, snippet, length(snippet) as size, row_number() over (partition by query_id, resource_id, page_number order by source_offset is null, source_offset, chunk_id) as n from rel),
    f as (select query_id, resource_id, page_number, chunk_id, snippet, n, size as used, 0 as part from n where n = 1
      union all select n.query_id, n.resource_id, n.page_number, n.chunk_id, n.snippet, n.n, case when f.used < 1200 then f.used + n.size else n.size end, case when f.used < 1200 then f.part else f.part + 1 end from f join n on n.query_id = f.query_id and n.resource_id = f.resource_id and n.page_number = f.page_number and n.n = f.n + 1),
    packs as (select query_id, resource_id, page_number, part, left(string_agg(snippet, ' ' order by n), 1200) as snippet, arg_min(chunk_id, n)::varchar as cid from f group by query_id, resource_id, page_number, part),
    li as (select *, row_number() over (partition by query_id order by resource_id, page_number, part) as k from packs)
    select query_id, string_agg('[' || k::varchar || '] ' || left(snippet, 320) || ' (chunk_id:' || cid || ', page:' || page_number::varchar || ')', chr(10) order by k) as context, coalesce(string_agg(cid, '|' order by k) filter (where k <= 3), '') as citations from li where k <= 6 group by query_id""")
def doubt_context(spark, sf_dir):
    d = R.doubt_context(R._ranked(_hits(spark, sf_dir).drop("rank"), 12, F.desc("score"), F.col("chunk_id")))
    return d.withColumn("citations", F.array_join("citations", "|"))


@add(f"""with {_HITS}, p as (select *, row_number() over (partition by query_id, resource_id, page_number order by rank) as n from hits), o as (select *, row_number() over (partition by query_id order by rank) as m from p where n = 1),
    b as (select item_id as query_id, row_number() over (order by item_id) - 1 as place, count(*) over () as items from benchmark),
    u as (select distinct user_id, event_type as concept, query_id from events join b on user_id % items = place) select user_id, concept, chunk_id, left(snippet, 200) as snippet from u join o using (query_id) where m <= 2""")
def weak_concept_references(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    # every item is some learners' question; one row an item is numbered, so the window is small
    items = b.select(F.col("item_id").alias("query_id"), (F.row_number().over(W.orderBy("item_id")) - 1).alias("place"))
    weak = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("concept"), (F.col("user_id") % F.lit(max(b.count(), 1))).alias("place")).distinct()
    weak = weak.join(items, "place").select("user_id", "concept", "query_id")
    return R.weak_references(weak, _hits(spark, sf_dir))
