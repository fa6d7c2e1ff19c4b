"""Queries of chunk relations, sections, re-ingestion and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linking, quality
from .inputs import CHUNKS_SQL, chunks, table
from .registry import Registry
from .text_queries import _BLOOM, _CONTENT, _LATEX, _STRIPPED

REGISTRY = Registry()
add = REGISTRY.add
_STRIP = "regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
_W = "(partition by doc_id order by idx)"


@add(f"with {CHUNKS_SQL} select chunk_id, lag(chunk_id) over {_W} as previous_chunk_id, lead(chunk_id) over {_W} as next_chunk_id, last_value(nullif(section_title, '') ignore nulls) over (partition by doc_id order by idx rows between unbounded preceding and current row) as parent_section_id from chunks")
def chunk_links(spark, sf_dir):
    return linking.links(chunks(spark, sf_dir)).select("chunk_id", "previous_chunk_id", "next_chunk_id", "parent_section_id")


@add(f"""with {CHUNKS_SQL} select chunk_id, coalesce({_STRIP.format(f'left(lag(full_text) over {_W}, 200)')}, '') as previous_chunk_summary, coalesce({_STRIP.format(f'right(lag(full_text) over {_W}, 500)')}, '') as surrounding_text_before,
    coalesce({_STRIP.format(f'left(lead(full_text) over {_W}, 200)')}, '') as next_chunk_preview, coalesce({_STRIP.format(f'left(lead(full_text) over {_W}, 500)')}, '') as surrounding_text_after,
    case when section_title <> '' then 'Part of section: ' || section_title else '' end as section_context,
    coalesce(first_value(case when section_level = 1 then nullif(section_title, '') end ignore nulls) over (partition by doc_id order by idx rows between 5 preceding and 4 following), '') as chapter_theme,
    row_number() over {_W}::int as position_in_section, count(*) over (partition by doc_id) as total_chunks from chunks""")
def context_windows(spark, sf_dir):
    c = linking.context_windows(chunks(spark, sf_dir))
    return c.select("chunk_id", "previous_chunk_summary", "surrounding_text_before", "next_chunk_preview", "surrounding_text_after", "section_context", "chapter_theme", "position_in_section", "total_chunks")


@add(f"""with {CHUNKS_SQL} select chunk_id, row_number() over (partition by doc_id, section_title order by idx)::int as position_in_section, count(*) over (partition by doc_id, section_title) as total_in_section,
    row_number() over {_W}::int as position_in_chapter, count(*) over (partition by doc_id) as total_in_chapter from chunks""")
def section_positions(spark, sf_dir):
    return linking.positions(chunks(spark, sf_dir)).select("chunk_id", "position_in_section", "total_in_section", "position_in_chapter", "total_in_chapter")


@add(f"""with {CHUNKS_SQL}, k as (select *, 'chunk_' || idx::varchar || '_' || page_number::varchar as cid from chunks) select doc_id, idx, cid as chunk_id, lag(cid) over {_W} as previous_chunk_id, lead(cid) over {_W} as next_chunk_id,
    last_value(nullif(section_title, '') ignore nulls) over (partition by doc_id order by idx rows between unbounded preceding and current row) as parent_section_id, coalesce({_STRIP.format(f'left(lag(full_text) over {_W}, 200)')}, '') as previous_chunk_summary,
    row_number() over (partition by doc_id, section_title order by idx)::int as position_in_section, count(*) over (partition by doc_id) as total_in_chapter from k""")
def linked_resource(spark, sf_dir):
    return linking.link_all(chunks(spark, sf_dir)).select("doc_id", "idx", "chunk_id", "previous_chunk_id", "next_chunk_id", "parent_section_id", "previous_chunk_summary", "position_in_section", "total_in_chapter")


_PREREQ = f"""{CHUNKS_SQL}, has as (select distinct doc_id, idx, unnest(list_concat(key_concepts, topic)) as term from tagged), wants as (select distinct doc_id, idx, unnest(prerequisites) as term from tagged),
    pre as (select w.doc_id, w.idx, w.term, max(h.idx)::int as prereq_idx from wants w join has h on w.doc_id = h.doc_id and w.term = h.term and h.idx < w.idx group by all)"""


@add(f"with {_PREREQ} select * from pre")
def prerequisite_links(spark, sf_dir):
    return linking.prerequisite_links(chunks(spark, sf_dir), ["key_concepts", "topic"])


@add(f"""with recursive {_PREREQ}, e as (select distinct doc_id, idx, prereq_idx from pre), longest(doc_id, idx, depth, step) as (select doc_id, idx, 0, 0 from chunks
      union all select e.doc_id, e.idx, l.depth + 1, l.step + 1 from (select distinct doc_id, idx, depth, step from longest) l join e on e.doc_id = l.doc_id and e.prereq_idx = l.idx)
    select doc_id, idx, max(depth)::int as depth from longest group by doc_id, idx""")
def prerequisite_depth(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return linking.chain_depth(c, linking.prerequisite_links(c, ["key_concepts", "topic"]))


_VECTOR = "[" + ", ".join(f"len(regexp_extract_all(left(full_text, 500), '[{c}]'))::double" for c in ("aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz", " .,;")) + "]"


def _vector():
    return F.array(*(F.regexp_count(F.left("full_text", F.lit(500)), F.lit(f"[{c}]")).cast("double") for c in ("aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz", " .,;")))


def _continuity(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumns({"content_type": T.content_type(F.col("full_text")), "v": _vector()})
    return linking.continuity(c, T.cosine(F.col("v"), F.lag("v").over(linking.in_order())))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_CONT = f"""{CHUNKS_SQL}, t as (select *, {_CONTENT} as content_type, {_VECTOR} as v from tagged),
    b as (select *, lag(chunk_id) over {_W} is null as first, lag(section_title) over {_W} as title0, lag(topic) over {_W} as topic0, lag(key_concepts) over {_W} as concepts0, lag(v) over {_W} as v0 from t),
    c as (select *, round(case when first then 0.0::double else {_DOT.format('v', 'v0')} / (sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('v0', 'v0')})) end, 3) as coherence,
        not first and section_title <> title0 and section_title <> '' as is_new, not first and topic is distinct from topic0 as is_shift from b),
    cont as (select *, is_new or is_shift as starts_new_topic, not first and content_type = 'summary' as concludes_topic,
        case when first then 'continuation' when content_type = 'example' and coherence > 0.5 then 'example' when content_type in ('derivation', 'summary') then content_type when is_new then 'new_section' when is_shift then 'topic_shift' else 'continuation' end as transition_type,
        case when first then '' else array_to_string(list_sort(list_distinct(list_filter(key_concepts, lambda k: list_contains(concepts0, k)))), '|') end as concept_overlap from c)"""


@add(f"with {_CONT} select chunk_id, coherence, starts_new_topic, transition_type, concludes_topic, concept_overlap from cont")
def semantic_continuity(spark, sf_dir):
    c = _continuity(spark, sf_dir)
    return c.select("chunk_id", "coherence", "starts_new_topic", "transition_type", "concludes_topic", F.array_join("concept_overlap", "|").alias("concept_overlap"))


@add(f"""with {_CONT}, sg as (select *, not first and section_title <> '' and section_title <> title0 as sec, not first and coalesce(lag(content_type) over {_W}, '') = 'summary' and content_type in ('concept_intro', 'definition') as summ, not first and coherence < 0.3 as low from cont),
    q as (select *, sec or summ or low as is_topic_start from sg)
    select chunk_id, is_topic_start, case when summ then 0.75 when sec then 0.95 when low then 0.6 else 0.0 end::double as transition_confidence,
        case when sec then section_title when low and not summ then coalesce(topic[1], '') else '' end as new_topic_name, coalesce(lead(is_topic_start) over {_W}, false) as is_topic_end from q""")
def topic_transitions(spark, sf_dir):
    c = linking.topic_transitions(_continuity(spark, sf_dir))
    return c.select("chunk_id", "is_topic_start", "transition_confidence", "new_topic_name", "is_topic_end")


@add(f"""with {CHUNKS_SQL}, p as (select a.doc_id, a.idx, b.topic[1] as t from tagged a join tagged b on a.doc_id = b.doc_id and b.idx between a.idx + 1 and a.idx + 5
        where len(list_filter(b.prerequisites, lambda p: len(list_filter(a.key_concepts, lambda k: contains(k, p))) > 0)) > 0),
    g as (select doc_id, idx, list_sort(list(distinct t)) as ts from p where t is not null group by doc_id, idx)
    select t.doc_id, t.idx, array_to_string(list_slice(coalesce(ts, []), 1, 3), '|') as prepares_for from tagged t left join g using (doc_id, idx)""")
def learning_look_ahead(spark, sf_dir):
    return linking.look_ahead(chunks(spark, sf_dir)).select("doc_id", "idx", F.array_join("prepares_for", "|").alias("prepares_for"))


@add(f"""with {CHUNKS_SQL}, p as (select *, (row_number() over (partition by doc_id, page_number order by source_offset, chunk_id))::int as place from chunks), h as (select (doc_id % 3)::int as query_id, * from p where contains(full_text, 'gradient'))
    select query_id, p.chunk_id, min(abs(h.place - p.place))::int as distance from h join p on h.doc_id = p.doc_id and h.page_number = p.page_number and p.place between h.place - 1 and h.place + 1 group by query_id, p.chunk_id""")
def neighbour_expansion(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = c.where(F.col("full_text").contains("gradient")).select((F.col("doc_id") % 3).cast("int").alias("query_id"), "chunk_id")
    return linking.neighbours(hits, c)


@add(f"""with {CHUNKS_SQL}, sec as (select doc_id, idx, case when idx % 2 = 0 then (idx % 5)::varchar else '9' end as number, (idx * 7) as off from chunks), se as (select doc_id, k::varchar as number, k * 20 as start, k * 20 + 25 as stop, 'S' || k::varchar as title from (select distinct doc_id from chunks), range(5) r(k)),
    n as (select sec.*, se.title as by_number from sec left join se using (doc_id, number))
    select doc_id, idx, coalesce(by_number, (select arg_min(title, start) from se where se.doc_id = n.doc_id and start <= off and off < stop)) as section from n""")
def section_assignment(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", "idx", F.when(F.col("idx") % 2 == 0, (F.col("idx") % 5).cast("string")).otherwise("9").alias("number"), (F.col("idx") * 7).alias("offset"))
    s = c.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    s = s.select("doc_id", F.col("k").cast("string").alias("number"), (F.col("k") * 20).alias("start"), (F.col("k") * 20 + 25).alias("stop"), F.concat(F.lit("S"), F.col("k").cast("string")).alias("title"))
    return linking.assign_sections(c, s).select("doc_id", "idx", "section")


@add(f"""with {CHUNKS_SQL}, k as (select *, section_level::varchar as section_key from chunks), n as (select *, case when section_key = lag(section_key) over {_W} then 0 else 1 end as is_new from k),
    r as (select *, sum(is_new) over {_W} as run from n) select doc_id, run::bigint as run, min(section_key) as section_key, count(*)::int as chunks from r group by doc_id, run""")
def section_runs(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("section_key", F.col("section_level").cast("string"))
    return linking.consecutive_sections(c).select("doc_id", "run", "section_key", "chunks")


@add(f"""with {CHUNKS_SQL} select coalesce(nullif(section_title, ''), 'unknown') as title, section_level::varchar as number, count(*) as chunks, (sum(length(full_text) + 2) - 2)::bigint as chars, min(chunk_id) as first_chunk from chunks group by 1, 2""")
def section_totals(spark, sf_dir):
    """Sections by title and number over all resources. The texts themselves can be joined per resource by
    section_runs; here only their sizes are, for one title may hold a third of all chunks."""
    c = chunks(spark, sf_dir)
    g = c.groupBy(F.coalesce(F.nullif("section_title", F.lit("")), F.lit("unknown")).alias("title"), F.col("section_level").cast("string").alias("number"))
    return g.agg(F.count("*").alias("chunks"), (F.sum(F.length("full_text") + 2) - 2).alias("chars"), F.min("chunk_id").alias("first_chunk"))


@add("""with old as (select doc_id as id, source, coalesce(text, '') as t, row_number() over (partition by text order by doc_id) as r from documents),
    e as (select doc_id::varchar as id, coalesce(source, '') as resource_id, (doc_id % 1000)::int as page_number, (doc_id // 1000)::int as source_offset, coalesce(text, '') as t from documents where doc_id % 5 <> 0),
    i as (select coalesce(source, '') as resource_id, (doc_id % 1000)::int as page_number, (doc_id // 1000)::int as source_offset, case when doc_id % 3 = 0 then coalesce(text, '') || '!' else coalesce(text, '') end as t from documents where doc_id % 7 <> 0)
    select case when e.id is null then 'insert' when i.t is null then 'delete' when i.t <> e.t then 'update' else 'unchanged' end as action, e.id, resource_id, page_number, source_offset from i full join e using (resource_id, page_number, source_offset)""")
def reindex_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("resource_id"), (F.col("doc_id") % 1000).cast("int").alias("page_number"), F.floor(F.col("doc_id") / 1000).cast("int").alias("source_offset"), F.col("text").alias("full_text"), F.col("doc_id").alias("pos"))
    existing = d.where("pos % 5 <> 0").withColumn("id", F.col("pos").cast("string"))
    incoming = d.where("pos % 7 <> 0").withColumn("full_text", F.when(F.col("pos") % 3 == 0, F.concat(F.coalesce("full_text", F.lit("")), F.lit("!"))).otherwise(F.col("full_text")))
    return linking.diff(incoming, existing)


@add("""with d as (select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'v1' else 'v2' end as version, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) as words from documents)
    select doc_id, version is null or version <> 'v2' as embedded, case when version = 'v2' then 0.5::double else words % 100 / 100.0::double end as first_component from d""")
def embedding_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("full_text"), F.when(F.col("doc_id") % 3 == 1, "v1").when(F.col("doc_id") % 3 == 2, "v2").alias("embedding_version"))
    d = d.withColumn("embedding", F.when(F.col("embedding_version").isNotNull(), F.array_repeat(F.lit(0.5), 384)))
    return linking.upsert_embeddings(d, "v2", T.fallback_embedding).select("doc_id", "embedded", F.get("embedding", F.lit(0)).alias("first_component"))


# Points of a chunk's metadata; what is always there here counts 60.
_GRADE = "case when s >= 95 then 'A+' when s >= 90 then 'A' when s >= 80 then 'B' when s >= 70 then 'C' when s >= 60 then 'D' else 'F' end"


@add(f"""with {CHUNKS_SQL}, c as (select *, list_distinct({_STRIPPED.format(_LATEX)}) as fs from tagged), v as (select *, list_transform(fs, lambda f: len(regexp_extract_all(regexp_replace(f, '[À-ÖØ-öø-ʯ]', '0', 'g'), '\\b([a-z])\\b', 1)) > 0) as vs from c),
    p as (select len(fs) as n, len(list_filter(vs, lambda x: x)) as complete, idx % 10 <> 0 and len(topic) > 0 as tagged, len(prerequisites) > 0 as pre,
        least(100, 10 + case when idx % 10 <> 0 then 7 else 0 end + case when len(topic) > 0 then 7 else 0 end + case when len(key_concepts) > 0 then 6 else 0 end + case when len(prerequisites) > 0 then 8 else 0 end + case when len(fs) > 0 then 10 else 0 end + case when list_contains(vs, true) then 5 else 0 end + 10 + 10 + 10 + 5 + 5) as points from v),
    a as (select count(*) as total, sum(n) as f, sum(complete) as complete, count(*) filter (where tagged) as tagged, count(*) filter (where pre) as pre, avg(points) as rich, min(points) as low, max(points) as high from p),
    r as (select *, 100.0::double * f / greatest(f, 1) as r1, 100.0::double * tagged / greatest(total, 1) as r2, 100.0::double * complete / greatest(f, 1) as r3, 100.0::double * pre / greatest(total, 1) as r4, 100.0::double * total / greatest(total, 1) as r5 from a),
    q as (select *, (r1 >= 95)::int + (r2 >= 90)::int + (r3 >= 70)::int + (r4 >= 30)::int + (r5 >= 95)::int + (r5 >= 90)::int as passed from r)
    select total, round(r1, 2) as formulas_preserved, round(r2, 2) as tags_hierarchical, round(r3, 2) as formulas_complete, round(r4, 2) as prerequisites_present, round(r5, 2) as context_windows, round(r5, 2) as relationships_linked, passed as checks_passed,
        round(rich, 2) as richness, low as least_richness, high as most_richness, {_GRADE} as grade from (select *, passed / 6.0::double * 60 + rich * 0.4::double as s from q)""")
def quality_report(spark, sf_dir):
    c = linking.links(chunks(spark, sf_dir))
    found = T.latex_formulas(F.col("full_text"))
    c = c.select(
        "full_text", F.when(F.col("idx") % 10 != 0, F.array("section_title")).alias("domain"), "topic", F.slice("key_concepts", 1, 1).alias("subtopic"), "prerequisites", F.array().cast("array<string>").alias("learning_objectives"),
        F.transform(found, lambda f: F.struct(F.left(F.sha2(f, 256), F.lit(16)).alias("id"), f.alias("latex"), T.formula_type(f).alias("type"), F.regexp_extract_all(f, F.lit(r"\b([a-z])\b"), F.lit(1)).alias("variables"))).alias("formulas"),
        F.struct(F.col("previous_chunk_id").alias("previous_chunk_summary")).alias("context"), F.struct("previous_chunk_id", F.array().cast("array<string>").alias("prerequisite_chunk_ids")).alias("relationships"),
        F.struct(F.lit(0.0).alias("topic_coherence_score")).alias("continuity"), F.struct(F.lit(1).alias("position_in_section")).alias("sequence"), F.struct(T.bloom_level(F.col("full_text")).alias("bloom_level")).alias("complexity"),
    )
    return quality.report(c)


@add("""with r as (select l_orderkey, 1 + sum(l_quantity) / 20 as enhanced, 1 + count(*) as basic, 10 + sum(l_tax) * 50 as emb, 10.0 as bmb from lineitem group by l_orderkey), q as (select enhanced / basic as t, emb / bmb as m from r)
    select count(*) as n, round(avg(t), 4) as time_x, round(avg(m), 4) as memory_x, round(100.0::double * count(*) filter (where t < 3) / count(*), 2) as time_ok, round(100.0::double * count(*) filter (where m < 2) / count(*), 2) as memory_ok from q""")
def run_comparison(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((1 + F.sum("l_quantity") / 20).alias("enhanced_s"), (1 + F.count("*")).alias("basic_s"), (10 + F.sum("l_tax") * 50).alias("enhanced_mb"), F.lit(10.0).alias("basic_mb"))
    return quality.run_comparison(r)


@add("""with m as (select o_custkey as resource_id, sum(o_totalprice) / 100 as total_ms, avg(o_totalprice % 100) + 40 as formula_pct, avg(o_orderkey % 100) + 20 as tag_pct from orders group by o_custkey)
    select resource_id, 'processing_time' as alert, 'warning' as severity from m where total_ms > 15000 union all select resource_id, 'formula_preservation', 'critical' from m where formula_pct < 80 union all select resource_id, 'tag_coverage', 'warning' from m where tag_pct < 70""")
def metric_alerts(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("resource_id")).agg((F.sum("o_totalprice") / 100).alias("total_ms"), (F.avg(F.col("o_totalprice") % 100) + 40).alias("formula_pct"), (F.avg(F.col("o_orderkey") % 100) + 20).alias("tag_pct"))
    return quality.alerts(m)


@add(f"""with {CHUNKS_SQL}, k as (select doc_id, idx, unnest(key_concepts) as c, unnest(range(len(key_concepts))) as p from tagged), f as (select doc_id, c, min(idx * 10 + p) as first from k group by all),
    m as (select t.doc_id, t.idx, f.c, f.first from tagged t join f on f.doc_id = t.doc_id and f.first < t.idx * 10 and contains(lower(t.full_text), f.c) and not list_contains(t.prerequisites, f.c)), g as (select doc_id, idx, list(c order by first) as cs from m group by all),
    o as (select doc_id, idx, (select list(x order by i) from (select x, min(i) as i from (select unnest(t.prerequisites) as x, unnest(range(len(t.prerequisites))) as i) group by x)) as own from tagged t)
    select o.doc_id, o.idx, array_to_string(list_slice(list_concat(coalesce(own, []), coalesce(cs, [])), 1, 10), '|') as prerequisites from o left join g using (doc_id, idx)""")
def implicit_prerequisites(spark, sf_dir):
    return linking.implicit_prerequisites(chunks(spark, sf_dir)).withColumn("prerequisites", F.array_join("prerequisites", "|"))
