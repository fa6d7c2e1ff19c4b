"""Queries of the concept graph: parts are concepts, orders chunks, lineitems mentions.

Prerequisite edges are a fixed rule over parts, which gives chains, hubs and cycles of known size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.names import alias_like
from ..operators import graph as G
from ..operators import similar as S
from ..operators.linking import links
from .inputs import CHUNKS_SQL, _quoted, chunks, sql_ladder, table
from .registry import Registry
from .text_queries import _LATEX, _STRIPPED, _VARIABLES

REGISTRY = Registry()
add = REGISTRY.add


def _edges(spark, sf_dir):
    """Two prerequisite edges per part, a null confidence for every 17th; parts divisible by 13 point at part 7."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    dst = F.array(F.when(F.col("src") % 13 == 0, F.lit(7)).otherwise((F.col("src") * 7 + 3) % 1500 + 1), (F.col("src") * 3 + 1) % 1500 + 1)
    e = p.select("src", F.posexplode(dst).alias("k", "dst"))
    return e.select("src", F.col("dst").cast("long").alias("dst"), F.when(F.col("k") == 0, "PREREQUISITE_OF").otherwise("RELATED_TO").alias("type"), F.when(F.col("src") % 17 != 0, (F.col("src") % 10) / 10.0).alias("confidence")).where("src <> dst")


_EDGES = """p as (select p_partkey as src from part), ee as (select src, (case when src % 13 = 0 then 7 else (src * 7 + 3) % 1500 + 1 end)::bigint as dst, 'PREREQUISITE_OF' as type from p union all select src, ((src * 3 + 1) % 1500 + 1)::bigint, 'RELATED_TO' from p),
    edges as (select src, dst, type, case when src % 17 <> 0 then (src % 10) / 10.0::double end as confidence from ee where src <> dst)"""


@add(f"""with {CHUNKS_SQL}, k as (select distinct chunk_id as chunk, unnest(key_concepts) as concept, lower(full_text) as low from tagged), m as (select chunk, concept, greatest((length(low) - length(replace(low, concept, ''))) // length(concept), 1) as frequency from k)
    select concept, chunk, frequency, least(1.0::double, frequency / (sum(frequency) over (partition by chunk))::double) as salience from m""")
def concept_occurrences(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("chunk_id").alias("chunk"), "full_text", F.explode(F.array_distinct("key_concepts")).alias("concept"))
    return G.occurrences(c.select("concept", "chunk", T.occurrences(F.col("full_text"), F.col("concept")).cast("long").alias("times")))


@add("""with c as (select l_orderkey as chunk, list(distinct l_partkey) as cs from lineitem group by l_orderkey), u as (select chunk, unnest(cs) as x from c)
    select a.x as a, b.x as b, (count(*) * 1.0)::double as weight, count(*) as chunks from u a join u b on a.chunk = b.chunk and a.x < b.x group by a.x, b.x""")
def co_occurrence(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_set("l_partkey").alias("concepts"))
    return G.co_occurrence(c)


@add("""with m as (select lower(p_name) as key, p_name as display_name, l_shipdate as seen, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey as seq from lineitem join part on l_partkey = p_partkey where p_name <> '')
    select key, arg_min(display_name, seq) as display_name, min(seen) as created_at, max(seen) as last_seen, count(*) as mentions from m group by key""")
def node_merge(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").alias("seen"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"))
    rows = l.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.lower("p_name").alias("key"), F.col("p_name").alias("display_name"), "seen", "seq")
    return G.merge_nodes(rows)


@add("""with e as (select l_suppkey as src, l_partkey % 50 + 200000 as dst, l_returnflag as type, l_discount as confidence, l_orderkey as evidence, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey as seq from lineitem)
    select src, dst, type, arg_max(confidence, seq) as confidence, arg_min(evidence, seq) as evidence from e where src <> dst group by src, dst, type""")
def edge_merge(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50 + 200000).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("evidence"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"))
    return G.merge_edges(e)


@add("""with e as (select l_partkey % 100 as key, case when l_linenumber % 2 = 0 then l_quantity end as a, case when l_linenumber % 3 = 0 then l_shipmode end as b, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey as seq from (select *, l_returnflag as l_shipmode from lineitem))
    select key, arg_max(a, seq) filter (where a is not null) as a, arg_max(b, seq) filter (where b is not null) as b from e group by key""")
def property_merge(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("key"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).alias("b"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"))
    return G.merge_properties(e, ["a", "b"])


_TYPES = [*rules.RELATION_CONFIDENCE, "OTHER"]


@add(f"""with e as (select l_orderkey as src, l_partkey as dst, (array[{', '.join(map(_quoted, _TYPES))}])[(l_linenumber + l_partkey % 8) % 8 + 1] as type, 0.5::double + l_discount * 4 as confidence from lineitem),
    k as (select src, dst, case when type = 'OTHER' then 'RELATED_TO' else type end as type, confidence from e) select * from k where confidence >= case type {' '.join(f"when '{t}' then {c}" for t, c in rules.RELATION_CONFIDENCE.items())} end::double""")
def relation_thresholds(spark, sf_dir):
    types = F.array(*map(F.lit, _TYPES))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.element_at(types, ((F.col("l_linenumber") + F.col("l_partkey") % 8) % 8 + 1).cast("int")).alias("type"), (0.5 + F.col("l_discount") * 4).alias("confidence"))
    return G.confident(e)


@add("""with n as (select p_name as key from part where p_partkey % 3 <> 0), k as (select lower(key) as l, min(key) as k from n group by 1), e as (select upper(p_name) as src, p_brand as dst from part),
    o as (select coalesce(a.k, src) as src, coalesce(b.k, dst) as dst from e left join k a on lower(src) = a.l left join k b on lower(dst) = b.l) select distinct key, key not in (select key from n) as created from (select key from n union select src from o union select dst from o)""")
def endpoint_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = p.where("p_partkey % 3 <> 0").select(F.col("p_name").alias("key"), F.lit(False).alias("created"))
    nodes, _ = G.with_endpoints(n, p.select(F.upper("p_name").alias("src"), F.col("p_brand").alias("dst")))
    return nodes.select("key", F.coalesce("created", F.lit(True)).alias("created")).distinct()


@add("""with ev as (select l_returnflag as type, l_partkey as target, l_orderkey as chunk, l_discount as confidence from lineitem), r as (select distinct l_returnflag as type, l_partkey as target, l_suppkey as source from lineitem),
    b as (select type, target, chunk, confidence, row_number() over (partition by type, target order by confidence desc, chunk) as n from ev) select r.type, r.target, r.source, b.chunk as evidence_chunk, b.confidence as evidence_confidence from r left join b on r.type = b.type and r.target = b.target and n = 1""")
def relation_evidence(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("chunk"), F.col("l_discount").alias("confidence"))
    return G.best_evidence(l.select("type", "target", "source").distinct(), l)


@add("""with stored as (select distinct p_name as key from part where p_size % 2 = 0), fresh as (select distinct upper(p_name) as key from part where p_size % 3 = 0),
    l as (select lower(key) as low, min(key) as key from stored group by 1), nodes as (select min(key) as key from (select key from stored union all select key from fresh where lower(key) not in (select low from l)) group by lower(key)),
    e as (select p_name as src, p_brand as dst, 'RELATED_TO' as type from part where p_size % 2 = 0 union all select upper(p_name), p_brand, case when p_size % 4 = 0 then 'RELATED_TO' else 'DEFINES' end from part),
    k as (select lower(key) as low, min(key) as key from nodes group by 1), o as (select distinct coalesce(a.key, src) as src, coalesce(b.key, dst) as dst, type from e left join k a on lower(src) = a.low left join k b on lower(dst) = b.low), p as (select * from o where src <> dst),
    n as (select key from nodes union select src from o union select dst from o)
    select 'node' as kind, count(*) as n from n union all select type, count(*) from p group by type""")
def graph_merge(spark, sf_dir):
    """Sizes of a graph after an extracted one was merged into it."""
    p = table(spark, sf_dir, "part")
    stored, fresh = p.where("p_size % 2 = 0"), p.where("p_size % 3 = 0")
    edge = lambda rows, src, kind: rows.select(src.alias("src"), F.col("p_brand").alias("dst"), kind.alias("type"), F.lit(0.7).alias("confidence"))
    kinds = F.when(F.col("p_size") % 4 == 0, "RELATED_TO").otherwise("DEFINES")
    merged = G.merge_graph(stored.select(F.col("p_name").alias("key")).distinct(), edge(stored, F.col("p_name"), F.lit("RELATED_TO")), fresh.select(F.upper("p_name").alias("key")).distinct(), edge(p, F.upper("p_name"), kinds))
    return G.graph_counts(*merged)


@add(f"with {_EDGES} select key, count(*) as degree from (select src as key from edges union all select dst from edges) group by key")
def node_degrees(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@add(f"with {_EDGES}, deg as (select key, count(*) as d from (select src as key from edges union all select dst from edges) group by key) select src, dst, type, confidence from edges where src not in (select key from deg where d > 30) and dst not in (select key from deg where d > 30) and coalesce(confidence, 1.0) >= 0.3")
def prune_hubs_and_weak(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.detach(e, G.degrees(e).where("degree > 30")).where(F.coalesce("confidence", F.lit(1.0)) >= 0.3)


@add(f"with {_EDGES}, n as (select p_partkey as key from part union all select 1000000 + s_suppkey from supplier) select key from n where key in (select src from edges union all select dst from edges)")
def prune_singletons(spark, sf_dir):
    """Parts with edges, and suppliers, which have none."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 1_000_000))
    return G.drop_singletons(nodes, _edges(spark, sf_dir))


_CYCLES = f"""{_EDGES}, d as (select distinct src, dst from edges), w(path, tip) as (select [src, dst], dst from d where dst > src union all select list_append(path, d.dst), d.dst from w join d on d.src = w.tip where d.dst > path[1] and not list_contains(path, d.dst) and len(path) < 10),
    cyc as (select path from w join d on d.src = w.tip and d.dst = path[1])"""


@add(f"with recursive {_CYCLES} select array_to_string(path, '>') as path, len(path)::int as length from cyc")
def cycles(spark, sf_dir):
    c = G.cycles(_edges(spark, sf_dir), 10)
    return c.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").alias("length"))


@add(f"""with recursive {_CYCLES}, u as (select path, unnest(path) as src, unnest(list_append(path[2:], path[1])) as dst from cyc), m as (select src, dst, min(coalesce(confidence, 1.0)) as c from edges group by all),
    r as (select path, src, dst, row_number() over (partition by path order by c, src, dst) as n from u join m using (src, dst)) select src, dst, type, confidence from edges e where not exists (select 1 from r where n = 1 and r.src = e.src and r.dst = e.dst)""")
def break_cycles(spark, sf_dir):
    return G.break_cycles(_edges(spark, sf_dir), 10).select("src", "dst", "type", "confidence")


@add(f"""with recursive {_EDGES}, b as (select src, dst from edges union select dst, src from edges), w(key, hops) as (select 7::bigint, 0 union all select b.dst, hops + 1 from (select distinct key, hops from w) w join b on b.src = w.key where hops < 2) select key, min(hops)::int as hops from w group by key""")
def concept_subgraph(spark, sf_dir):
    seeds = spark.range(7, 8).select(F.col("id").alias("key"))
    return G.subgraph(_edges(spark, sf_dir), seeds, 2)


@add(f"""with recursive {_EDGES}, b as (select src, dst from edges union select dst, src from edges), w(key, hops) as (select 7::bigint, 0 union all select b.dst, hops + 1 from (select distinct key, hops from w) w join b on b.src = w.key where hops < 2),
    n as (select key, min(hops) as hops from w group by key) select distinct src, dst, type from edges where src in (select key from n where hops < 2) or dst in (select key from n where hops < 2)""")
def concept_subgraph_edges(spark, sf_dir):
    seeds = spark.range(7, 8).select(F.col("id").alias("key"))
    return G.subgraph_edges(_edges(spark, sf_dir), seeds, 2)


_FORMULA_GRAPH = f"""{CHUNKS_SQL}, f as (select distinct doc_id, chunk_id, key_concepts, unnest(list_distinct({_STRIPPED.format(_LATEX)})) as formula from tagged), i as (select *, sha256(doc_id::varchar || ':' || formula) as id from f),
    v as (select id, unnest({_VARIABLES}) as symbol from i), fig as (select distinct doc_id, chunk_id, key_concepts, unnest(list_transform(regexp_extract_all(full_text, '(?i)\\b(?:Fig|Figure)\\.?\\s*' || '{rules.NUMBER}', 1), lambda h: 'Fig. ' || h)) as label from tagged),
    e as (select 'HAS_FORMULA' as type, chunk_id as src, id as dst from i union select 'ABOUT', id, unnest(list_slice(key_concepts, 1, 3)) from i union select 'HAS_VARIABLE', id, left(sha256(id || ':' || symbol), 16) from v
      union select 'HAS_FIGURE', chunk_id, doc_id::varchar || ':' || label from fig union select 'ILLUSTRATES', doc_id::varchar || ':' || label, unnest(list_slice(key_concepts, 1, 3)) from fig)"""


@add(f"with {_FORMULA_GRAPH} select type, src, dst from e")
def formula_graph(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return G.formula_graph(c.withColumns({"formulas": T.latex_formulas(F.col("full_text")), "figures": T.cross_references(F.col("full_text"))["figures"]}))


@add(f"with {_FORMULA_GRAPH} select distinct id, formula as latex, {sql_ladder('formula', rules.FORMULA_LADDER, _quoted('algebraic'))} as type, array_to_string({_VARIABLES}, '|') as variables from i")
def formula_nodes(spark, sf_dir):
    n = G.formula_nodes(chunks(spark, sf_dir).withColumn("formulas", T.latex_formulas(F.col("full_text"))))
    return n.withColumn("variables", F.array_join("variables", "|"))


@add(f"""with recursive {_EDGES}, pe as (select distinct src, dst from edges where type = 'PREREQUISITE_OF'), w(target, key, depth) as (select p_partkey, p_partkey, 0 from part union all select target, src, depth + 1 from (select distinct * from w) w join pe on dst = key where depth < 4) select target, key, max(depth)::int as depth from w group by all""")
def prerequisite_closure(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"))
    return G.prerequisite_closure(_edges(spark, sf_dir).where("type = 'PREREQUISITE_OF'"), t, 4)


_SIGNED = "case when {0} % 5 = 0 then 'partial differential equation law ∂' when {0} % 5 = 1 then 'law' else 'heat transfer theory of a body' end"
_COMPLEX = "least(least(len(list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')), 5) + " + " + ".join(f"contains(lower({{0}}), '{t}')::int" for t in rules.COMPLEX_TERMS) + " + case when " + " or ".join(f"contains({{0}}, '{s}')" for s in rules.COMPLEX_SIGNS) + " then 2 else 0 end, 10)"


@add(f"""with {_EDGES}, n as (select *, {_SIGNED.format('src')} as src_name, {_SIGNED.format('dst')} as dst_name, case when src % 2 = 0 then 'APPLIES_TO' else type end as t2, (src * dst) % 100 / 100.0::double as s from edges),
    v as (select src, dst, t2 as type, confidence, case when t2 = 'PREREQUISITE_OF' and s > 0.9 then 'concepts_too_similar' when t2 = 'PREREQUISITE_OF' and s < 0.3 then 'concepts_unrelated' when t2 = 'APPLIES_TO' and s < 0.3::double * 0.83::double then 'unrelated_domains' when t2 = 'PREREQUISITE_OF' and {_COMPLEX.format('src_name')} > {_COMPLEX.format('dst_name')} + 2 then 'complexity_mismatch' else 'valid' end as verdict from n)
    select src, dst, type, case when verdict in ('concepts_too_similar', 'concepts_unrelated', 'unrelated_domains') then 0.0 when verdict = 'complexity_mismatch' then confidence * 0.5 else confidence end::double as confidence, verdict from v""")
def relation_validation(spark, sf_dir):
    def name(end):
        return F.when(F.col(end) % 5 == 0, "partial differential equation law ∂").when(F.col(end) % 5 == 1, "law").otherwise("heat transfer theory of a body")

    e = _edges(spark, sf_dir).withColumns({"src_name": name("src"), "dst_name": name("dst"), "type": F.when(F.col("src") % 2 == 0, "APPLIES_TO").otherwise(F.col("type"))})
    return G.validated(e, (F.col("src") * F.col("dst")) % 100 / 100.0).select("src", "dst", "type", "confidence", "verdict")


@add("""with n as (select p_partkey, p_name as display_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as key from part), m as (select *, lower(display_name) as l from n)
    select p_partkey, display_name, key, case when l = 'a' then 0 when starts_with(l, 'a') then 1 when contains(l, ' a') then 2 when contains(l, 'a') then 3 else 4 end::int as match from m where contains(l, 'a') or contains(key, 'a') order by match, display_name, key, p_partkey limit 20""")
def concept_search(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("display_name"), T.canonical_name(F.col("p_name")).alias("key"))
    return G.search(n, "a", 1 << 30).orderBy("match", "display_name", "key", "p_partkey").limit(20)


@add("""with d as (select coalesce(source, '') as resource_id, ['Part ' || (doc_id % 4)::varchar, ' Chapter ' || (doc_id % 3)::varchar, 'S' || (doc_id % 5)::varchar] as path from documents), h as (select distinct resource_id, list_slice(list_transform(path, lambda s: lower(trim(s))), 1, n) as p from d, range(1, 4) r(n))
    select resource_id, array_to_string(p, '|') as section_key, nullif(array_to_string(p[1:len(p) - 1], '|'), '') as parent_key, len(p)::int as level from h""")
def section_tree(spark, sf_dir):
    one = lambda word, n: F.concat(F.lit(word), (F.col("doc_id") % n).cast("string"))
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("resource_id"), F.array(one("Part ", 4), one(" Chapter ", 3), one("S", 5)).alias("path"))
    return G.section_tree(d)


@add(f"""with {CHUNKS_SQL}, c as (select *, case when idx % 4 = 2 then '' else coalesce(key_concepts[1], '') end as pc from tagged), b as (select *, last_value(nullif(pc, '') ignore nulls) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding) as src from c)
    select src, pc as dst, 0.4::double as confidence, chunk_id from b where pc <> '' and src is not null and src <> pc""")
def sequence_prerequisites(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("primary_concept", F.when(F.col("idx") % 4 == 2, "").otherwise(F.coalesce(F.get("key_concepts", F.lit(0)), F.lit(""))))
    return G.sequence_prerequisites(c)


@add(f"""with {CHUNKS_SQL}, r as (select chunk_id, case idx % 2 when 0 then 'DEFINES' else 'EXPLAINS' end as type, coalesce(key_concepts[1], '') as source, unnest(prerequisites) as target, 0.7::double as confidence from tagged) select chunk_id, type, source, target, max(confidence) as confidence from r where source <> '' and target <> '' and source <> target group by all""")
def pedagogy_relations(spark, sf_dir):
    c = chunks(spark, sf_dir)
    kind = F.when(F.col("idx") % 2 == 0, "defines").otherwise("explains")
    rel = F.transform("prerequisites", lambda p: F.struct(kind.alias("type"), F.upper(F.coalesce(F.get("key_concepts", F.lit(0)), F.lit(""))).alias("source"), p.alias("target"), F.lit(0.7).alias("confidence")))
    return G.pedagogy_relations(c.withColumn("relations", rel))


_KINDS = ["principle", "theorem", "method", "parameter", "law"]


@add(f"""with c as (select p_brand as resource_id, p_name as name, (array[{', '.join(map(_quoted, _KINDS))}])[p_partkey % 5 + 1] as type from part), b as (select *, case when type in ('principle', 'theorem') then 'foundational' when type in ('method', 'parameter') then 'applied' end as bucket from c)
    select resource_id, bucket, array_to_string(list_sort(list(distinct name)), '|') as concepts from b where bucket is not null group by resource_id, bucket""")
def concept_buckets(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    b = G.concept_buckets(table(spark, sf_dir, "part").select(F.col("p_brand").alias("resource_id"), F.col("p_name").alias("name"), kind.alias("type")))
    return b.withColumn("concepts", F.array_join("concepts", "|"))


@add()
def alias_pairs(spark, sf_dir):
    """Names of parts of one order that are alike."""
    names = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_set("p_name").alias("concepts"))
    return G.co_occurrence(names).select("a", "b", alias_like("a", "b").alias("alias"))


def _spelt_names(spark, sf_dir):
    """(name, mentions) of all parts as written, and in a second spelling that depends on the part's number."""
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(n == 0, F.upper(F.replace(name, F.lit(" "), F.lit("-")))).when(n == 1, F.concat(name, F.lit("s"))).when(n == 2, F.concat(F.left(name, F.lit(4)), F.substring(name, F.lit(6), F.length(name)))).otherwise(F.concat(F.lit("the "), name))
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(F.struct(name.alias("name"), F.lit(3).alias("times")), F.struct(other.alias("name"), (F.col("p_size") % 5).alias("times")))).alias("r"))
    return rows.groupBy("r.name").agg(F.sum("r.times").alias("mentions"))


@add()
def alias_groups(spark, sf_dir):
    """Groups of part names that are spelt alike, with the name that stands for each."""
    return S.alias_groups(_spelt_names(spark, sf_dir))


@add()
def alias_rewrite(spark, sf_dir):
    """Edges between the names of a part's two spellings and of parts of one brand, rewritten to canonical names."""
    names = _spelt_names(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_size").groupBy("p_brand").agg(F.min("p_name").alias("src"), F.collect_set("p_name").alias("all"))
    edges = parts.select("src", F.explode("all").alias("dst"), F.lit("RELATED_TO").alias("type"), F.lit(0.5).alias("confidence")).where("src <> dst")
    return S.rewrite_aliases(edges, S.alias_groups(names))


@add(f"with {CHUNKS_SQL} select chunk_id, lead(chunk_id) over (partition by doc_id order by idx) as next_chunk_id from chunks qualify next_chunk_id is not null")
def next_chunk_edges(spark, sf_dir):
    return links(chunks(spark, sf_dir)).where("next_chunk_id is not null").select("chunk_id", "next_chunk_id")
