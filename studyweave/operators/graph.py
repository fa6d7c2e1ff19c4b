"""A concept graph as two tables: nodes(key, ...) and edges(src, dst, type, confidence, ...).

Undirected edges are stored once, with their smaller end first. Merges are aggregations over appended rows, so
a re-run writes the same graph. Walks are joins with a bound on their length; their intermediate tables can be
checkpointed by the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..functions import text as T
from ..sources.staging import staged

#: Concepts of a chunk whose pairs one row makes.
PAIR_ROWS = 500
#: Steps over edges between two tables of labels.
STEPS = 3


def merge_nodes(rows: DataFrame) -> DataFrame:
    """(key, display_name, created_at, last_seen, mentions) from (key, display_name, seen, seq): the first display name stays."""
    return rows.where(F.col("key") != "").groupBy("key").agg(F.min_by("display_name", "seq").alias("display_name"), F.min("seen").alias("created_at"), F.max("seen").alias("last_seen"), F.count("*").alias("mentions"))


def merge_properties(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One node per key; of each property the last value that is not null."""
    return rows.groupBy("key").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields))


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges by (src, dst, type): the last confidence, the first evidence. ``rows`` has evidence and seq."""
    return rows.where("src <> dst").groupBy("src", "dst", "type").agg(F.max_by("confidence", "seq").alias("confidence"), F.min_by("evidence", "seq").alias("evidence"))


def occurrences(mentions: DataFrame) -> DataFrame:
    """(concept, chunk, frequency, salience) from (concept, chunk, times): at least 1 each, salience as share in the chunk."""
    n = mentions.groupBy("concept", "chunk").agg(F.greatest(F.sum("times"), F.lit(1)).alias("frequency"))
    return n.withColumn("salience", F.least(F.lit(1.0), F.col("frequency") / F.sum("frequency").over(W.partitionBy("chunk"))))


def co_occurrence(chunks: DataFrame, weight: float = 1.0) -> DataFrame:
    """(a, b, weight, chunks) of concept pairs of the same chunk, a < b, from (chunk, concepts).

    Each chunk counts once per pair, also if it has several rows; all its distinct concepts meet. A chunk with many
    concepts is dealt over tasks by ``PAIR_ROWS`` of its first ones, so no row makes more than that times its concepts.
    """
    whole = chunks.groupBy("chunk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("concepts")))).alias("c"))
    dealt = whole.where(F.size("c") > 1).withColumn("s", F.explode(F.sequence(F.lit(0), F.floor((F.size("c") - 2) / PAIR_ROWS).cast("int")))).repartition("chunk", "s")
    first = dealt.select("c", F.explode(F.sequence(F.col("s") * PAIR_ROWS + 1, F.least((F.col("s") + 1) * PAIR_ROWS, F.size("c") - 1))).alias("i"))
    pairs = first.select(F.element_at("c", F.col("i")).alias("a"), F.explode(F.slice("c", F.col("i") + 1, F.size("c"))).alias("b"))
    return pairs.groupBy("a", "b").agg((F.count("*") * F.lit(weight)).alias("weight"), F.count("*").alias("chunks"))


def confident(edges: DataFrame) -> DataFrame:
    """Edges at or over their kind's least confidence; unknown kinds become RELATED_TO."""
    table = F.create_map(*(F.lit(x) for kv in rules.RELATION_CONFIDENCE.items() for x in kv))
    known = edges.withColumn("type", F.when(F.col("type").isin(list(rules.RELATION_CONFIDENCE)), F.col("type")).otherwise("RELATED_TO"))
    return known.where(F.col("confidence") >= F.try_element_at(table, F.col("type")))


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their ends as node keys, looked up without regard to case; ends that are no node become one."""
    keys = nodes.groupBy(F.lower("key").alias("_l")).agg(F.min("key").alias("_k"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(keys, F.lower(end) == F.col("_l"), "left").withColumn(end, F.coalesce("_k", end)).drop("_l", "_k")
    ends = out.select(F.col("src").alias("key")).union(out.select("dst")).distinct()
    return nodes.unionByName(ends.join(nodes, "key", "left_anti"), allowMissingColumns=True), out


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An extracted graph merged into a stored one: names looked up without regard to case, ends that are no node
    become one, each key and each (src, dst, type) once; confidences of new edges replace stored ones.

    Nodes: key; edges: src, dst, type, confidence.
    """
    every = nodes.select("key").union(new_nodes.join(nodes.select(F.lower("key").alias("_l")).distinct(), F.lower("key") == F.col("_l"), "left_anti").select("key"))
    every = every.groupBy(F.lower("key")).agg(F.min("key").alias("key")).select("key")
    both = edges.select("src", "dst", "type", "confidence", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("evidence")).unionByName(new_edges.select("src", "dst", "type", "confidence", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("evidence")))
    every, both = with_endpoints(every, both)
    return every, both.where("src <> dst").groupBy("src", "dst", "type").agg(F.max_by("confidence", F.struct("seq", "confidence")).alias("confidence"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): nodes, and edges of each type; what a merge adds or a wipe removes."""
    return nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "n").union(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.col("type").alias("kind"), "n"))


def best_evidence(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relations with the evidence of highest confidence for their (type, target), ties to the smaller chunk."""
    best = evidence.groupBy("type", "target").agg(F.max_by(F.struct("chunk", "confidence"), F.struct("confidence", -F.col("chunk"))).alias("e"))
    return relations.join(best, ["type", "target"], "left").select(*relations.columns, F.col("e.chunk").alias("evidence_chunk"), F.col("e.confidence").alias("evidence_confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("key")).union(edges.select("dst")).groupBy("key").agg(F.count("*").alias("degree"))


def drop_singletons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).select("key"), "key", "left_semi")


def detach(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges without those that touch a key."""
    return reduce(lambda e, end: e.join(keys.select(F.col("key").alias(end)), end, "left_anti"), ("src", "dst"), edges)


def prune(nodes: DataFrame, edges: DataFrame, most_degree: int = 100, least_confidence: float = 0.3, cycle_length: int = 10) -> tuple[DataFrame, DataFrame]:
    """Singletons go first, then hubs with their edges, weak edges (none: 1.0) and each cycle's weakest edge.

    Nodes that only later steps leave alone stay, as the order says.
    """
    nodes = drop_singletons(nodes, edges)
    hubs = degrees(edges).where(F.col("degree") > most_degree)
    nodes, edges = nodes.join(hubs, "key", "left_anti"), detach(edges, hubs)
    edges = edges.where(F.coalesce("confidence", F.lit(1.0)) >= least_confidence)
    return nodes, break_cycles(edges, cycle_length)


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges without those of nodes that nothing leads to or from, again and again until none is left to trim."""
    n = edges.count()
    for _ in range(rounds):
        edges = staged(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "trimmed-edges")
        before, n = n, edges.count()
        if n in (0, before):
            break
    return edges


def _spread(labels: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(node, label): the largest label that leads to a node over any number of edges; unmarked nodes have none."""
    while True:
        now = labels.select("node", "label", F.col("label").alias("was"))
        for _ in range(STEPS):
            led = edges.join(now.select(F.col("node").alias(start), F.col("label").alias("new")), start).groupBy(F.col(end).alias("node")).agg(F.max("new").alias("new"))
            now = now.join(led, "node", "left").select("node", F.greatest("label", "new").alias("label"), "was")
        after = staged(now, "labels")
        labels = after.select("node", "label")
        if after.where(~F.col("was").eqNullSafe(F.col("label"))).isEmpty():
            return labels


def strong_components(edges: DataFrame, trims: int = 30) -> DataFrame:
    """(node, component) of every node on a directed cycle; the component is its greatest node.

    Nodes without edges in or out are trimmed. Then each node takes the greatest node that leads to it as its colour;
    cycles never leave a colour. From each colour's own node, walks against the edges within the colour find its
    component. What is left goes into the next round; every round settles at least one component of each colour.
    """
    e = _trimmed(staged(edges.select("src", "dst").where("src <> dst").distinct(), "edges"), trims)
    found = []
    while not e.isEmpty():
        nodes = staged(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
        colour = _spread(nodes.select("node", F.col("node").alias("label")), e, "src", "dst")
        src, dst = (colour.select(F.col("node").alias(end), F.col("label").alias(f"{end}_colour")) for end in ("src", "dst"))
        same = staged(e.join(src, "src").join(dst, "dst").where("src_colour = dst_colour").select("src", "dst"), "edges-of-one-colour")
        reach = _spread(colour.select("node", F.when(F.col("node") == F.col("label"), F.col("node")).alias("label")), same, "dst", "src").where("label is not null")
        found.append(reach.select("node", F.col("label").alias("component")))
        left = same.join(reach.select(F.col("node").alias("src")), "src", "left_anti").join(reach.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = _trimmed(staged(left.select("src", "dst"), "edges"), trims)
    if not found:
        node = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {node}, component {node}")
    every = reduce(DataFrame.union, found)
    return every.join(every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("node", "component")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, component) of the edges within a strong component: those that lie on some cycle, each once."""
    part = staged(strong_components(edges), "components")
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return e.join(part.select(F.col("node").alias("src"), "component"), "src").join(part.select(F.col("node").alias("dst"), F.col("component").alias("to")), "dst").where(F.col("component") == F.col("to")).select("src", "dst", "component")


def cycles(edges: DataFrame, length: int = 10, most: int | None = None) -> DataFrame:
    """(path) of simple directed cycles of 2 to ``length`` edges, each once, from its smallest node on.

    Only edges within strong components are walked; a path only grows over nodes greater than its start. The edges and
    each length's paths are written to the shared folder, so no plan grows with the length, and the walk ends when no
    path is left, or once ``most`` cycles are known (the shortest ones, smaller nodes first).
    """
    e = staged(cyclic_edges(edges).select("src", "dst"), "walk-edges")
    step = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    paths = e.where("dst > src").select(F.array("src", "dst").alias("path"))
    found, n_found = [], 0
    for n in range(2, length + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        grown = paths.join(step, last == F.col("_from"))
        closed = grown.where(F.col("_to") == first).select("path")
        found.append(closed if most is None else staged(closed, "cycles"))
        n_found += 0 if most is None else found[-1].count()
        if most is not None and n_found >= most:
            break
        if n < length:
            paths = staged(grown.where((F.col("_to") > first) & ~F.array_contains("path", F.col("_to"))).select(F.array_append("path", F.col("_to")).alias("path")), "walks")
            if paths.isEmpty():
                break
    every = reduce(DataFrame.union, found)
    return every if most is None else every.orderBy(F.size("path"), "path").limit(most)


def break_cycles(edges: DataFrame, length: int = 10) -> DataFrame:
    """Edges without the weakest one of each cycle (missing confidence is 1.0, ties to the smaller ends)."""
    n = F.size("path")
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", F.when(i == n, 1).otherwise(i + 1).cast("int")).alias("dst")))
    on = cycles(edges, length).select("path", F.explode(ends).alias("e")).select("path", "e.src", "e.dst")
    weak = on.join(edges.groupBy("src", "dst").agg(F.min(F.coalesce("confidence", F.lit(1.0))).alias("c")), ["src", "dst"]).groupBy("path").agg(F.min(F.struct("c", "src", "dst")).alias("w"))
    return edges.join(weak.select("w.src", "w.dst").distinct(), ["src", "dst"], "left_anti")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(key, hops): nodes at most ``depth`` undirected steps from a seed (1 to 3)."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    both = e.select("src", "dst").union(e.select("dst", "src")).distinct()
    reached = seeds.select("key", F.lit(0).alias("hops"))
    edge = reached
    for d in range(1, min(max(depth, 1), 3) + 1):
        edge = edge.join(both, edge["key"] == both["src"]).select(F.col("dst").alias("key"), F.lit(d).alias("hops")).distinct()
        reached = reached.union(edge)
    return reached.groupBy("key").agg(F.min("hops").alias("hops"))


def subgraph_edges(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(src, dst, type): the edges on walks of at most ``depth`` steps from a seed, so those with an end nearer than that."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    near = subgraph(e, seeds, depth).where(F.col("hops") < min(max(depth, 1), 3)).select("key")
    ends = [e.join(near.withColumnRenamed("key", end), end, "left_semi").select("src", "dst", "type") for end in ("src", "dst")]
    return ends[0].union(ends[1]).distinct()


def prerequisite_closure(edges: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """(target, key, depth): all prerequisites up to ``depth`` steps behind each target, the target itself at 0, each at its greatest depth."""
    back = edges.select(F.col("dst").alias("_at"), F.col("src").alias("_before")).distinct()
    reached = level = targets.select("target", F.col("target").alias("key"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        level = staged(level.join(back, F.col("key") == F.col("_at")).select("target", F.col("_before").alias("key"), F.lit(d).alias("depth")).distinct(), "closure")
        reached = reached.union(level)
    return reached.groupBy("target", "key").agg(F.max("depth").alias("depth"))


def concept_complexity(name: Column) -> Column:
    """0 to 10: words up to 5, technical terms, 2 for mathematical signs."""
    low = F.lower(F.coalesce(name, F.lit("")))
    terms = sum((low.contains(t).cast("int") for t in rules.COMPLEX_TERMS), F.lit(0))
    return F.least(F.least(F.size(T.words(low)), F.lit(5)) + terms + F.when(T.contains_any(name, rules.COMPLEX_SIGNS), 2).otherwise(0), F.lit(10))


def validated(edges: DataFrame, similarity: Column, least: float = 0.30) -> DataFrame:
    """Edges with verdict and confidence: prerequisites too alike (> 0.9) or unrelated are rejected, those from a
    more complex concept halved; APPLIES_TO needs 0.83 of the least similarity."""
    e = edges.withColumn("_s", similarity)
    pre, app = F.col("type") == "PREREQUISITE_OF", F.col("type") == "APPLIES_TO"
    harder = concept_complexity(F.col("src_name")) > concept_complexity(F.col("dst_name")) + 2
    verdict = F.when(pre & (F.col("_s") > 0.9), "concepts_too_similar").when(pre & (F.col("_s") < least), "concepts_unrelated").when(app & (F.col("_s") < least * 0.83), "unrelated_domains").when(pre & harder, "complexity_mismatch").otherwise("valid")
    rejected = F.col("verdict").isin("concepts_too_similar", "concepts_unrelated", "unrelated_domains")
    e = e.withColumn("verdict", verdict)
    return e.withColumn("confidence", F.when(rejected, 0.0).when(F.col("verdict") == "complexity_mismatch", F.col("confidence") * 0.5).otherwise(F.col("confidence"))).drop("_s")


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes whose names contain a text, by kind of match (exact, prefix, word, name, canonical), then by name."""
    q = query.lower()
    name, key = F.lower("display_name"), F.col("key")
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(F.contains(name, F.lit(" " + q)), 2).when(name.contains(q), 3).otherwise(4)
    return nodes.where(name.contains(q) | key.contains(q)).withColumn("match", rank).orderBy("match", "display_name", "key").limit(limit)


def section_tree(paths: DataFrame) -> DataFrame:
    """(resource_id, section_key, parent_key, level) of every section and the sections above it, from (resource_id, path array)."""
    low = F.transform("path", lambda s: F.lower(T.strip(s)))
    heads = paths.where(F.size("path") > 0).select("resource_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice(low, 1, n))).alias("p")).distinct()
    return heads.select("resource_id", F.array_join("p", "|").alias("section_key"), F.nullif(F.array_join(F.slice("p", 1, F.size("p") - 1), "|"), F.lit("")).alias("parent_key"), F.size("p").alias("level"))


def sequence_prerequisites(chunks: DataFrame, confidence: float = 0.4) -> DataFrame:
    """(src, dst, confidence, chunk_id): the last primary concept before a chunk leads to its own, if they differ."""
    order = W.partitionBy("doc_id").orderBy("idx")
    before = F.last(F.nullif("primary_concept", F.lit("")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = chunks.withColumn("src", before).where((F.col("primary_concept") != "") & F.col("src").isNotNull() & (F.lower("src") != F.lower("primary_concept")))
    return rows.select("src", F.col("primary_concept").alias("dst"), F.lit(confidence).alias("confidence"), "chunk_id")


def pedagogy_relations(chunks: DataFrame, items: str = "relations") -> DataFrame:
    """(chunk_id, type, source, target) of extracted relations, both ends canonical, self edges and blanks dropped.

    ``items``: array of structs type, source, target, confidence.
    """
    ends = F.transform(items, lambda r: F.struct(F.upper(r["type"]).alias("type"), T.canonical_name(r["source"]).alias("source"), T.canonical_name(r["target"]).alias("target"), r["confidence"].alias("confidence")))
    # filtered within the array: Spark would move a filter on rows below the names and make each of them again for it
    kept = F.filter(ends, lambda r: (r["source"] != "") & (r["target"] != "") & (r["source"] != r["target"]))
    return chunks.select("chunk_id", F.explode(kept).alias("r")).select("chunk_id", "r.*").groupBy("chunk_id", "type", "source", "target").agg(F.max("confidence").alias("confidence"))


def concept_buckets(concepts: DataFrame) -> DataFrame:
    """(resource_id, bucket, concepts): principles and theorems are foundational, methods and parameters applied."""
    bucket = F.when(F.col("type").isin("principle", "theorem"), "foundational").when(F.col("type").isin("method", "parameter"), "applied")
    return concepts.withColumn("bucket", bucket).where("bucket is not null").groupBy("resource_id", "bucket").agg(F.array_sort(F.collect_set("name")).alias("concepts"))


def _formulas(chunks: DataFrame) -> DataFrame:
    return _identified(chunks.select("doc_id", "chunk_id", "key_concepts", F.explode("formulas").alias("latex")))


def _identified(found: DataFrame) -> DataFrame:
    return found.withColumn("id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "latex"), 256))


def formula_nodes(chunks: DataFrame) -> DataFrame:
    """(id, latex, type, variables) of chunks with ``formulas``; a resource's equal formulas are one node."""
    return _formulas(chunks).select("id", "latex").distinct().select("id", "latex", T.formula_type(F.col("latex")).alias("type"), T.variables(F.col("latex")).alias("variables"))


def formula_graph(chunks: DataFrame, fan_out: int = 3) -> DataFrame:
    """(type, src, dst): chunks to formulas and figures, these to the chunk's first concepts, formulas to variables.

    ``chunks``: doc_id, chunk_id, key_concepts, formulas and figures (arrays).
    """
    marked_as = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))
    marks = F.concat(marked_as("formula", "formulas"), marked_as("figure", "figures"))
    # texts are searched once; all edges come from what was found
    marked = staged(chunks.select("doc_id", "chunk_id", F.slice("key_concepts", 1, fan_out).alias("key_concepts"), F.explode(marks).alias("m")).select("doc_id", "chunk_id", "key_concepts", "m.kind", "m.label"), "formulas-and-figures")
    found = _identified(marked.where("kind = 'formula'").withColumnRenamed("label", "latex"))
    figures = marked.where("kind = 'figure'").withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), "label"))
    edge = lambda rows, kind, src, dst: rows.select(F.lit(kind).alias("type"), F.col(src).alias("src"), dst.alias("dst"))
    concepts = F.explode("key_concepts")
    variable = found.select("id", "latex").distinct().select("id", F.explode(T.variables(F.col("latex"))).alias("symbol"))
    parts = [
        edge(found, "HAS_FORMULA", "chunk_id", F.col("id")), edge(found, "ABOUT", "id", concepts), edge(variable, "HAS_VARIABLE", "id", F.left(F.sha2(F.concat_ws(":", "id", "symbol"), 256), F.lit(16))),
        edge(figures, "HAS_FIGURE", "chunk_id", F.col("id")), edge(figures, "ILLUSTRATES", "id", concepts),
    ]
    return reduce(DataFrame.union, parts).distinct()
