"""Relations between the chunks of a resource.

Windows are partitioned by resource and ordered by idx, so a resource's chunks meet in one task. A resource is
one uploaded file, whose size is bounded (uploads over 100 MB are refused).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.staging import staged
from .mentions import earlier_names

def in_order():
    """Window over a resource's chunks in their order."""
    return W.partitionBy("doc_id").orderBy("idx")


def links(chunks: DataFrame) -> DataFrame:
    """previous_chunk_id, next_chunk_id and parent_section_id: a blank title takes over the section before."""
    return chunks.withColumns({
        "previous_chunk_id": F.lag("chunk_id").over(in_order()),
        "next_chunk_id": F.lead("chunk_id").over(in_order()),
        "parent_section_id": F.last(F.nullif("section_title", F.lit("")), ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, 0)),
    })


def context_windows(chunks: DataFrame, chars: int = 500) -> DataFrame:
    """Texts around each chunk and the chapter's theme: the first level-1 title from five before to four after."""
    before, after = F.lag("full_text").over(in_order()), F.lead("full_text").over(in_order())
    near = F.collect_list(F.when((F.col("section_level") == 1) & (F.col("section_title") != ""), F.col("section_title"))).over(in_order().rowsBetween(-5, 4))
    text = lambda c: F.coalesce(T.strip(c), F.lit(""))
    return chunks.withColumns({
        "previous_chunk_summary": text(F.left(before, F.lit(200))), "surrounding_text_before": text(F.right(before, F.lit(chars))),
        "next_chunk_preview": text(F.left(after, F.lit(200))), "surrounding_text_after": text(F.left(after, F.lit(chars))),
        "section_context": F.when(F.col("section_title") != "", F.concat(F.lit("Part of section: "), "section_title")).otherwise(""),
        "chapter_theme": F.coalesce(F.get(near, F.lit(0)), F.lit("")),
        "position_in_section": F.row_number().over(in_order()), "total_chunks": F.count("*").over(W.partitionBy("doc_id")),
    })


def positions(chunks: DataFrame) -> DataFrame:
    """Place and number of chunks in the section (by title) and in the resource."""
    section = W.partitionBy("doc_id", F.coalesce("section_title", F.lit("unknown")))
    return chunks.withColumns({
        "position_in_section": F.row_number().over(section.orderBy("idx")), "total_in_section": F.count("*").over(section),
        "position_in_chapter": F.row_number().over(in_order()), "total_in_chapter": F.count("*").over(W.partitionBy("doc_id")),
    })


def link_all(chunks: DataFrame) -> DataFrame:
    """Chunks with ids by place and page, and all that windows over a resource add: neighbours, context, places."""
    named = chunks.withColumn("chunk_id", F.concat_ws("_", F.lit("chunk"), F.col("idx").cast("string"), F.coalesce("page_number", F.lit(0)).cast("string")))
    return named.transform(links).transform(context_windows).transform(positions)


def prerequisite_links(chunks: DataFrame, concepts: list[str]) -> DataFrame:
    """(doc_id, idx, term, prereq_idx): for each prerequisite the last earlier chunk that has it as a concept.

    One window over concept and prerequisite rows of a (resource, term) finds it, so there is no range join.
    """
    term = lambda c: F.explode(F.array_distinct(F.transform(c, F.lower))).alias("term")
    has = chunks.select("doc_id", "idx", term(F.concat(*concepts)), F.lit(True).alias("has"))
    wants = chunks.select("doc_id", "idx", term(F.col("prerequisites")), F.lit(False).alias("has"))
    rows = has.unionByName(wants)
    earlier = W.partitionBy("doc_id", "term").orderBy("idx").rangeBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("prereq_idx", F.max(F.when(F.col("has"), F.col("idx"))).over(earlier))
    return found.where(~F.col("has") & F.col("prereq_idx").isNotNull()).select("doc_id", "idx", "term", "prereq_idx")


def _depths(edges: pa.Table) -> pa.Table:
    """Depth of each chunk of a resource that has prerequisites; in order of idx, those behind it are settled."""
    depth: dict[int, int] = {}
    ordered = edges.sort_by("idx")
    for idx, back in zip(ordered.column("idx").to_pylist(), ordered.column("prereq_idx").to_pylist()):
        depth[idx] = max(depth.get(idx, 0), 1 + depth.get(back, 0))
    doc = [edges.column("doc_id")[0].as_py()] * len(depth)
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "idx": pa.array(list(depth), pa.int32()), "depth": pa.array(list(depth.values()), pa.int32())})


def chain_depth(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, idx, depth): length of the longest chain of prerequisites behind each chunk.

    Edges point backwards, so one pass over a resource's edges settles every depth.
    """
    e = edges.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("idx").cast("int").alias("idx"), F.col("prereq_idx").cast("int").alias("prereq_idx")).distinct()
    deep = e.groupBy("doc_id").applyInArrow(_depths, "doc_id long, idx int, depth int")
    return chunks.select("doc_id", "idx").distinct().join(deep, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("depth", F.lit(0)).alias("depth"))


def continuity(chunks: DataFrame, coherence: Column) -> DataFrame:
    """How each chunk goes on from the one before: new topic, kind of transition, shared concepts, coherence.

    ``coherence``: column of the similarity to the chunk before, 0 without one.
    """
    first = F.lag("chunk_id").over(in_order()).isNull()
    title, before = F.col("section_title"), F.lag("section_title").over(in_order())
    new_section = ~first & (title != before) & (title != "")
    shift = ~first & ~F.col("topic").eqNullSafe(F.lag("topic").over(in_order()))
    rows = chunks.withColumns({"coherence": F.round(F.when(first, 0.0).otherwise(coherence), 3), "_new": new_section, "_shift": shift, "_first": first, "concept_overlap": F.when(first, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_intersect("key_concepts", F.lag("key_concepts").over(in_order()))))})
    kind = F.when(F.col("_first"), "continuation").when((F.col("content_type") == "example") & (F.col("coherence") > 0.5), "example").when(F.col("content_type").isin("derivation", "summary"), F.col("content_type"))
    kind = kind.when(F.col("_new"), "new_section").when(F.col("_shift"), "topic_shift").otherwise("continuation")
    return rows.withColumns({"starts_new_topic": F.col("_new") | F.col("_shift"), "transition_type": kind, "concludes_topic": ~F.col("_first") & (F.col("content_type") == "summary")}).drop("_new", "_shift", "_first")


def topic_transitions(chunks: DataFrame) -> DataFrame:
    """is_topic_start, confidence and is_topic_end (the next chunk starts a topic) from titles, types and coherence."""
    title, before = F.col("section_title"), F.lag("section_title").over(in_order())
    first = F.lag("chunk_id").over(in_order()).isNull()
    section = ~first & (title != "") & (title != before)
    after_summary = ~first & (F.lag("content_type").over(in_order()) == "summary") & F.col("content_type").isin("concept_intro", "definition")
    rows = chunks.withColumns({"_section": F.coalesce(section, F.lit(False)), "_summary": F.coalesce(after_summary, F.lit(False)), "_low": ~first & (F.col("coherence") < 0.3)})
    start = F.col("_section") | F.col("_summary") | F.col("_low")
    rows = rows.withColumns({
        "is_topic_start": start, "transition_confidence": F.when(F.col("_summary"), 0.75).when(F.col("_section"), 0.95).when(F.col("_low"), 0.6).otherwise(0.0),
        "new_topic_name": F.when(F.col("_section"), F.col("section_title")).when(F.col("_low") & ~F.col("_summary"), F.coalesce(F.get("topic", F.lit(0)), F.lit(""))).otherwise(""),
    }).drop("_section", "_summary", "_low")
    return rows.withColumn("is_topic_end", F.coalesce(F.lead("is_topic_start").over(in_order()), F.lit(False)))


def look_ahead(chunks: DataFrame, steps: int = 5, most: int = 3) -> DataFrame:
    """(doc_id, idx, prepares_for): topics of the next chunks a prerequisite of which occurs in a key concept here."""
    ahead = F.collect_list(F.struct("prerequisites", "topic")).over(in_order().rowsBetween(1, steps))
    rows = chunks.withColumn("_ahead", ahead)
    fits = lambda f: F.exists(f["prerequisites"], lambda p: F.exists(F.col("key_concepts"), lambda k: F.contains(F.lower(k), F.lower(p))))
    topics = F.flatten(F.transform(F.filter("_ahead", fits), lambda f: f["topic"]))
    return rows.select("doc_id", "idx", F.slice(F.array_sort(F.array_distinct(topics)), 1, most).alias("prepares_for"))


def spans_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, offset, start, title) of the spans [start, stop) that hold a point, nested and overlapping ones included.

    A span goes into the one or two bins of the smallest power of two that is no less than its length; a point asks one
    bin for each power that occurs, so both meet by equality of (resource, power, bin). Points: doc_id, offset.
    """
    length = F.col("stop").cast("long") - F.col("start").cast("long")
    rows = spans.where(F.col("start").isNotNull() & (length > 0)).select("doc_id", "start", "stop", "title", F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int").alias("power"))
    powers = sorted(r.power for r in rows.select("power").distinct().collect())  # 63 at most
    binned = rows.withColumn("bin", F.explode(F.sequence(F.expr("shiftright(cast(start as bigint), power)"), F.expr("shiftright(cast(stop as bigint) - 1, power)"))))
    asked = points.where("offset is not null").select("doc_id", "offset", F.explode(F.array(*map(F.lit, powers)).cast("array<int>")).alias("power")).withColumn("bin", F.expr("shiftright(cast(offset as bigint), power)"))
    return asked.join(binned, ["doc_id", "power", "bin"]).where("start <= offset and offset < stop").select("doc_id", "offset", "start", "title")


def assign_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the section that has their number, else the first whose [start, stop) holds their offset."""
    s = sections.select("doc_id", "number", "start", "stop", "title")
    by_number = s.groupBy("doc_id", "number").agg(F.min_by("title", "start").alias("by_number"))
    rows = chunks.join(by_number, ["doc_id", "number"], "left")
    points = rows.where("by_number is null").select("doc_id", "offset").distinct()
    by_offset = spans_at(points, s).groupBy("doc_id", "offset").agg(F.min_by("title", "start").alias("by_offset"))
    found = rows.join(by_offset, ["doc_id", "offset"], "left").withColumn("section", F.coalesce("by_number", "by_offset"))
    return found.select(*chunks.columns, "section")


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(query_id, chunk_id, distance) of chunks at most ``window`` places from a hit on the same page.

    The hit's neighbours are exploded into places, so the join is on equality of (resource, page, place).
    """
    place = F.row_number().over(W.partitionBy("doc_id", "page_number").orderBy("source_offset", "chunk_id"))
    placed = chunks.select("doc_id", "page_number", "chunk_id", place.alias("place"))
    at = hits.select("query_id", "chunk_id").join(placed, "chunk_id").select("query_id", "doc_id", "page_number", F.explode(F.sequence(F.col("place") - window, F.col("place") + window)).alias("place"), F.col("place").alias("from"))
    near = at.join(placed, ["doc_id", "page_number", "place"]).groupBy("query_id", "chunk_id").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("distance"))
    return near


def consecutive_sections(chunks: DataFrame, budget: int = 6000) -> DataFrame:
    """Runs of neighbouring chunks with one section key, their texts joined by blank lines while they fit.

    A text that no longer fits ends the joining for its run; the budget counts two characters per joint.
    """
    key = F.col("section_key")
    rows = chunks.withColumn("_new", F.coalesce((key != F.lag(key).over(in_order())), F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(in_order()))
    runs = rows.groupBy("doc_id", "run").agg(F.min("section_key").alias("section_key"), F.array_sort(F.collect_list(F.struct("idx", "full_text"))).alias("cs"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(acc, c):
        over = acc["over"] | ((acc["n"] > 0) & (acc["used"] + F.length(c["full_text"]) + 2 > budget))
        return F.when(over, F.struct(acc["text"], acc["used"], acc["n"], F.lit(True).alias("over"))).otherwise(
            F.struct(F.when(acc["n"] == 0, c["full_text"]).otherwise(F.concat(acc["text"], F.lit("\n\n"), c["full_text"])).alias("text"), (acc["used"] + F.length(c["full_text"])).alias("used"), (acc["n"] + 1).alias("n"), F.lit(False).alias("over"))
        )

    folded = runs.select("doc_id", "run", "section_key", F.size("cs").alias("chunks"), F.aggregate("cs", start, step).alias("f"))
    return folded.select("doc_id", "run", "section_key", "chunks", F.col("f.n").alias("joined"), F.left("f.text", F.lit(budget)).alias("text"))


def diff(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(action, id, page_number, source_offset) of a re-ingested resource against what is stored.

    Of repeated keys the last incoming and the first existing row count; null page and offset are 0, a null text
    equals an empty one.
    """
    key = ["resource_id", "page_number", "source_offset"]
    norm = lambda df: df.withColumns({"page_number": F.coalesce("page_number", F.lit(0)), "source_offset": F.coalesce("source_offset", F.lit(0)), "full_text": F.coalesce("full_text", F.lit(""))})
    new = norm(incoming).groupBy(*key).agg(F.max_by("full_text", "pos").alias("new_text"))
    old = norm(existing).groupBy(*key).agg(F.min_by(F.struct("id", "full_text"), "pos").alias("old"))
    both = new.join(old, key, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new_text").isNull(), "delete").when(F.col("new_text") != F.col("old.full_text"), "update").otherwise("unchanged")
    return both.select(action.alias("action"), F.col("old.id").alias("id"), *key)


def upsert_embeddings(chunks: DataFrame, target: str, embed) -> DataFrame:
    """Chunks with a vector of version ``target``: only those without one or of another version are embedded."""
    stale = F.col("embedding").isNull() | ~F.col("embedding_version").eqNullSafe(F.lit(target))
    return chunks.withColumns({"embedding": F.when(stale, embed(F.col("full_text"))).otherwise(F.col("embedding")), "embedding_version": F.lit(target), "embedded": stale})


def implicit_prerequisites(chunks: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, idx, prerequisites): a chunk's own and the key concepts of earlier chunks that its text mentions,
    in order of first appearance, at most ``most``.

    All concepts of a resource are looked for in one pass over each text.
    """
    own = F.array_distinct(F.coalesce("prerequisites", F.array().cast("array<string>")))
    # chunks may be costly to make and are read four times
    rows = staged(chunks.select("doc_id", "idx", own.alias("own"), "key_concepts", "full_text"), "chunks")
    each = rows.select("doc_id", "idx", F.posexplode("key_concepts").alias("place", "name"))
    first = each.groupBy("doc_id", "name").agg(F.min(F.struct("idx", "place")).alias("first")).select("doc_id", "name", "first.idx", "first.place")
    joined = rows.select("doc_id", "idx", "own").join(earlier_names(rows, first, most), ["doc_id", "idx"], "left")
    return joined.select("doc_id", "idx", F.slice(F.concat("own", F.coalesce("named", F.array().cast("array<string>"))), 1, most).alias("prerequisites"))
