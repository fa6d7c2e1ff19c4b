"""Splitting texts into chunks: token budgets, similarity cuts and formulas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..sources.staging import staged

#: Units and spans of fewer characters make no chunk.
LEAST_CHARS = 20


@dataclass(frozen=True)
class ChunkPlan:
    """What chunking does beyond cutting: limits by content type, whole formulas, tags, formula metadata."""

    content_aware: bool = True
    preserve_formulas: bool = True
    tags: bool = False
    formulas: bool = False


def packed_spans(sentences: Column, max_tokens: Column | int) -> Column:
    """Array of structs (begin, chunk): sentences joined while they stay within ``max_tokens``; a longer one stands alone.
    ``begin`` is the sum of the lengths of the chunks before.

    The fold only keeps where chunks start; texts are joined once. ``sentences`` should be a column, for it is read
    for every chunk.
    """
    most = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"))
    # chars: of the chunks up to here, the open one with a blank at its end
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("at"), F.lit(0).alias("chars"), F.array(first).alias("starts"))

    def step(acc, s):
        full = (acc["at"] > F.element_at(acc["starts"], -1)["at"]) & (acc["tokens"] + s["n"] > most)
        return F.struct(
            F.when(full, s["n"]).otherwise(acc["tokens"] + s["n"]).alias("tokens"), (acc["at"] + 1).alias("at"), (acc["chars"] + s["size"] + F.when(full, 0).otherwise(1)).alias("chars"),
            F.when(full, F.array_append(acc["starts"], F.struct(acc["at"].alias("at"), (acc["chars"] - 1).alias("begin")))).otherwise(acc["starts"]).alias("starts"),
        )

    measured = F.transform(sentences, lambda s: F.struct(F.size(T.words(s)).alias("n"), F.length(s).alias("size")))
    starts = F.aggregate(measured, start, step, lambda acc: acc["starts"])
    # each start with the next one
    spans = F.zip_with(starts, F.transform(F.slice(starts, 2, F.size(sentences)), lambda s: s["at"]), lambda a, b: F.struct(a["at"].alias("a"), F.coalesce(b, F.size(sentences)).alias("b"), a["begin"].alias("begin")))
    chunk = lambda s: F.array_join(F.slice(sentences, s["a"] + 1, s["b"] - s["a"]), " ")
    return F.when(F.size(sentences) > 0, F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), chunk(s).alias("chunk")))).otherwise(F.array().cast("array<struct<begin:int,chunk:string>>"))


def pack_sentences(sentences: Column, max_tokens: Column | int) -> Column:
    """The chunk texts of :func:`packed_spans`."""
    return F.transform(packed_spans(sentences, max_tokens), lambda s: s["chunk"])


def split_documents(docs: DataFrame, max_tokens: int = 500) -> DataFrame:
    """(doc_id, idx, chunk): packed sentences of every text; null and blank texts give no row."""
    cut = docs.select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("ss"))
    return cut.select("doc_id", F.posexplode(pack_sentences(F.col("ss"), max_tokens)).alias("idx", "chunk"))


def semantic_spans(counts: list[int], similarity: list[float], threshold: float, least: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of sentences: cut at ``most`` tokens, or from ``least`` on where neighbours differ;
    the next chunk takes the last ``overlap`` sentences again."""
    out, start = [], 0
    while start < len(counts):
        tokens, end = 0, None
        first_new = out[-1][1] if out else 0  # sentences before it are repeated and can't end a chunk again
        for i in range(start, len(counts)):
            tokens += counts[i]
            if i >= first_new and (tokens >= most or (i < len(similarity) and similarity[i] < threshold and tokens >= least)):
                end = i + 1
                break
        if end is None:
            out.append((start, len(counts)))
            break
        out.append((start, end))
        start = end - overlap if end >= overlap else end
    return out


#: Sentences of a document that one task looks at together.
BLOCK = 512


def block_steps(counts: list[int], cuts: list[bool], before: list[int], least: int, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block of sentences does to a chunk that reaches it: (tokens of the chunk that leaves it, cuts within it)
    for every number of tokens that the chunk may have when it comes, from 0 to the larger bound (more is as good).

    ``cuts``: whether a sentence differs from the next one; ``before``: token counts of the sentences before the
    block, the last ``overlap`` of them at least, or all.
    """
    cap = max(least, most)
    tokens, made, seen = np.arange(cap + 1), np.zeros(cap + 1, np.int64), list(before)
    for n, differs in zip(counts, cuts):
        seen.append(n)
        tokens = tokens + n
        full = tokens >= (min(least, most) if differs else most)
        again = sum(seen[len(seen) - overlap :]) if len(seen) >= overlap else 0
        tokens, made = np.minimum(np.where(full, again, tokens), cap), made + full
    return tokens, made


def semantic_chunks(sentences: DataFrame, threshold: float = 0.65, least: int = 60, most: int = 240, overlap: int = 1, block: int = BLOCK) -> DataFrame:
    """(doc_id, idx, source_offset, full_text) from (doc_id, pos, sentence, embedding), the spans of :func:`semantic_spans`.

    A document's sentences are dealt over tasks in blocks. Most documents are one block, which is cut at once. For
    others, a chunk that reaches a block is known by its tokens so far, of which at most ``most`` matter, so that a
    block is a table of what leaves it for each of these numbers. Only the tables of a document's blocks meet in one
    task, where they are followed from the first on; then each block makes its cuts, and chunks that reach over a
    border are put together. Null embeddings count as different neighbours.
    """
    from pyspark.sql import Window as W

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")  # joins keep a null id's sentences
    rows = sentences.select(doc, "pos", "sentence", F.struct("embedding", T.length_of(F.col("embedding")).alias("length")).alias("v"), F.floor(F.col("pos") / block).cast("int").alias("block"), T.token_count(F.col("sentence")).cast("int").alias("n"))
    near = lambda u, v: T.cosine(u["embedding"], v["embedding"], u["length"], v["length"])
    place = W.partitionBy("doc_id", "block").orderBy("pos")
    inner = F.sum(F.length("sentence") + 1).over(place.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select("doc_id", "block", "sentence", "n", "v", F.lead("v").over(place).alias("after"), (F.row_number().over(place) - 1).alias("row"), F.coalesce(inner, F.lit(0)).alias("at"), F.lead(F.lit(1), max(1, overlap)).over(place).isNull().alias("tail"))
    # a block's first and last sentences keep their vectors: what its neighbours need to know of it
    edge = F.col("tail") | (F.col("row") == 0)
    rows = staged(rows.select("doc_id", "block", "row", "at", "sentence", "n", (near(F.col("v"), F.col("after")) < threshold).alias("differs"), F.col("after").isNull().alias("closes"), edge.alias("edge"), F.when(edge, F.col("v")).alias("v")), "sentences")
    edges = rows.where("edge").groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("row", "n", "at", "sentence", "v"))).alias("e"))
    row = W.partitionBy("doc_id").orderBy("block")
    first, last, size = F.get("e", F.lit(0)), F.element_at("e", -1), F.size("e")
    begin = F.coalesce(F.sum(last["at"] + F.coalesce(F.length(last["sentence"]) + 1, F.lit(0))).over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select("doc_id", "block", "e", begin.alias("begin"), F.lead(first["v"]).over(row).alias("next"), F.lead(F.lit(1)).over(row).isNull().alias("final"), F.count("*").over(W.partitionBy("doc_id")).alias("blocks"))
    # most documents are one block, of which nothing else has to be known
    edges = edges.where("blocks > 1")
    tail = F.transform(F.slice("e", F.greatest(F.lit(1), size - overlap + 1), overlap), lambda x: F.struct(x["n"].alias("n"), (x["at"] + F.col("begin")).alias("at"), x["sentence"].alias("sentence")))
    earlier = F.flatten(F.collect_list("tail").over(row.rowsBetween(-max(1, overlap), -1)))
    edges = edges.withColumn("tail", tail).withColumn("earlier", earlier)
    before = F.slice("earlier", F.greatest(F.lit(1), F.size("earlier") - overlap + 1), overlap)
    edges = staged(edges.select("doc_id", "block", "begin", "final", before.alias("before"), (~F.col("final") & (near(last["v"], F.col("next")) < threshold)).alias("turns")), "block-edges")
    narrow = rows.select("doc_id", "block", "row", "n", "differs", "closes").join(edges.where("not final").select("doc_id", "block", "turns", F.transform("before", lambda x: x["n"]).alias("before")), ["doc_id", "block"])
    narrow = narrow.select("doc_id", "block", "row", "n", F.when(F.col("closes"), F.col("turns")).otherwise(F.col("differs")).alias("differs"), "before")

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        tokens, made = block_steps(group["n"].tolist(), group["differs"].tolist(), list(group["before"].iloc[0]), least, most, overlap)
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "block": group["block"].iloc[:1], "tokens": [tokens], "made": [made]})

    def follow(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        t, k, entries = 0, 0, []
        for block, tokens, made in zip(blocks["block"], blocks["tokens"], blocks["made"]):
            entries.append((block, t, k))
            if tokens is not None:  # the last block has no table, for nothing follows it
                t, k = int(tokens[t]), k + int(made[t])
        return pd.DataFrame({"doc_id": blocks["doc_id"].iloc[0], "block": [e[0] for e in entries], "t": [e[1] for e in entries], "k": [e[2] for e in entries]})

    tables = narrow.groupBy("doc_id", "block").applyInPandas(steps, "doc_id string, block int, tokens array<int>, made array<int>")
    ends = edges.where("final").select("doc_id", "block", F.lit(None).cast("array<int>").alias("tokens"), F.lit(None).cast("array<int>").alias("made"))
    entries = tables.unionByName(ends).groupBy("doc_id").applyInPandas(follow, "doc_id string, block int, t int, k int")

    # a block of several is headed by a row that tells how it is entered
    header = edges.join(entries, ["doc_id", "block"]).select("doc_id", "block", F.lit(-1).alias("row"), F.struct("t", "k", "begin", "before", "turns").alias("enters"))
    both = rows.select("doc_id", "block", "row", "at", "sentence", "n", F.when(~F.col("closes"), F.col("differs")).alias("differs")).unionByName(header, allowMissingColumns=True)
    pieces = both.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "row").mapInArrow(_pieces(least, most, overlap), _PIECE)
    pieces = staged(pieces, "pieces")
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    met = pieces.where("open").groupBy("doc_id", "idx").agg(F.min("at").alias("at"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    out = pieces.where("not open").select("doc_id", "idx", "at", "text").unionByName(met)
    return out.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), "idx", F.col("at").cast("int").alias("source_offset"), F.col("text").alias("full_text"))


_PIECE = "doc_id string, idx int, at long, text string, open boolean"


def _pieces(least: int, most: int, overlap: int):
    """Chunks, or parts of chunks (open) that reach over a block's border, from sentences sorted by (doc_id, block, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, out = None, []
        t = k = begin = 0
        seen, parts = [], []  # the last sentences up to here, and those of the open chunk
        several = opens = turns = False

        def close(is_open: bool) -> None:
            if parts:
                out.append((here[0], k, parts[0][1], " ".join(s for _, _, s in parts if s is not None), is_open))

        def taken() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds)], [x.split()[0] for x in _PIECE.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for doc, block, row, at, sentence, n, differs, enters in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "block", "row", "at", "sentence", "n", "differs", "enters"))):
                if (doc, block) != here:
                    close(several)
                    here, t, k, begin, seen, parts, several, opens, turns = (doc, block), 0, 0, 0, [], [], False, False, False
                if row < 0:
                    t, k, begin, turns, several, opens = enters["t"], enters["k"], enters["begin"], enters["turns"], True, True
                    seen = [(x["n"], x["at"], x["sentence"]) for x in enters["before"]]
                    continue
                parts.append((n, at + begin, sentence))
                if overlap:
                    seen.append(parts[-1])
                    del seen[:-overlap]
                t += n
                if t >= most or ((turns if differs is None else differs) and t >= least):
                    close(opens)
                    parts = seen[:] if overlap and len(seen) >= overlap else []
                    t, k, opens = sum(x[0] for x in parts), k + 1, False
            yield taken()
        close(several)
        if out:
            yield taken()

    return run


def size_limits(kind: Column) -> Column:
    """Struct of least and most tokens by content type."""
    table = F.create_map(*(F.lit(k) if j == 0 else F.struct(F.lit(v[0]).alias("least"), F.lit(v[1]).alias("most")) for k, v in rules.SIZE_LIMITS.items() for j in (0, 1)))
    return F.coalesce(F.try_element_at(table, kind), F.struct(F.lit(rules.SIZE_DEFAULT[0]).alias("least"), F.lit(rules.SIZE_DEFAULT[1]).alias("most")))


_FORMULAS = [re.compile(p) for p in rules.FORMULA_PATTERNS]


def formula_spans(text: str) -> list[tuple[int, int]]:
    """Formulas in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for p in _FORMULAS if all(s in text for s in rules.SIGNS[p.pattern]) for m in p.finditer(text)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SENTENCE_END = re.compile(r"[.!?]\s+")


def _around(text: str, a: int, b: int, room: int = 200) -> tuple[int, int]:
    """A formula's surroundings: up to ``room`` characters each side, trimmed to the first sentence end in them."""
    low, high = max(0, a - room), min(len(text), b + room)
    before, after = _SENTENCE_END.search(text, low, a), _SENTENCE_END.search(text, b, high)
    return before.end() if before else low, after.end() if after else high


def _formula_chunks(keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, most, *more in zip(batch["text"], batch["most"], *(batch[c] for c in keep)):
                found, end = formula_spans(text), 0
                for k, (a, b) in enumerate(found):
                    low, end = _around(text, a, b)
                    piece = text[low:end]
                    if len(piece.split()) > most:
                        piece = text[max(0, a - 100) : b + 100]
                    rows.append((*more, k, low, end, True, piece.strip()))
                if found and text[end:].strip():
                    rows.append((*more, len(found), end, len(text), False, text[end:].strip()))
            yield pd.DataFrame(rows, columns=[*keep, "idx", "begin", "stop", "has_formula", "chunk"])

    return run


def _has_formula() -> Column:
    test = F.lit(False)
    for p in rules.FORMULA_PATTERNS:
        found = F.col("text").rlike("(?U)" + p)
        for s in rules.SIGNS[p]:  # looked for before the pattern
            found = F.col("text").contains(s) & found
        test = test | found
    return test


def _split(texts: DataFrame, formulas: bool = True) -> DataFrame:
    """All but text, most and whole of ``texts``, with idx, begin, stop, has_formula and chunk: every formula whole with
    its surroundings, and the rest after the last; texts without formulas are packed by sentences, begin and stop being
    sums of chunk lengths. Those that are ``whole`` (a column) are one chunk and hold no formula that counts."""
    keep = [c for c in texts.columns if c not in ("text", "most", "whole")]
    test = _has_formula() if formulas else F.lit(False)
    sentences = F.when(F.col("whole"), F.array().cast("array<string>")).otherwise(T.sentences(F.col("text")))
    alone = F.array(F.struct(F.lit(0).alias("begin"), F.col("text").alias("chunk")))
    plain = texts.where(~test).select(*keep, "text", "most", "whole", sentences.alias("ss"))
    plain = plain.select(*keep, F.posexplode(F.when(F.col("whole"), alone).otherwise(packed_spans(F.col("ss"), F.col("most")))).alias("idx", "c"))
    begin, chunk = F.col("c.begin"), F.col("c.chunk")
    packed = plain.select(*keep, "idx", begin.alias("begin"), (begin + F.length(chunk)).alias("stop"), F.lit(False).alias("has_formula"), chunk.alias("chunk"))
    if not formulas:
        return packed
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    ddl = ", ".join(f"{c} {types[c]}" for c in keep)
    return texts.where(test).select(*keep, "text", "most").mapInPandas(_formula_chunks(keep), f"{ddl}, idx int, begin int, stop int, has_formula boolean, chunk string").union(packed)


def formula_aware_split(docs: DataFrame, max_tokens: int = 500) -> DataFrame:
    """(doc_id, idx, begin, stop, has_formula, chunk) of every text; see :func:`_split`."""
    return _split(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(max_tokens).alias("most"), F.lit(False).alias("whole")))


def unit_chunks(units: DataFrame, plan: ChunkPlan = ChunkPlan()) -> DataFrame:
    """(unit_id, idx, source_offset, token_count, has_equation, content_type, text_snippet, full_text) of a page's units.

    ``units``: unit_id, page (its text), start, stop, kind. Spans that are empty or begin before the page and units of
    fewer than LEAST_CHARS characters give none. A unit within its kind's most tokens stays whole, a longer one is
    packed by sentences, one with formulas (if they are preserved) is cut around them. Offsets are those of the page.
    A plan may add tags (role, difficulty) and formulas (their bodies).
    """
    limits = size_limits(F.col("kind") if plan.content_aware else F.lit("unknown"))["most"]
    text = T.strip(F.substring("page", F.col("start") + 1, F.col("stop") - F.col("start")))
    rows = units.where("stop > start and start >= 0 and unit_id is not null").select("unit_id", "start", "kind", F.explode(F.array(text)).alias("text"), limits.alias("most")).where(F.length("text") >= LEAST_CHARS)
    # a text is a generated row of its own, or Spark would cut it from its page anew for each filter below;
    # start and kind go along with the text: no join brings them back
    both = _split(rows.withColumn("whole", F.size(T.words(F.col("text"))) <= F.col("most")), plan.preserve_formulas)
    out = both.select(
        "unit_id", "idx", (F.col("start") + F.col("begin")).alias("source_offset"), F.size(T.words(F.col("chunk"))).alias("token_count"), F.col("has_formula").alias("has_equation"), F.coalesce("kind", F.lit("unknown")).alias("content_type"),
        F.left("chunk", F.lit(300)).alias("text_snippet"), F.col("chunk").alias("full_text"),
    )
    return enriched(out, plan)


def enriched(chunks: DataFrame, plan: ChunkPlan) -> DataFrame:
    """Chunks with what the plan adds: pedagogy role and content type by the text, formula bodies."""
    if plan.tags:
        chunks = chunks.withColumns({"pedagogy_role": T.pedagogy_role(F.col("full_text")), "content_type": T.content_type(F.col("full_text"))})
    return chunks.withColumn("formulas", T.latex_formulas(F.col("full_text"))) if plan.formulas else chunks


def structural_chunks(spans: DataFrame) -> DataFrame:
    """(span_id, source_offset, token_count, pedagogy_role, text_snippet, full_text) of spans clamped to their page.

    ``spans``: span_id, page, start, stop, section_title. Spans that end before they begin go, and texts of fewer than
    LEAST_CHARS characters.
    """
    n = F.length("page")
    low = F.greatest(F.lit(0), F.least(F.col("start"), n - 1))
    rows = spans.where((F.col("stop") > 0) & (F.col("stop") > F.col("start")) & (T.strip(F.col("page")) != ""))
    rows = rows.withColumn("low", low).withColumn("high", F.greatest(F.col("low") + 1, F.least(F.col("stop"), n)))
    rows = rows.withColumn("full_text", T.strip(F.substring("page", F.col("low") + 1, F.col("high") - F.col("low")))).where(F.length("full_text") >= LEAST_CHARS)
    return rows.select("span_id", F.col("low").alias("source_offset"), F.size(T.words(F.col("full_text"))).alias("token_count"), T.pedagogy_role(F.col("full_text"), F.col("section_title")).alias("pedagogy_role"), F.left("full_text", F.lit(300)).alias("text_snippet"), "full_text")


def formulas(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, stop, formula) of every formula in every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, a, b, t[a:b]) for d, t in zip(batch["doc_id"], batch["text"]) for a, b in formula_spans(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "begin", "stop", "formula"])

    return docs.select("doc_id", "text").where(F.col("text").rlike("[=$\\\\]")).mapInPandas(run, "doc_id long, begin int, stop int, formula string")


def page_text(text: Column, most: int = 6000) -> Column:
    """A page's text as models see it."""
    return F.left(text, F.lit(most)) if most > 0 else text
