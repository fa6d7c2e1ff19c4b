"""Stand-ins for the engine's tables, made from the driver's tables, each with the same rows in SQL.

A document is a resource. Its sentences in groups of five are its chunks; since the invented prose holds none of
the cue phrases that the ladders look for, a chunk begins with a cue of a fixed table, dealt by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: (cue, section title, section level) dealt to chunks by (doc_id + idx) % len(CUES).
CUES = [
    ("A field is defined as a rule, see Eq. 5.8 and Figure 3.", "Definition of fields", 1),
    ("Theorem: the sum is finite. Let us define $a = b$.", "", 2),
    ("Proof: starting from (2.1) it follows that $x < y$.", "Proofs", 2),
    ("For example, consider the case of Table 4: heat over time.", "Worked example", 2),
    ("Deriving the integral \\[\\int f(x) dx\\] we obtain the law.", "", 3),
    ("In practice this theory is used in design. See Section 2.3.", "Applications", 1),
    ("Exercise: calculate the derivative and solve for y.", "Problem set", 2),
    ("In conclusion, the key points of Chapter 7 apply.", "Summary", 1),
    ("Overview of the concept of a gradient, Fig. 2: curve of heat versus time.", "Introduction", 1),
    ("plain prose without any sign", "", 3),
    ("Partial differential forms: $\\frac{d y}{d x}$ and $$\\sum_i x_i$$ hold.", "", 2),
]
CHUNK_SENTENCES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, sentence), pos from 0."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SENTENCES_SQL = r"""s as (
    select doc_id, unnest(l) as sentence, unnest(range(len(l)))::int as pos from (
        select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?\n])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)),
               lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') as l from documents))"""

CUES_SQL = "cues(k, cue, section_title, section_level) as (values " + ", ".join(f"({k}, {_quoted(c)}, {_quoted(t)}, {n})" for k, (c, t, n) in enumerate(CUES)) + ")"

#: CTEs for :func:`chunks`, to be preceded by "with ".
CHUNKS_SQL = f"""{SENTENCES_SQL}, {CUES_SQL},
    body as (select doc_id, (pos // {CHUNK_SENTENCES})::int as idx, string_agg(sentence, ' ' order by pos) as body from s group by doc_id, pos // {CHUNK_SENTENCES}),
    chunks as (select doc_id, idx, doc_id::varchar || '-' || idx::varchar as chunk_id, (idx // 3 + 1)::int as page_number, (idx % 3 * 1000)::int as source_offset,
        cue || ' ' || body as full_text, section_title, section_level::int as section_level from body join cues on (doc_id + idx) % {len(CUES)} = k),
    tagged as (select *, list_slice(regexp_extract_all(lower(full_text), '[a-z]{{3,}}'), 5, 8) as key_concepts, list_slice(regexp_extract_all(lower(full_text), '[a-z]{{3,}}'), 9, 12) as prerequisites,
        list_slice(regexp_extract_all(lower(full_text), '[a-z]{{3,}}'), 1, 1) as topic from chunks)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document: doc_id, idx, chunk_id, page_number, source_offset, full_text, section_title,
    section_level, key_concepts, prerequisites, topic."""
    # a document's sentences are grouped while still one row, so no shuffle is needed
    # and no filter on their number, which would cut every text twice: Spark moves it below the cutting
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("l"))
    starts = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.floor((F.size("l") - 1) / CHUNK_SENTENCES).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = docs.select("doc_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("idx"), F.array_join(F.slice("l", i * CHUNK_SENTENCES + 1, CHUNK_SENTENCES), " ").alias("body")))).alias("c"))
    cues = F.array(*(F.struct(F.lit(c).alias("cue"), F.lit(t).alias("title"), F.lit(n).alias("level")) for c, t, n in CUES))
    cue = F.element_at(cues, ((F.col("doc_id") + F.col("idx")) % len(CUES) + 1).cast("int"))
    rows = cut.select("doc_id", F.col("c.idx").alias("idx"), F.col("c.body").alias("body")).withColumn("cue", cue)
    rows = rows.select(
        "doc_id", "idx", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("chunk_id"), F.floor(F.col("idx") / 3 + 1).cast("int").alias("page_number"),
        (F.col("idx") % 3 * 1000).cast("int").alias("source_offset"), F.concat_ws(" ", "cue.cue", "body").alias("full_text"), F.col("cue.title").alias("section_title"), F.col("cue.level").alias("section_level"),
    )
    found = F.regexp_extract_all(F.lower("full_text"), F.lit("[a-z]{3,}"), F.lit(0))
    return rows.withColumn("w", found).withColumns({"key_concepts": F.slice("w", 5, 4), "prerequisites": F.slice("w", 9, 4), "topic": F.slice("w", 1, 1)}).drop("w")


def sql_any(expr: str, phrases) -> str:
    return "(" + " or ".join(f"contains({expr}, {_quoted(p)})" for p in phrases) + ")"


def sql_ladder(expr: str, steps, default: str) -> str:
    """CASE over the same rule table; outcomes may be numbers."""
    quoted = lambda v: str(v) if isinstance(v, (int, float)) else _quoted(v)
    return "case " + " ".join(f"when {sql_any(expr, phrases)} then {quoted(outcome)}" for outcome, phrases in steps) + f" else {default} end"
