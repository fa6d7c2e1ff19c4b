"""One tutor turn as columns: focus, response texts without a model, observation records and their short form.

A turn's row holds its session, message, classification, learning path, mastery and retrieved chunks; everything is an
expression over that row, so a table of turns is answered in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..functions import text as T


def _mastery(known: Column, concept: Column) -> Column:
    return F.coalesce(F.try_element_at(known, concept), F.lit(0.0))


def _named(concept: Column) -> Column:
    """A stripped name, null if blank."""
    return F.nullif(F.trim(F.coalesce(concept, F.lit(""))), F.lit(""))


def _first_open(path: Column, known: Column) -> Column:
    return F.get(F.filter(path, lambda c: _mastery(known, c) < rules.PATH_MASTERED), F.lit(0))


def focus(primary: Column, path: Column, known: Column, fallback: Column) -> Column:
    """What to teach: the asked concept unless mastered, the first open one of the path, a fallback, else what was asked.

    ``known``: map from concept to mastery; ``path`` and ``fallback``: arrays of concepts.
    """
    asked = _named(primary)
    open_asked = F.when(_mastery(known, asked) < rules.PRIMARY_MASTERED, asked)
    other = F.get(F.filter(fallback, lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(0))
    return F.coalesce(open_asked, _first_open(path, known), other, asked, F.get(path, F.lit(0)))


def focus_with_prerequisites(primary: Column, path: Column, known: Column, ready: Column, next_ready: Column) -> Column:
    """As :func:`focus`, but a concept of the path that is not ready gives way to the next ready one, if there is any."""
    asked = _named(primary)
    instead = F.when(F.array_contains(path, asked) & ~ready, next_ready)
    return F.coalesce(instead, _first_open(path, known), asked, F.get(path, F.lit(0)))


def context_block(chunks: Column) -> Column:
    """Numbered snippets of chunks (array of structs id, snippet), blank ones left out but counted."""
    line = lambda c, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit(" | "), F.coalesce(F.nullif(c["id"], F.lit("")), F.lit("?")), F.lit("] "), T.strip(c["snippet"]))
    lines = F.transform(chunks, lambda c, i: F.when(T.strip(F.coalesce(c["snippet"], F.lit(""))) != "", line(c, i)))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n\n")


def shortened(text: Column, width: int = 140) -> Column:
    """White space squeezed; longer texts end at a blank, with an ellipsis, within ``width`` characters."""
    flat = T.strip(F.regexp_replace(text, f"{T.WS}+", " "))
    cut = F.regexp_extract(flat, "^(.{0,%d})(?: |$)" % (width - 1), 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(cut, F.lit("…")))


def respond(turns: DataFrame) -> DataFrame:
    """Turns with response, confidence and source_ids.

    Columns: action (question, worked_example, review, explain or other), concept, level, chunks (array of structs id,
    snippet), difficulty, question_type. Unknown actions explain.
    """
    chunks = F.coalesce("chunks", F.array().cast("array<struct<id:string,snippet:string>>"))
    rows = turns.withColumns({"_block": context_block(chunks), "_some": F.size(chunks) > 0})
    first = T.strip(F.substring_index("_block", "\n", 1))
    has, named = F.col("_block") != "", _named(F.col("concept"))
    label = lambda default: F.coalesce(named, F.lit(default))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    kind = F.initcap(F.trim(F.replace(F.coalesce(F.nullif("question_type", F.lit("")), F.lit("question")), F.lit("_"), F.lit(" "))))
    hard = F.trim(F.replace(F.coalesce("difficulty", F.lit("")), F.lit("_"), F.lit(" ")))
    header = said(kind, " for ", label("this concept"), F.when(hard != "", said(" (", hard, ")")).otherwise(""))
    question = F.when(has, said(header, ":\n", first, "\nWhat step should come next?")).otherwise(said(header, ": Let's recall one key fact about ", label("this concept"), "."))

    opening = F.when(has, said("Let's step through a worked example on ", label("this concept"), ".\nGiven: ", first)).otherwise(said("Let's outline a worked example for ", label("this concept"), " even without detailed context."))
    example = F.concat_ws("\n", opening, *map(F.lit, rules.EXAMPLE_STEPS))

    snippets = F.transform(F.slice(chunks, 1, 3), lambda c: F.left(T.strip(F.coalesce(c["snippet"], F.lit(""))), F.lit(160)))
    items = F.filter(snippets, lambda s: s != "")
    items = F.when(F.size(items) > 0, items).otherwise(F.array(said("Revisit the core definition of ", label("our topic"), "."), F.lit(rules.REVIEW_HINT)))
    review = said("Quick review for ", label("our topic"), " (", F.col("level"), " level):\n", F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), shortened(s))), "\n"))

    top = T.strip(F.coalesce(F.get(chunks, F.lit(0))["snippet"], F.lit("")))
    explain = F.when(~F.col("_some"), F.lit(rules.NO_CHUNKS)).when(top != "", said(rules.SNIPPET_BEFORE, top, rules.SNIPPET_AFTER)).otherwise(F.lit(rules.NO_SNIPPET))

    action = F.col("action")
    text = F.when(action == "question", question).when(action == "worked_example", example).when(action == "review", review).otherwise(explain)
    sure = F.when(action == "question", F.when(has, 0.7).otherwise(0.6)).when(action == "worked_example", F.when(has, 0.65).otherwise(0.55))
    sure = sure.when(action == "review", F.when(F.col("_some"), 0.6).otherwise(0.5)).otherwise(F.when(F.col("_some"), F.lit(rules.SNIPPET_CONFIDENCE)).otherwise(0.2))
    ids = F.filter(F.transform(chunks, lambda c: c["id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    return rows.withColumns({"response": text, "confidence": sure, "source_ids": ids}).drop("_block", "_some")


def assessment(message: Column) -> tuple[Column, Column]:
    """(correct, quality) of a student's message by the words of agreement in it, without a model."""
    right = T.contains_any(F.lower(F.coalesce(message, F.lit(""))), rules.AGREEMENT)
    return right, F.when(right, 0.8).otherwise(0.4)


def accepted_examples(examples: DataFrame, relevance: float = 0.6, confidence: float = 0.5) -> DataFrame:
    """One example per request (six fields) among those relevant and sure enough: the first made (smallest seq)."""
    key = ["concept", "difficulty", "context_type", "student_background", "prerequisites", "avoided"]
    good = examples.where((F.col("relevance") >= relevance) & (F.col("confidence") >= confidence))
    return good.groupBy(*key).agg(F.min_by(F.struct("seq", "example", "relevance", "confidence"), "seq").alias("e")).select(*key, "e.*")


def observations(turns: DataFrame) -> DataFrame:
    """(seq, observation): the nested record of a turn. Columns as in :func:`simplified` and session_id, turn_index,
    classifier_confidence, learning_path, source_chunk_ids, action, confidence, cold_start."""
    text = F.array().cast("array<string>")
    sure = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    user = F.struct("message", "user_id", F.coalesce("target_concepts", text).alias("target_concepts"))
    classifier = F.struct(F.coalesce("intent", F.lit("unknown")).alias("intent"), F.coalesce("affect", F.lit("neutral")).alias("affect"), F.coalesce("concept", F.lit("")).alias("concept"), sure(F.col("classifier_confidence")).alias("confidence"))
    tutor = F.struct("focus_concept", "concept_level", F.coalesce("learning_path", text).alias("learning_path"))
    ids = F.filter(F.transform("chunks", lambda c: c["id"]), lambda i: i.isNotNull())
    retrieval = F.struct(ids.alias("chunk_ids"), F.coalesce("source_chunk_ids", text).alias("source_chunk_ids"), F.coalesce("roles", text).alias("pedagogy_roles"), F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), F.left(c["snippet"], F.lit(320)).alias("snippet"))).alias("chunks"))
    session, act = F.struct("session_id", "turn_index"), F.struct(F.col("action").alias("type"), F.coalesce("cold_start", F.lit(False)).alias("cold_start"), sure(F.col("confidence")).alias("confidence"))
    parts = {"user": user, "classifier": classifier, "tutor": tutor, "retrieval": retrieval, "session": session, "action": act}
    return turns.select("seq", F.struct(F.struct(F.lit(1).alias("version")).alias("metadata"), *(v.alias(k) for k, v in parts.items())).alias("observation"))


def simplified(records: DataFrame) -> DataFrame:
    """Flat form of nested observations, each missing field at its default."""
    o = F.col("observation")
    text = F.array().cast("array<string>")
    return records.select(
        "seq", F.coalesce(o["user"]["message"], F.lit("")).alias("message"), F.coalesce(o["user"]["user_id"], F.lit("")).alias("user_id"), F.coalesce(o["user"]["target_concepts"], text).alias("target_concepts"),
        F.coalesce(o["classifier"]["intent"], F.lit("unknown")).alias("intent"), F.coalesce(o["classifier"]["affect"], F.lit("neutral")).alias("affect"), o["tutor"]["focus_concept"].alias("focus_concept"),
        F.coalesce(o["tutor"]["concept_level"], F.lit("beginner")).alias("concept_level"), F.coalesce(o["retrieval"]["chunk_ids"], text).alias("chunk_ids"), F.coalesce(o["retrieval"]["pedagogy_roles"], text).alias("pedagogy_roles"),
    )


def step_timeline(turns: DataFrame) -> DataFrame:
    """(session_id, step, turn_index, action, mastery, change): a session's turns as numbered steps with the change of mastery."""
    order = W.partitionBy("session_id").orderBy("turn_index")
    return turns.select("session_id", F.row_number().over(order).alias("step"), "turn_index", "action", "mastery", F.round(F.col("mastery") - F.coalesce(F.lag("mastery").over(order), F.lit(0.0)), 6).alias("change"))
