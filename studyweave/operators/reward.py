"""Scores of tutor responses: validators, critic, preferences and their evaluation.

Input rows are flat: response, focus_concept, learning_path (array), intent, affect, action, retrieved_ids and
cited_ids (arrays). Every score is an expression, so a table of responses is scored in one pass without shuffle.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from .learner import clamp, role_sequence

COMPONENTS = ("rubric", "intent", "gating", "grounding", "style")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with what several scores read, made once: the response in lower case, its words, its sentences' mean."""
    text = T.strip(F.coalesce("response", F.lit("")))
    # sentences are what stands between runs of . ! and ?; their words are the text's without those
    sentences, words = F.regexp_count(text, F.lit(r"[^.!?\s][^.!?]*")), F.size(T.words(F.regexp_replace(text, "[.!?]+", " ")))
    rows = rows.withColumns({"_low": F.lower(F.coalesce("response", F.lit(""))), "_n": F.size(T.words(F.coalesce("response", F.lit(""))))})
    return rows.withColumn("_mean", F.when(sentences > 0, words / sentences).otherwise(F.col("_n").cast("double")))


def _low() -> Column:
    return F.col("_low")


def _one(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def rubric_features() -> dict[str, Column]:
    low, focus = _low(), F.lower(F.coalesce("focus_concept", F.lit("")))
    return {
        "direct_answer": _one(((focus != "") & F.contains(low, focus)) | T.contains_any(low, rules.ANSWERS)),
        "example": _one(T.contains_any(low, rules.EXAMPLES) | low.rlike(r"\bexample\b")),
        "reasoning": _one(T.contains_any(low, rules.REASONS)),
        "formative": _one(T.strip(low).endswith("?") | T.contains_any(low, rules.SUGGESTIONS)),
    }


def rubric() -> Column:
    """Mean of four features, the formative one at weight 0.75."""
    f = rubric_features()
    return F.round((f["direct_answer"] + f["example"] + f["reasoning"] + 0.75 * f["formative"]) / 3.75, 4)


def intent() -> Column:
    """1, 0.8 or 0.6 by the action's place among those fit for the intent, else 0.2; explaining to an unsure student is worth 0.7."""
    table = F.create_map(*(x for k, v in rules.INTENT_ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    fit = F.coalesce(F.try_element_at(table, F.lower(F.coalesce("intent", F.lit("unknown")))), F.try_element_at(table, F.lit("unknown")))
    action = F.lower(F.coalesce("action", F.lit("")))
    place = F.array_position(fit, action)
    score = F.when(place == 1, 1.0).when(place == 2, 0.8).when(place > 2, 0.6).otherwise(0.2)
    unsure = F.lower(F.coalesce("affect", F.lit("neutral"))).isin("frustrated", "unsure") & (action == "explain")
    return F.when(unsure, F.greatest(score, F.lit(0.7))).otherwise(score)


def drifting_terms() -> Column:
    """Concepts after the focus on the path that the response mentions."""
    low, focus = _low(), F.trim(F.coalesce("focus_concept", F.lit("")))
    at = F.array_position("learning_path", focus)
    later = F.when(at > 0, F.slice("learning_path", at.cast("int") + 1, F.greatest(F.size("learning_path"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.filter(later, lambda t: (t != "") & F.contains(low, F.lower(t))), F.array().cast("array<string>"))


def gating() -> Column:
    focus = F.lower(F.trim(F.coalesce("focus_concept", F.lit(""))))
    missing = F.when((focus != "") & ~F.contains(_low(), focus), 0.4).otherwise(0.0)
    drift = F.when(F.size(drifting_terms()) > 0, min(rules.ADVANCED_PENALTY, 0.6)).otherwise(0.0)
    return F.round(F.greatest(1.0 - missing - drift, F.lit(0.0)), 4)


def grounding() -> Column:
    cited, known = F.col("cited_ids"), F.col("retrieved_ids")
    unknown, missing = F.size(F.array_except(cited, known)), F.size(F.array_except(known, cited))
    return F.when((F.size(cited) > 0) & (unknown > 0), 0.4).when((F.size(cited) > 0) & (missing == 0), 1.0).when(F.size(cited) > 0, 0.85).when(F.size(known) > 0, 0.6).otherwise(0.5)


def style() -> Column:
    """1 less what is too short, too long or in long sentences; banned phrases leave 0.2 at most."""
    n = F.col("_n")
    short = F.when(n < rules.MIN_WORDS, F.least(F.lit(0.5), (rules.MIN_WORDS - n) / rules.MIN_WORDS)).otherwise(0.0)
    long = F.when(n > rules.MAX_WORDS, F.least(F.lit(0.4), (n - rules.MAX_WORDS) / rules.MAX_WORDS)).otherwise(0.0)
    score = 1.0 - short - long - F.when(F.col("_mean") > rules.LONG_SENTENCE, 0.1).otherwise(0.0)
    score = F.when(T.contains_any(_low(), rules.BANNED), F.least(score, F.lit(0.2))).otherwise(score)
    return F.round(clamp(score), 4)


def _flags() -> Column:
    """Flags in order of the components, each followed by its threshold's."""
    n = F.col("_n")
    cited_unknown = F.size(F.array_except("cited_ids", "retrieved_ids")) > 0
    named = {
        "rubric": [("rubric_incomplete", F.col("rubric") < 0.5)],
        "intent": [("intent_action_mismatch", F.col("intent_score") < 0.6)],
        "gating": [("advanced_concept_drift", F.size(drifting_terms()) > 0), ("prereq_gating_failed", F.col("gating") < 0.5)],
        "grounding": [("unknown_grounding_ids", cited_unknown), ("grounding_low", F.col("grounding") < 0.6)],
        "style": [("response_too_short", n < rules.MIN_WORDS), ("response_too_long", n > rules.MAX_WORDS), ("long_sentences", F.col("_mean") > rules.LONG_SENTENCE), ("banned_phrase", T.contains_any(_low(), rules.BANNED))],
    }
    each = []
    for name in COMPONENTS:
        each += [F.when(test, flag) for flag, test in named[name]]
        each.append(F.when(F.col("intent_score" if name == "intent" else name) < rules.REWARD_THRESHOLDS[name], f"{name}_below_threshold"))
    return F.filter(F.array(*each), lambda f: f.isNotNull())


def exact_sum(parts: dict[str, float], scale: int = 4, places: int = 4):
    """Weighted sum of columns of ``scale`` places, rounded half up to ``places``: in decimals, since sums of rounded
    numbers often lie on a half, which binary fractions miss."""
    each = (F.col(c).cast(f"decimal(12,{scale})") * F.lit(Decimal(str(round(w, 6)))).cast("decimal(8,6)") for c, w in parts.items())
    return F.round(reduce(Column.__add__, each), places).cast("double")


def exact_share(part, whole):
    """part / whole of whole numbers from 0 on, rounded half up to 4 places without a binary fraction."""
    return F.call_function("div", 20_000 * part + whole, 2 * whole) / 10_000


def exact_mean(column: str):
    """Mean of numbers of 4 places from 0 on, rounded half up to 4 places."""
    total, n = F.sum(F.round(F.col(column) * 10_000).cast("long")), F.count(column)
    return F.call_function("div", 2 * total + n, F.nullif(2 * n, F.lit(0))) / 10_000


def score_responses(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows with rubric, intent_score, gating, grounding, style, total and flags."""
    w = weights or rules.REWARD_WEIGHTS
    whole = sum(w.values()) or 1.0
    r = _prepared(rows).withColumns({"rubric": rubric(), "intent_score": intent(), "gating": gating(), "grounding": grounding(), "style": style()})
    total = exact_sum({"intent_score" if c == "intent" else c: w.get(c, 0.0) / whole for c in COMPONENTS})
    return r.withColumns({"total": clamp(total), "flags": _flags()}).drop("_low", "_n", "_mean")


def critic(rows: DataFrame) -> DataFrame:
    """Rows with clarity, accuracy, support, critic_confidence and hallucination, without a model."""
    rows = _prepared(rows)
    n, low, focus = F.col("_n"), _low(), F.lower(F.coalesce("focus_concept", F.lit("")))
    clarity = F.when(n > 0, clamp(n / 120.0)).otherwise(0.2)
    accuracy = F.when(low.contains("hallucinate"), 0.4).when((focus != "") & F.contains(low, focus), 0.85).otherwise(0.6)
    cited, known = F.array_distinct("cited_ids"), F.col("retrieved_ids")
    support = F.when((F.size(known) > 0) & (F.size(cited) > 0), 0.6 + 0.4 * F.size(F.array_intersect(cited, known)) / F.greatest(F.size(known), F.lit(1))).when(F.size(known) > 0, 0.5).otherwise(0.55)
    r = rows.withColumns({"_c": clarity, "_a": accuracy, "_s": support})
    return r.withColumns({"clarity": F.round("_c", 4), "accuracy": F.round("_a", 4), "support": F.round(clamp(F.col("_s")), 4), "hallucination": (F.col("_s") < 0.5) | (F.col("_a") < 0.5), "critic_confidence": F.round(clamp((F.col("_c") + F.col("_a") + F.col("_s")) / 3), 4)}).drop("_c", "_a", "_s", "_low", "_n", "_mean")


def preferences(candidates: DataFrame) -> DataFrame:
    """(observation_id, chosen, scores, confidence) from (observation_id, candidate, total, critic_confidence): the first
    highest of 0.4 + 0.5 total + 0.1 confidence, which has 4 places each and is summed and rounded in whole numbers."""
    whole = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 10_000).cast("long")
    raw = F.least(F.greatest(40_000 + 5 * whole("total") + whole("critic_confidence"), F.lit(0)), F.lit(100_000)).cast("long")
    places = lambda s: F.call_function("div", s + 5, F.lit(10)) / 10_000
    g = candidates.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("candidate", raw.alias("s")))).alias("c"))
    best = F.array_max("c.s")
    return g.select("observation_id", (F.array_position("c.s", best) - 1).cast("int").alias("chosen"), F.transform("c.s", places).alias("scores"), places(best).alias("confidence"))


def rollout(observations: DataFrame, candidates: int, actions: list[str]) -> DataFrame:
    """Each observation once per candidate, actions in turn."""
    return observations.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn("action", F.element_at(F.array(*map(F.lit, actions)), F.col("candidate") % len(actions) + 1))


def evaluate(scored: DataFrame) -> DataFrame:
    """(kind, name, value): means of components and critic, rates of flags, rounded to 4 places."""
    means = {**{c: "intent_score" if c == "intent" else c for c in COMPONENTS}, "total": "total"}
    critics = {"clarity": "clarity", "accuracy": "accuracy", "support": "support", "confidence": "critic_confidence"}
    row = scored.agg(F.count("*").alias("_n"), *(exact_mean(c).alias(f"m_{n}") for n, c in means.items()), *(exact_mean(c).alias(f"c_{n}") for n, c in critics.items()), F.count_if("hallucination").alias("_h"))
    each = [F.struct(F.lit("component").alias("kind"), F.lit(n).alias("name"), F.col(f"m_{n}").alias("value")) for n in means] + [F.struct(F.lit("critic").alias("kind"), F.lit(n).alias("name"), F.col(f"c_{n}").alias("value")) for n in critics]
    each.append(F.struct(F.lit("flag").alias("kind"), F.lit("critic_hallucination").alias("name"), exact_share(F.col("_h"), F.col("_n")).alias("value")))
    fixed = row.where("_n > 0").select(F.explode(F.array(*each)).alias("e")).select("e.kind", "e.name", "e.value").where("kind <> 'flag' or value > 0")
    flags = scored.select(F.explode("flags").alias("name")).where("not name like '%below_threshold'").groupBy("name").agg(F.count("*").alias("n")).crossJoin(F.broadcast(row.select("_n")))  # one row
    return fixed.unionByName(flags.select(F.lit("flag").alias("kind"), "name", exact_share(F.col("n"), F.col("_n")).alias("value")))


def deltas(base: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name, delta) over the names of either; absent is 0."""
    b, n = base.withColumnRenamed("value", "b"), new.withColumnRenamed("value", "n")
    return b.join(n, ["kind", "name"], "full_outer").select("kind", "name", F.round(F.coalesce("n", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 4).alias("delta"))


def preference_statistics(prefs: DataFrame) -> DataFrame:
    """num_pairs, avg_chosen_score (the index clamped) and avg_margin (best less second, of rows with two scores)."""
    n = F.size("scores")
    chosen = F.when(n > 0, F.element_at("scores", F.greatest(F.lit(1), F.least(F.col("chosen") + 1, n)).cast("int")))
    ordered = F.sort_array("scores", asc=False)
    margin = F.when(n >= 2, F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))
    rows = prefs.select(chosen.alias("chosen"), margin.alias("margin"))
    return rows.agg(F.count("*").alias("num_pairs"), *(F.coalesce(exact_mean(c), F.lit(0.0)).alias(n) for c, n in (("chosen", "avg_chosen_score"), ("margin", "avg_margin"))))


def validate_preferences(prefs: DataFrame) -> DataFrame:
    """Rows (observation_id, error) of records that break a rule. Columns: chosen, scores, candidates, total, weight_sum."""
    each = F.array(
        F.when(F.col("candidates") < 2, "fewer than two candidates"), F.when(F.col("chosen") >= F.col("candidates"), "chosen index out of range"), F.when(F.size("scores") != F.col("candidates"), "scores differ from candidates"),
        F.when((F.col("total") < 0) | (F.col("total") > 1), "total outside [0, 1]"), F.when(F.abs(F.col("weight_sum") - 1) > 0.05, "weights do not sum to 1"),
    )
    return prefs.select("observation_id", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("error"))


def redact(records: DataFrame, paths: list[str] = ["user.user_id", "session.session_id"]) -> DataFrame:
    """Records without the named fields of their structs."""
    for p in paths:
        struct, field = p.split(".", 1)
        records = records.withColumn(struct, F.col(struct).dropFields(field))
    return records


def stepwise(rows: DataFrame) -> DataFrame:
    """Rows with six step scores and step_total.

    Further columns: classifier_confidence, has_mastery, level, roles (array), snippets and difficulties (arrays).
    """
    rows = _prepared(rows)
    low, n = _low(), F.col("_n")
    conf = F.coalesce("classifier_confidence", F.lit(0.0))
    understand = F.when(conf > 0.7, 0.4).when(conf > 0.5, 0.2).otherwise(0.0) + F.when(F.col("has_mastery"), 0.3).otherwise(0.0) + F.when(F.size("learning_path") > 0, 0.3).otherwise(0.0)
    affect = F.when(F.col("affect").isin("confused", "frustrated") & F.col("action").isin("hint", "explain"), 0.3).when((F.col("affect") == "engaged") & F.col("action").isin("ask", "reflect"), 0.3).otherwise(0.0)
    fits = F.when((F.col("intent") == "question") & F.col("action").isin("explain", "hint"), 0.3).when((F.col("intent") == "answer") & F.col("action").isin("reflect", "ask"), 0.3).otherwise(0.0)
    wanted = role_sequence(F.lower(F.coalesce("level", F.lit("beginner"))))
    pedagogy = affect + fits + 0.4 * F.size(F.array_intersect(wanted, "roles")) / 3
    focus, first = F.lower(F.trim(F.coalesce("focus_concept", F.lit("")))), F.slice("snippets", 1, 3)
    mentions = F.when(focus != "", F.size(F.filter(first, lambda s: F.contains(F.lower(s), focus)))).otherwise(0)
    # Difficulties fit for a level.
    table = {"beginner": ["introductory"], "developing": ["introductory", "intermediate"], "proficient": ["intermediate"], "mastering": ["intermediate", "advanced"]}
    ok = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.lower("level")), F.array(F.lit("intermediate")))
    easy = (F.size("difficulties") > 0) & F.forall(F.slice("difficulties", 1, 3), lambda d: F.array_contains(ok, F.coalesce(d, F.lit("intermediate"))))
    count = F.size("retrieved_ids")
    content = F.when(count >= 3, 0.3).when(count >= 1, 0.15).otherwise(0.0) + F.when(mentions > 0, 0.3 * mentions / F.greatest(F.lit(1), F.least(F.lit(3), F.size("snippets")))).otherwise(0.0) + F.when(easy, 0.4).otherwise(0.0)
    flow = sum((T.contains_any(low, stage).cast("int") for stage in rules.FLOW), F.lit(0))
    structure = F.when(n.between(50, 200), 0.4).when(n.between(30, 250), 0.2).otherwise(0.0) + F.when(F.contains(F.col("response"), F.lit("\n\n")), 0.3).otherwise(0.0) + F.when(flow >= 2, 0.3).otherwise(0.0)
    f = rubric_features()
    output = (f["direct_answer"] + f["example"] + f["reasoning"] + f["formative"]) / 4
    formative = F.when(T.strip(low).endswith("?"), 0.5).otherwise(0.0) + F.when(T.contains_any(low, rules.REFLECTION), 0.3).otherwise(0.0) + F.when(T.contains_any(low, rules.NEXT_STEPS), 0.2).otherwise(0.0)
    steps = dict(zip(rules.STEP_WEIGHTS, (understand, pedagogy, content, structure, output, formative)))
    r = rows.withColumns({name: F.round(F.least(F.lit(1.0), s), 6) for name, s in steps.items()})
    return r.drop("_low", "_n", "_mean").withColumn("step_total", exact_sum(rules.STEP_WEIGHTS, scale=6))
