"""Mastery of learners and what the tutor does next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules

# Steps of mastery for a right and a wrong answer.
UP, DOWN = 0.1, -0.05


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mastery(answers: DataFrame, up: float = UP, down: float = DOWN) -> DataFrame:
    """(user_id, concept, mastery, attempts, correct, last_seen) from (user_id, concept, ts, seq, right).

    Mastery is an ordered fold, m -> clamp(m + step), from 0. Such folds compose: after any run of answers,
    m -> clamp(m + shift, low, high). So each (user, concept, day) is folded by itself into (shift, low, high)
    and only a day's three numbers meet per key, however many answers one learner gives.
    """
    step = F.when(F.col("right"), up).otherwise(down)
    item = F.struct("ts", "seq", step.alias("step"))
    days = answers.groupBy("user_id", "concept", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("xs"), F.count("*").alias("attempts"), F.count_if("right").alias("correct"), F.max("ts").alias("last_seen"))
    triple = lambda shift, low, high: F.struct(shift.alias("shift"), low.alias("low"), high.alias("high"))
    start = triple(F.lit(0.0), F.lit(0.0), F.lit(1.0))

    def then(acc, shift, low, high):
        bound = lambda x: F.greatest(low, F.least(high, x))
        return triple(acc["shift"] + shift, bound(acc["low"] + shift), bound(acc["high"] + shift))

    folded = days.withColumn("f", F.aggregate("xs", start, lambda acc, x: then(acc, x["step"], F.lit(0.0), F.lit(1.0)))).drop("xs")
    users = folded.groupBy("user_id", "concept").agg(F.array_sort(F.collect_list(F.struct("day", "f"))).alias("ds"), F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct"), F.max("last_seen").alias("last_seen"))
    whole = F.aggregate("ds", start, lambda acc, d: then(acc, d["f"]["shift"], d["f"]["low"], d["f"]["high"]))
    users = users.withColumn("f", whole)
    return users.select("user_id", "concept", F.round(F.greatest("f.low", F.least("f.high", "f.shift")), 6).alias("mastery"), "attempts", "correct", "last_seen")


def level(m: Column) -> Column:
    """Name of the level; none, negative or over all bounds is a beginner."""
    out = None
    for name, low, high in rules.LEVELS:
        test = (m >= low) & (m < high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rules.LEVELS[0][0])


def decayed(m: Column, days: Column, rate: float = 0.0) -> Column:
    return m * F.exp(-rate * F.greatest(days, F.lit(0.0)))


def strengths(state: DataFrame, strong: tuple = (0.7, 0.7), weak: tuple = (0.4, 0.6), top: int = 3) -> DataFrame:
    """(user_id, kind, concept, mastery, correct_rate, place): each learner's top strengths and weaknesses (a report's limit)."""
    r = state.withColumn("correct_rate", F.round(F.when(F.col("attempts") > 0, F.col("correct") / F.col("attempts")).otherwise(0.0), 4))
    kind = F.when((F.col("mastery") >= strong[0]) & (F.col("correct_rate") >= strong[1]), "strength").when((F.col("mastery") < weak[0]) | (F.col("correct_rate") < weak[1]), "weakness")
    r = r.withColumn("kind", kind).where("kind is not null")
    sign = F.when(F.col("kind") == "strength", -1).otherwise(1)
    place = F.row_number().over(W.partitionBy("user_id", "kind").orderBy(sign * F.col("mastery"), sign * F.col("correct_rate"), "concept"))
    return r.withColumn("place", place).where(F.col("place") <= top).select("user_id", "kind", "concept", "mastery", "correct_rate", "place")


def needs_cold_start(m: Column, attempts: Column, done: Column) -> Column:
    return ~F.coalesce(done, F.lit(False)) & (m.isNull() | (F.coalesce(attempts, F.lit(0)) < 1) | (m < 0.15))


def readiness(paths: DataFrame, state: DataFrame, good: float = 0.6) -> DataFrame:
    """(user_id, place, concept, mastery, missing, weak, ready, confidence) along each learner's path (user_id, place, concept).

    Missing: concepts earlier on the path without mastery; weak: those below ``good``. Running counts replace a
    look at all earlier rows.
    """
    at = paths.join(state.select("user_id", "concept", "mastery"), ["user_id", "concept"], "left").withColumn("mastery", F.coalesce("mastery", F.lit(0.0)))
    before = W.partitionBy("user_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumns({"missing": F.count_if(F.col("mastery") == 0).over(before), "weak": F.count_if((F.col("mastery") > 0) & (F.col("mastery") < good)).over(before)})
    ready = (F.col("missing") == 0) & (F.col("weak") <= 2)
    confidence = F.when(F.col("missing") > 0, 0.0).when(F.col("weak") > 2, 0.3).when(F.col("weak") > 0, 0.7).otherwise(1.0)
    return at.select("user_id", "place", "concept", "mastery", "missing", "weak", ready.alias("ready"), confidence.alias("confidence"))


def next_concept(ready: DataFrame) -> DataFrame:
    """(user_id, next_concept, review): the first ready concept with mastery of at most 0.8, else the first below
    0.8; review: concepts below 0.6 in order of the path."""
    found = ready.groupBy("user_id").agg(
        F.min_by("concept", F.when(F.col("ready") & (F.col("mastery") <= 0.8), F.col("place"))).alias("a"), F.min_by("concept", F.when(F.col("mastery") < 0.8, F.col("place"))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("mastery") < 0.6, F.struct("place", "concept")))).alias("r"),
    )
    return found.select("user_id", F.coalesce("a", "b").alias("next_concept"), F.col("r.concept").alias("review"))


def mastery_delta(affect: Column, intent: Column, right: Column, quality: Column, current: Column, rate: float = 0.1, decay: float = 0.95, least: float = 0.05, most: float = 0.3) -> Column:
    """Change of mastery from a turn's signals; changes below ``least`` are none."""
    raw = F.when(affect == "engaged", 0.1).when(affect.isin("confused", "frustrated"), -0.05).otherwise(0.0)
    raw = raw + F.when((intent == "answer") & right, 0.15).when((intent == "answer") & ~right, -0.1).otherwise(0.0)
    raw = raw + F.when((intent == "explanation") & (F.coalesce(quality, F.lit(0.0)) > 0.7), 0.2).otherwise(0.0)
    d = clamp(F.when(F.coalesce(current, F.lit(0.0)) > 0.7, raw * decay).otherwise(raw) * rate, -most, most)
    return F.when(F.abs(d) < least, 0.0).otherwise(d)


def signal_confidence(affect: Column, right: Column, certainty: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.when(right.isNotNull(), 0.3).otherwise(0.0) + F.when(affect.isin("engaged", "confused", "frustrated"), 0.1).otherwise(0.0) + F.when(F.coalesce(certainty, F.lit(0.0)) > 0.8, 0.1).otherwise(0.0))


def consecutive_explains(turns: DataFrame) -> DataFrame:
    """Turns with how many explain actions end at each: runs by a count of other actions so far."""
    order = W.partitionBy("session_id").orderBy("turn")
    rows = turns.withColumn("_run", F.count_if(F.col("action") != "explain").over(order.rowsBetween(W.unboundedPreceding, 0)))
    n = F.count_if(F.col("action") == "explain").over(W.partitionBy("session_id", "_run").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("consecutive_explains", F.when(F.col("action") == "explain", n).otherwise(0)).drop("_run")


def next_action(turns: DataFrame) -> DataFrame:
    """Turns with cause and action by precedence.

    Columns: missing_prereqs, should_review, override, cold_start, intent, affect, consecutive_explains, chunks
    (number retrieved), plan_action (null without plan), bridge_from (null without an example to build on).
    """
    found, free = F.col("chunks") > 0, F.col("override").isNull()
    assess = found & (((F.col("intent") == "reflection") & (F.col("affect") == "engaged")) | (F.col("consecutive_explains") >= 2))
    cause = (
        F.when(F.col("should_review") & (F.col("missing_prereqs") > 0) & free, "prereq_gating").when(F.col("cold_start") & free, "cold_start").when(~free, "override_request")
        .when(assess & (F.col("intent") == "reflection"), "reflection_claimed_understanding").when(assess, "consecutive_explains_cap").when((F.col("intent") == "answer") & found, "student_answer")
        .when(F.col("plan_action").isNotNull(), "srl_plan").when(F.col("bridge_from").isNotNull(), "example_bridge").when(F.col("affect").isin("confused", "unsure") & found, "affect_confused_explain_basics").otherwise("explain_default")
    )
    rows = turns.withColumn("cause", cause)
    c = F.col("cause")
    action = F.when(c == "override_request", F.col("override")).when(c.isin("reflection_claimed_understanding", "consecutive_explains_cap"), "ask").when(c == "student_answer", "reflect").when(c == "srl_plan", F.col("plan_action")).otherwise("explain")
    return rows.withColumn("action", action)


def role_sequence(lv: Column) -> Column:
    # Roles to retrieve by level.
    words = lambda *w: F.array(*map(F.lit, w))
    return F.when(lv.isin("beginner", "developing"), words("definition", "explanation", "example")).when(lv == "proficient", words("example", "application", "derivation")).otherwise(words("derivation", "proof", "application"))


def sanitised(value: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(allowed), low).otherwise(default)


def latest_session(turns: DataFrame) -> DataFrame:
    """(session_id, next_turn, last_action, last_concept): one past the last turn; of the others the last not null."""
    return turns.groupBy("session_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn"), F.max_by("action", F.when(F.col("action").isNotNull(), F.col("turn"))).alias("last_action"), F.max_by("concept", F.when(F.col("concept").isNotNull(), F.col("turn"))).alias("last_concept"))


def study_plan(path: DataFrame, start: Column, daily_minutes: int = 60, minutes_per_concept: int = 30) -> DataFrame:
    """Concepts (user_id, place from 0, concept) with the day each is due."""
    per_day = max(1, daily_minutes // minutes_per_concept)
    return path.withColumns({"date": F.date_add(start, F.floor(F.col("place") / per_day).cast("int")), "minutes": F.lit(minutes_per_concept)})


def rule_plan(turns: DataFrame) -> DataFrame:
    """Turns with the plan made without a model: action, roles and the hardest level to show."""
    lv, affect = F.lower(F.coalesce("level", F.lit("beginner"))), F.lower(F.coalesce("affect", F.lit("neutral")))
    action = F.when(affect.isin("confused", "frustrated"), "hint").when(F.lower(F.coalesce("intent", F.lit("unknown"))) == "answer", "reflect").otherwise("explain")
    words = lambda *w: F.array(*map(F.lit, w))
    roles = F.when(lv == "beginner", words("definition", "explanation", "example")).when(lv == "proficient", words("example", "application")).otherwise(words("derivation", "application"))
    return turns.withColumns({"intended_action": action, "pedagogy_focus": roles, "difficulty_cap": F.when(lv == "beginner", "intermediate").otherwise("advanced")})


def combine_steps(steps: DataFrame, most: int = 4) -> DataFrame:
    """(session_id, turn, confidence, last_action, chunk_ids) of a plan's first ``most`` steps: mean confidence
    (0.6 without any), the last step's action, each chunk once in order of the steps."""
    used = steps.where(F.col("step") < most)
    g = used.groupBy("session_id", "turn").agg(F.avg("confidence").alias("c"), F.max_by("action", "step").alias("last_action"), F.array_sort(F.collect_list(F.struct("step", "chunk_ids"))).alias("s"))
    return g.select("session_id", "turn", F.round(F.coalesce("c", F.lit(0.6)), 6).alias("confidence"), "last_action", F.array_distinct(F.flatten("s.chunk_ids")).alias("chunk_ids"))
