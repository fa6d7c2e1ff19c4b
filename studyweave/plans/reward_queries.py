"""Queries of response scores, preferences and their evaluation, over conversation turns that begin with a cue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import reward as V
from .inputs import _quoted, sql_any, table
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: Cues dealt by (conv_id + 3 turn) % 8, so that every branch of the validators occurs.
CUES = [
    "Heat is energy because it moves. For example, a rod warms up. Can you explain why?",
    "Gradient means slope; therefore integrals follow. Try it.",
    "As an AI language model I cannot say.",
    "A short note.",
    "First look at heat. Then the flux follows. Finally we conclude.\n\nWhat do you think?",
    "The tensor of heat and the gradient and the integral are advanced terms " + "and so on " * 12,
    "I hallucinate. " + "word " * 230,
    "Such as heat, as a result of it " + "long sentence without an end " * 9,
]
PATH = ["heat", "gradient", "integral", "tensor"]
FOCUS = ["heat", "gradient", None, "flux"]
INTENTS = ["question", "answer", "reflection", "off_topic", "greeting", "unknown", "other"]
AFFECTS = ["neutral", "frustrated", "engaged", "unsure", "confused"]
ACTIONS = ["explain", "hint", "ask", "reflect", "review", "worked_example"]


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _ids(start, n):
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(start, start + n - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))))


def _responses(spark, sf_dir):
    """Cue and whole text of each turn."""
    text = F.coalesce("text", F.lit(""))
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("n", c + 3 * t)
    n = F.col("n")
    return rows.select(
        "conv_id", "turn", "n", F.concat(_pick(CUES, n), F.lit(" "), text).alias("response"), _pick(FOCUS, F.floor(n / 3)).alias("focus_concept"), F.array(*map(F.lit, PATH)).alias("learning_path"),
        _pick(INTENTS, n).alias("intent"), _pick(AFFECTS, F.floor(n / 2)).alias("affect"), _pick(ACTIONS, F.floor(n / 5)).alias("action"), _ids(F.lit(0), (n % 5).cast("int")).alias("retrieved_ids"), _ids((n % 3).cast("int"), (n % 4).cast("int")).alias("cited_ids"),
    )


def _arr(values):
    return "array[" + ", ".join("null" if v is None else _quoted(v).replace("\n", "' || chr(10) || '") for v in values) + "]"


def _sp(values, n):
    return f"({_arr(values)})[({n}) % {len(values)} + 1]"


_SPLIT = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_STRIP = "regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
_BASE = f"""g as (select conv_id, turn, min(text) as text, conv_id + 3 * turn as n from conversations group by conv_id, turn),
    r as (select conv_id, turn, n, {_sp(CUES, 'n')} || ' ' || coalesce(text, '') as response, {_sp(FOCUS, 'n // 3')} as focus, {_arr(PATH)} as path, {_sp(INTENTS, 'n')} as intent, {_sp(AFFECTS, 'n // 2')} as affect, {_sp(ACTIONS, 'n // 5')} as action,
        list_transform(range(0, n % 5), lambda i: 'c' || i::varchar) as known, list_transform(range(n % 3, n % 3 + n % 4), lambda i: 'c' || i::varchar) as cited from g),
    f as (select *, lower(response) as low, coalesce(focus, '') as fo, len({_SPLIT.format('response')}) as nw, list_filter(regexp_split_to_array({_STRIP.format('response')}, '[.!?]+\\s*'), lambda s: s <> '') as parts from r),
    q as (select *, ((fo <> '' and contains(low, fo)) or {sql_any('low', rules.ANSWERS)})::int as da, ({sql_any('low', rules.EXAMPLES)} or regexp_matches(low, '\\bexample\\b'))::int as ex, {sql_any('low', rules.REASONS)}::int as re, (ends_with({_STRIP.format('low')}, '?') or {sql_any('low', rules.SUGGESTIONS)})::int as fm,
        case when list_contains(path, fo) then list_filter(path[list_position(path, fo) + 1:], lambda t: contains(low, t)) else [] end as drift,
        list_sum(list_transform(parts, lambda s: len({_SPLIT.format('s')}))) / len(parts)::double as mean_s, len(list_filter(cited, lambda c: not list_contains(known, c))) as unknown, len(list_filter(known, lambda c: not list_contains(cited, c))) as missing from f),
    fit as (select *, case intent {' '.join(f"when '{k}' then {_arr(v)}" for k, v in rules.INTENT_ACTIONS.items())} else {_arr(rules.INTENT_ACTIONS['unknown'])} end as fits from q),
    sc as (select *, round((da + ex + re + 0.75::double * fm) / 3.75::double, 4) as rubric,
        greatest(case list_position(fits, action) when 1 then 1.0 when 2 then 0.8 when 3 then 0.6 else 0.2 end::double, case when affect in ('frustrated', 'unsure') and action = 'explain' then 0.7 else 0 end::double) as intent_score,
        round(greatest(1.0::double - case when fo <> '' and not contains(low, fo) then 0.4 else 0 end::double - case when len(drift) > 0 then 0.4 else 0 end::double, 0), 4) as gating,
        case when len(cited) > 0 and unknown > 0 then 0.4 when len(cited) > 0 and missing = 0 then 1.0 when len(cited) > 0 then 0.85 when len(known) > 0 then 0.6 else 0.5 end::double as grounding,
        1.0::double - case when nw < 30 then least(0.5::double, (30 - nw) / 30.0::double) else 0 end - case when nw > 220 then least(0.4::double, (nw - 220) / 220.0::double) else 0 end - case when mean_s > 32 then 0.1 else 0 end::double as st0 from fit),
    s2 as (select *, round(greatest(0, least(1, case when {sql_any('low', rules.BANNED)} then least(st0, 0.2::double) else st0 end)), 4) as style from sc),
    tot as (select *, round(rubric::decimal(12,4) * 0.4::decimal(8,6) + intent_score::decimal(12,4) * 0.2::decimal(8,6) + gating::decimal(12,4) * 0.2::decimal(8,6) + grounding::decimal(12,4) * 0.15::decimal(8,6) + style::decimal(12,4) * 0.05::decimal(8,6), 4)::double as total from s2),
    cr as (select *, case when nw > 0 then least(1.0::double, nw / 120.0::double) else 0.2 end as c0, case when contains(low, 'hallucinate') then 0.4 when fo <> '' and contains(low, fo) then 0.85 else 0.6 end::double as a0,
        case when len(known) > 0 and len(cited) > 0 then 0.6::double + 0.4::double * (len(cited) - unknown) / len(known) when len(known) > 0 then 0.5 else 0.55 end::double as p0 from tot),
    cri as (select *, round(c0, 4) as clarity, round(a0, 4) as accuracy, round(least(1, p0), 4) as support, p0 < 0.5 or a0 < 0.5 as hallucination, round(least(1, (c0 + a0 + p0) / 3), 4) as critic_confidence from cr)"""


@add(f"with {_BASE} select conv_id, turn, rubric, intent_score, gating, grounding, style, total from tot")
def response_rewards(spark, sf_dir):
    return V.score_responses(_responses(spark, sf_dir)).select("conv_id", "turn", "rubric", "intent_score", "gating", "grounding", "style", "total")


_FLAGS = {"rubric": [("rubric_incomplete", "rubric < 0.5")], "intent": [("intent_action_mismatch", "intent_score < 0.6")], "gating": [("advanced_concept_drift", "len(drift) > 0"), ("prereq_gating_failed", "gating < 0.5")], "grounding": [("unknown_grounding_ids", "unknown > 0"), ("grounding_low", "grounding < 0.6")], "style": [("response_too_short", "nw < 30"), ("response_too_long", "nw > 220"), ("long_sentences", "mean_s > 32"), ("banned_phrase", sql_any("low", rules.BANNED))]}
_FLAG_SQL = " || ".join(f"case when {test} then '{flag}|' else '' end" for c, fs in _FLAGS.items() for flag, test in [*fs, (f"{c}_below_threshold", f"{'intent_score' if c == 'intent' else c} < {rules.REWARD_THRESHOLDS[c]}")])


@add(f"with {_BASE} select conv_id, turn, {_FLAG_SQL} as flags from tot")
def reward_flags(spark, sf_dir):
    joined = F.array_join(F.transform("flags", lambda f: F.concat(f, F.lit("|"))), "")
    return V.score_responses(_responses(spark, sf_dir)).select("conv_id", "turn", joined.alias("flags"))


@add(f"with {_BASE} select conv_id, turn, clarity, accuracy, support, hallucination, critic_confidence from cri")
def critic_scores(spark, sf_dir):
    return V.critic(_responses(spark, sf_dir)).select("conv_id", "turn", "clarity", "accuracy", "support", "hallucination", "critic_confidence")


def _scored(spark, sf_dir):
    return V.critic(V.score_responses(_responses(spark, sf_dir)))


@add(f"""with {_BASE}, p as (select conv_id as observation_id, turn, 40000 + 5 * round(total * 10000)::bigint + round(critic_confidence * 10000)::bigint as s from cri),
    l as (select observation_id, list(s order by turn) as ss from p group by 1)
    select observation_id, (list_position(ss, list_max(ss)) - 1)::int as chosen, array_to_string(list_transform(ss, lambda x: ((x + 5) // 10 / 10000.0::double)::varchar), '|') as scores, (list_max(ss) + 5) // 10 / 10000.0::double as confidence from l""")
def preferences(spark, sf_dir):
    p = V.preferences(_scored(spark, sf_dir).select(F.col("conv_id").alias("observation_id"), F.col("turn").alias("candidate"), "total", "critic_confidence"))
    return p.withColumn("scores", F.array_join(F.transform("scores", lambda s: s.cast("string")), "|"))


@add("select conv_id as observation_id, k::int as candidate, (array['explain', 'ask', 'hint'])[k % 3 + 1] as action from (select distinct conv_id from conversations), range(4) r(k)")
def rollout_candidates(spark, sf_dir):
    return V.rollout(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("observation_id")).distinct(), 4, ["explain", "ask", "hint"])


def _mean(column: str) -> str:
    """Mean of numbers of 4 places, rounded half up in whole numbers."""
    return f"(2 * sum(round({column} * 10000)::bigint) + count({column})) // (2 * count({column})) / 10000.0::double"


_NAMED = " union all ".join(f"select '{kind}' as kind, '{name}' as name, {_mean(col)} as value from cri" for kind, name, col in [("component", "rubric", "rubric"), ("component", "intent", "intent_score"), ("component", "gating", "gating"), ("component", "grounding", "grounding"), ("component", "style", "style"), ("component", "total", "total"), ("critic", "clarity", "clarity"), ("critic", "accuracy", "accuracy"), ("critic", "support", "support"), ("critic", "confidence", "critic_confidence")])
_RATES = " union all ".join(f"select 'flag', '{flag}', (20000 * count(*) filter (where {test}) + count(*)) // (2 * count(*)) / 10000.0::double from cri having count(*) filter (where {test}) > 0" for fs in [*_FLAGS.values(), [("critic_hallucination", "hallucination")]] for flag, test in fs)


@add(f"with {_BASE} {_NAMED} union all {_RATES}")
def reward_evaluation(spark, sf_dir):
    return V.evaluate(_scored(spark, sf_dir))


@add(f"""with {_BASE.replace('group by conv_id, turn)', 'where conv_id % 2 = 0 group by conv_id, turn)')}, b as ({_NAMED} union all {_RATES}) select kind, name, value as base_value from b""")
def evaluation_subset(spark, sf_dir):
    return V.evaluate(_scored(spark, sf_dir).where("conv_id % 2 = 0")).withColumnRenamed("value", "base_value")


def _half(odd: int) -> str:
    """Evaluation of the conversations of one parity."""
    part = f"(select * from cri where conv_id % 2 = {odd})"
    return f"({_NAMED} union all {_RATES})".replace("from cri", f"from {part}")


@add(f"with {_BASE}, a as {_half(0)}, b as {_half(1)} select kind, name, round(coalesce(b.value, 0) - coalesce(a.value, 0), 4) as delta from a full join b using (kind, name)")
def evaluation_deltas(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return V.deltas(V.evaluate(s.where("conv_id % 2 = 0")), V.evaluate(s.where("conv_id % 2 = 1")))


def _prefs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    scores = F.transform(F.sequence(F.lit(1), (n % 4).cast("int") + 1), lambda i: ((n * 7 + i * 13) % 100) / 100.0)
    return e.select(n.alias("observation_id"), (n % 5).cast("int").alias("chosen"), F.when(n % 10 == 0, F.array().cast("array<double>")).otherwise(scores).alias("scores"), (n % 4 + 1).cast("int").alias("candidates"), (n % 23 / 20.0).alias("total"), (0.9 + n % 5 / 25.0).alias("weight_sum"))


_PREFS = """pr as (select event_id as observation_id, (event_id % 5)::int as chosen, case when event_id % 10 = 0 then [] else list_transform(range(1, event_id % 4 + 2), lambda i: ((event_id * 7 + i * 13) % 100) / 100.0::double) end as scores, (event_id % 4 + 1)::int as candidates, event_id % 23 / 20.0::double as total, 0.9::double + event_id % 5 / 25.0::double as weight_sum from events)"""


@add(f"with {_PREFS}, m as (select scores[greatest(1, least(chosen + 1, len(scores)))] as c, case when len(scores) >= 2 then list_reverse_sort(scores)[1] - list_reverse_sort(scores)[2] end as m from pr) select count(*) as num_pairs, {_mean('c')} as avg_chosen_score, {_mean('m')} as avg_margin from m")
def preference_statistics(spark, sf_dir):
    return V.preference_statistics(_prefs(spark, sf_dir))


@add(f"""with {_PREFS} select observation_id, 'fewer than two candidates' as error from pr where candidates < 2 union all select observation_id, 'chosen index out of range' from pr where chosen >= candidates union all select observation_id, 'scores differ from candidates' from pr where len(scores) <> candidates
    union all select observation_id, 'total outside [0, 1]' from pr where total < 0 or total > 1 union all select observation_id, 'weights do not sum to 1' from pr where abs(weight_sum - 1) > 0.05""")
def preference_validation(spark, sf_dir):
    return V.validate_preferences(_prefs(spark, sf_dir))


_LEVELS = ["beginner", "developing", "proficient", "mastering"]
_FLOW = " + ".join(f"{sql_any('low', stage)}::int" for stage in rules.FLOW)
_STEPS = f"""st as (select *, n % 10 / 10.0::double as conf, {_sp(_LEVELS, 'n')} as level, [{_sp(['definition', 'example', 'proof'], 'n')}, 'application'] as roles, {_sp(['introductory', 'intermediate', 'advanced'], 'n')} as dif from q),
    ro as (select *, case when level in ('beginner', 'developing') then ['definition', 'explanation', 'example'] when level = 'proficient' then ['example', 'application', 'derivation'] else ['derivation', 'proof', 'application'] end as wanted, len(list_filter(['all about heat', 'gradient'], lambda s: fo <> '' and contains(s, fo))) as mentions,
        case level when 'beginner' then ['introductory'] when 'developing' then ['introductory', 'intermediate'] when 'proficient' then ['intermediate'] else ['intermediate', 'advanced'] end as easy, ({_FLOW}) as flow from st),
    six as (select conv_id, turn, round(least(1, case when conf > 0.7::double then 0.4 when conf > 0.5::double then 0.2 else 0 end::double + case when n % 2 = 0 then 0.3 else 0 end::double + 0.3::double), 6) as understand_student,
        round(least(1, case when affect in ('confused', 'frustrated') and action in ('hint', 'explain') or affect = 'engaged' and action in ('ask', 'reflect') then 0.3 else 0 end::double + case when intent = 'question' and action in ('explain', 'hint') or intent = 'answer' and action in ('reflect', 'ask') then 0.3 else 0 end::double
            + 0.4::double * len(list_filter(wanted, lambda r: list_contains(roles, r))) / 3), 6) as select_pedagogy,
        round(least(1, case when len(known) >= 3 then 0.3 when len(known) >= 1 then 0.15 else 0 end::double + case when mentions > 0 then 0.3::double * mentions / 2 else 0 end + case when list_contains(easy, dif) then 0.4 else 0 end::double), 6) as retrieve_content,
        round(least(1, case when nw between 50 and 200 then 0.4 when nw between 30 and 250 then 0.2 else 0 end::double + case when contains(response, chr(10) || chr(10)) then 0.3 else 0 end::double + case when flow >= 2 then 0.3 else 0 end::double), 6) as structure_response,
        round((da + ex + re + fm) / 4.0::double, 6) as generate_output,
        round(least(1, case when ends_with({_STRIP.format('low')}, '?') then 0.5 else 0 end::double + case when {sql_any('low', rules.REFLECTION)} then 0.3 else 0 end::double + case when {sql_any('low', rules.NEXT_STEPS)} then 0.2 else 0 end::double), 6) as formative_check from ro)"""


@add(f"with {_BASE}, {_STEPS} select *, round(" + " + ".join(f"{step}::decimal(12,6) * {w}::decimal(8,6)" for step, w in rules.STEP_WEIGHTS.items()) + ", 4)::double as step_total from six")
def stepwise_rubric(spark, sf_dir):
    n = F.col("n")
    r = _responses(spark, sf_dir).withColumns({"classifier_confidence": n % 10 / 10.0, "has_mastery": n % 2 == 0, "level": _pick(["beginner", "developing", "proficient", "mastering"], n), "roles": F.array(_pick(["definition", "example", "proof"], n), F.lit("application")), "snippets": F.array(F.lit("all about heat"), F.lit("gradient")), "difficulties": F.array(_pick(["introductory", "intermediate", "advanced"], n))})
    return V.stepwise(r).select("conv_id", "turn", *rules.STEP_WEIGHTS, "step_total")
