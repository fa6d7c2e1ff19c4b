"""Queries of mastery, readiness, tutoring decisions and streams: events are answers, right if their value exceeds 30."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import learner as L
from ..operators import quality
from ..sources.staging import shared_path
from ..streaming import learners as S
from .inputs import _quoted, table
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add


def _answers(events):
    return events.select("user_id", F.col("event_type").alias("concept"), "ts", F.col("event_id").alias("seq"), (F.col("value") > 30).alias("right"))


def _state(spark, sf_dir):
    return L.mastery(_answers(table(spark, sf_dir, "events")))


_STATE = """a as (select user_id, event_type as concept, list(case when value > 30 then 0.1::double else -0.05::double end order by ts, event_id) as steps, count(*)::bigint as attempts, count(*) filter (where value > 30)::bigint as correct, max(ts) as last_seen from events group by all),
    state as (select user_id, concept, round(list_reduce(list_prepend(0.0::double, steps), lambda m, s: greatest(0.0, least(1.0, m + s))), 6) as mastery, attempts, correct, last_seen from a)"""
_LEVEL = "case " + " ".join(f"when {{0}} >= {low} and {{0}} < {high} then '{name}'" for name, low, high in rules.LEVELS) + " else 'beginner' end"


@add(f"with {_STATE} select * from state")
def mastery_fold(spark, sf_dir):
    return _state(spark, sf_dir)


@add(f"with {_STATE}, l as (select {_LEVEL.format('mastery')} as level from state) select level, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as share from l group by level")
def mastery_levels(spark, sf_dir):
    return quality.distribution(_state(spark, sf_dir).select(L.level(F.col("mastery")).alias("level")), "level")


@add(f"with {_STATE}, d as (select *, date_diff('day', last_seen::date, date '2026-01-01')::double as days from state) select user_id, concept, round(mastery * exp(-0.01::double * greatest(days, 0)), 6) as mastery from d")
def mastery_decay(spark, sf_dir):
    days = F.date_diff(F.lit("2026-01-01").cast("date"), F.to_date("last_seen")).cast("double")
    return _state(spark, sf_dir).select("user_id", "concept", F.round(L.decayed(F.col("mastery"), days, 0.01), 6).alias("mastery"))


@add(f"""with {_STATE}, r as (select *, round(correct / attempts::double, 4) as correct_rate from state), k as (select *, case when mastery >= 0.7 and correct_rate >= 0.7 then 'strength' when mastery < 0.4 or correct_rate < 0.6 then 'weakness' end as kind from r),
    p as (select *, row_number() over (partition by user_id, kind order by case kind when 'strength' then -mastery else mastery end, case kind when 'strength' then -correct_rate else correct_rate end, concept)::int as place from k where kind is not null) select user_id, kind, concept, mastery, correct_rate, place from p where place <= 3""")
def strengths_weaknesses(spark, sf_dir):
    return L.strengths(_state(spark, sf_dir))


def _paths(spark, sf_dir):
    """Every learner's path: the concepts of the events in alphabetic order."""
    e = table(spark, sf_dir, "events")
    concepts = e.select("event_type").distinct().withColumn("rank", F.lit(1)).groupBy("rank").agg(F.array_sort(F.collect_set("event_type")).alias("cs"))  # a handful of kinds
    return e.select("user_id").distinct().crossJoin(F.broadcast(concepts.select("cs"))).select("user_id", F.posexplode("cs").alias("place", "concept"))


_READY = f"""{_STATE}, cs as (select event_type as concept, (row_number() over (order by event_type) - 1)::int as place from (select distinct event_type from events)),
    pa as (select u.user_id, place, cs.concept, coalesce(s.mastery, 0.0) as mastery from (select distinct user_id from events) u, cs left join state s on s.user_id = u.user_id and s.concept = cs.concept),
    bf as (select *, count(*) filter (where mastery = 0) over w as missing, count(*) filter (where mastery > 0 and mastery < 0.6) over w as weak from pa window w as (partition by user_id order by place rows between unbounded preceding and 1 preceding)),
    rd as (select *, missing = 0 and weak <= 2 as ready, case when missing > 0 then 0.0 when weak > 2 then 0.3 when weak > 0 then 0.7 else 1.0 end::double as confidence from bf)"""


@add(f"with {_READY} select user_id, place, concept, mastery, missing, weak, ready, confidence from rd")
def prerequisite_readiness(spark, sf_dir):
    return L.readiness(_paths(spark, sf_dir), _state(spark, sf_dir))


@add(f"with {_READY} select user_id, coalesce(arg_min(concept, place) filter (where ready and mastery <= 0.8), arg_min(concept, place) filter (where mastery < 0.8)) as next_concept, coalesce(string_agg(concept, '|' order by place) filter (where mastery < 0.6), '') as review from rd group by user_id")
def next_concepts(spark, sf_dir):
    n = L.next_concept(L.readiness(_paths(spark, sf_dir), _state(spark, sf_dir)))
    return n.select("user_id", "next_concept", F.array_join("review", "|").alias("review"))


@add(f"with {_STATE} select user_id, concept, coalesce(user_id % 9 = 0, false) = false and (attempts < 1 or mastery < 0.15) as cold_start from state")
def cold_start(spark, sf_dir):
    return _state(spark, sf_dir).select("user_id", "concept", L.needs_cold_start(F.col("mastery"), F.col("attempts"), F.col("user_id") % 9 == 0).alias("cold_start"))


_AFFECTS = ["confused", "unsure", "engaged", "frustrated", "neutral"]
_INTENTS = ["question", "answer", "reflection", "off_topic", "greeting", "explanation"]


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values, n):
    return f"(array[{', '.join(map(_quoted, values))}])[({n}) % {len(values)} + 1]"


@add(f"""with e as (select event_id, {_sql_pick(_AFFECTS, 'event_id')} as affect, {_sql_pick(_INTENTS, 'event_id // 5')} as intent, case when event_id % 3 = 0 then null else value > 30 end as ok, event_id % 10 / 10.0::double as q from events),
    r as (select *, case affect when 'engaged' then 0.1::double when 'confused' then -0.05::double when 'frustrated' then -0.05::double else 0 end + case when intent = 'answer' and ok then 0.15::double when intent = 'answer' and not ok then -0.1::double else 0 end + case when intent = 'explanation' and q > 0.7 then 0.2::double else 0 end as raw from e),
    d as (select *, greatest(-0.3::double, least(0.3::double, case when q > 0.7 then raw * 0.95::double else raw end * 1.0::double)) as d from r)
    select event_id, round(case when abs(d) < 0.05 then 0.0 else d end, 6) as delta, round(least(1.0::double, 0.5::double + case when ok is not null then 0.3::double else 0 end + case when affect in ('engaged', 'confused', 'frustrated') then 0.1::double else 0 end + case when q > 0.8 then 0.1::double else 0 end), 6) as confidence from d""")
def mastery_deltas(spark, sf_dir):
    """With rate 1, for with the default rate every change is below the least one."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", _pick(_AFFECTS, i).alias("affect"), _pick(_INTENTS, F.floor(i / 5)).alias("intent"), F.when(i % 3 != 0, F.col("value") > 30).alias("ok"), (i % 10 / 10.0).alias("q"))
    delta = L.mastery_delta(F.col("affect"), F.col("intent"), F.col("ok"), F.col("q"), F.col("q"), rate=1.0)
    return e.select("event_id", F.round(delta, 6).alias("delta"), F.round(L.signal_confidence(F.col("affect"), F.col("ok"), F.col("q")), 6).alias("confidence"))


_ACTIONS = ["explain", "explain", "ask", "explain", "hint", "explain", "explain"]


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    n = F.col("session_id") + F.col("turn")
    return c.dropDuplicates(["session_id", "turn"]).withColumn("action", _pick(_ACTIONS, n))


_TURNS = f"tu as (select distinct conv_id as session_id, turn, {_sql_pick(_ACTIONS, 'conv_id + turn')} as action from conversations)"
_RUNS = f"""{_TURNS}, rn as (select *, count(*) filter (where action <> 'explain') over (partition by session_id order by turn) as run from tu),
    ce as (select session_id, turn, action, case when action = 'explain' then count(*) filter (where action = 'explain') over (partition by session_id, run order by turn) else 0 end as consecutive_explains from rn)"""


@add(f"with {_RUNS} select * from ce")
def consecutive_explains(spark, sf_dir):
    return L.consecutive_explains(_turns(spark, sf_dir))


@add(f"""with {_RUNS}, t as (select session_id, turn, consecutive_explains, (session_id + turn) % 11 as k, {_sql_pick(_AFFECTS, 'session_id * 3 + turn')} as affect, {_sql_pick(_INTENTS, 'session_id + turn * 2')} as intent from ce),
    b as (select *, k % 4 as chunks, case when k = 1 then 1 else 0 end as missing, k = 1 as review, case when k = 2 then 'hint' end as override, k = 3 as cold, case when k = 4 then 'review' end as plan, case when k = 5 then 'basics' end as bridge from t),
    c as (select *, case when review and missing > 0 and override is null then 'prereq_gating' when cold and override is null then 'cold_start' when override is not null then 'override_request' when chunks > 0 and intent = 'reflection' and (affect = 'engaged' or consecutive_explains >= 2) then 'reflection_claimed_understanding'
        when chunks > 0 and consecutive_explains >= 2 then 'consecutive_explains_cap' when intent = 'answer' and chunks > 0 then 'student_answer' when plan is not null then 'srl_plan' when bridge is not null then 'example_bridge' when affect in ('confused', 'unsure') and chunks > 0 then 'affect_confused_explain_basics' else 'explain_default' end as cause from b)
    select session_id, turn, cause, case when cause = 'override_request' then override when cause in ('reflection_claimed_understanding', 'consecutive_explains_cap') then 'ask' when cause = 'student_answer' then 'reflect' when cause = 'srl_plan' then plan else 'explain' end as action from c""")
def tutor_actions(spark, sf_dir):
    t = L.consecutive_explains(_turns(spark, sf_dir)).drop("action")
    s, n = F.col("session_id"), F.col("turn")
    t = t.withColumns({"k": (s + n) % 11, "affect": _pick(_AFFECTS, s * 3 + n), "intent": _pick(_INTENTS, s + n * 2)})
    k = F.col("k")
    t = t.withColumns({"chunks": k % 4, "missing_prereqs": F.when(k == 1, 1).otherwise(0), "should_review": k == 1, "override": F.when(k == 2, "hint"), "cold_start": k == 3, "plan_action": F.when(k == 4, "review"), "bridge_from": F.when(k == 5, "basics")})
    return L.next_action(t).select("session_id", "turn", "cause", "action")


@add(f"with {_TURNS}, c as (select *, case when turn % 3 = 0 then null else 'c' || (turn % 4)::varchar end as concept from tu) select session_id, max(turn) + 1 as next_turn, arg_max(action, turn) as last_action, arg_max(concept, turn) filter (where concept is not null) as last_concept from c group by session_id")
def latest_sessions(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("concept", F.when(F.col("turn") % 3 != 0, F.concat(F.lit("c"), (F.col("turn") % 4).cast("string"))))
    return L.latest_session(t)


@add("""with cs as (select event_type as concept, (row_number() over (order by event_type) - 1)::int as place from (select distinct event_type from events)), u as (select distinct user_id from events)
    select user_id, concept, ((date '2026-01-01' + (place // 2)::int)::date)::varchar as due, 30::int as minutes from u, cs""")
def study_plan(spark, sf_dir):
    return L.study_plan(_paths(spark, sf_dir), F.lit("2026-01-01").cast("date")).select("user_id", "concept", F.col("date").cast("string").alias("due"), "minutes")


@add(f"with {_STATE} select user_id, concept, case when mastery < 0.6 then 'definition|explanation|example' when mastery < 0.8 then 'example|application|derivation' else 'derivation|proof|application' end as roles from state")
def role_sequences(spark, sf_dir):
    return _state(spark, sf_dir).select("user_id", "concept", F.array_join(L.role_sequence(L.level(F.col("mastery"))), "|").alias("roles"))


@add("select conv_id, turn, case when lower(trim(role)) in ('user', 'assistant') then lower(trim(role)) else 'unknown' end as role from conversations")
def sanitised_labels(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", L.sanitised(F.col("role"), ["user", "assistant"], "unknown").alias("role"))


@add(f"with {_STATE} select user_id, concept, mastery, attempts, correct from state")
def streamed_mastery(spark, sf_dir):
    """The stream over a finished folder gives the batch's state."""
    answers = _answers(S.read_events(spark, f"{sf_dir}/events.parque[t]"))
    with S.rocksdb(spark):
        out = S.run_once(S.mastery_stream(answers), shared_path(spark, "stream"), "update")
    last = out.groupBy("user_id", "concept").agg(F.max_by(F.struct("mastery", "attempts", "correct"), "batch").alias("s"))
    return last.select("user_id", "concept", F.round("s.mastery", 6).alias("mastery"), "s.attempts", "s.correct")


@add(f"with {_STATE} select user_id, concept, mastery, attempts, correct from state")
def late_mastery(spark, sf_dir):
    """The stream that waits for late answers, over a finished folder: the batch's state."""
    answers = _answers(S.read_events(spark, f"{sf_dir}/events.parque[t]"))
    with S.rocksdb(spark):
        out = S.run_once(S.late_mastery_stream(answers), shared_path(spark, "late-stream"), "update")
    # after its last batch a key may be told once more, when a timer settles it
    last = out.groupBy("user_id", "concept").agg(F.max_by(F.struct("mastery", "attempts", "correct"), F.struct("attempts", "batch")).alias("s"))
    return last.select("user_id", "concept", F.round("s.mastery", 6).alias("mastery"), "s.attempts", "s.correct")


@add("select date_trunc('hour', ts) as start, event_type, count(*) as events, round(avg(value), 4) as mean_value from events group by all")
def activity_windows(spark, sf_dir):
    return S.activity_windows(table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 4))


@add("""with o as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts) as k from o)
    select user_id, min(ts) as start, max(ts) + interval 30 minutes as stop, count(*) as events from s group by user_id, k""")
def study_sessions(spark, sf_dir):
    return S.study_sessions(table(spark, sf_dir, "events"))


_PLAN = f"pl as (select distinct conv_id as session_id, turn, {_sql_pick(_AFFECTS, 'conv_id + turn')} as affect, {_sql_pick(_INTENTS, 'conv_id * 2 + turn')} as intent, {_sql_pick([n for n, _, _ in rules.LEVELS], 'turn')} as level from conversations)"


@add(f"""with {_PLAN} select session_id, turn, case when affect in ('confused', 'frustrated') then 'hint' when intent = 'answer' then 'reflect' else 'explain' end as intended_action,
    case level when 'beginner' then 'definition|explanation|example' when 'proficient' then 'example|application' else 'derivation|application' end as pedagogy_focus, case level when 'beginner' then 'intermediate' else 'advanced' end as difficulty_cap from pl""")
def rule_plans(spark, sf_dir):
    c, t = F.col("session_id"), F.col("turn")
    turns = _turns(spark, sf_dir).withColumns({"affect": _pick(_AFFECTS, c + t), "intent": _pick(_INTENTS, c * 2 + t), "level": _pick([n for n, _, _ in rules.LEVELS], t)})
    return L.rule_plan(turns).select("session_id", "turn", "intended_action", F.array_join("pedagogy_focus", "|").alias("pedagogy_focus"), "difficulty_cap")


@add("""with s as (select distinct conv_id as session_id, turn, step, (array['explain', 'ask', 'hint'])[(turn + step) % 3 + 1] as action, case when step % 2 = 0 then (turn + step) % 10 / 10.0::double end as confidence, ['c' || (step // 2)::varchar, 'c' || ((turn + step) % 4)::varchar] as ids from conversations, range(6) r(step)), u as (select * from s where step < 4),
    i as (select session_id, turn, x, min(step * 10 + p) as o from (select session_id, turn, step, unnest(ids) as x, unnest(range(2)) as p from u) group by all), j as (select session_id, turn, string_agg(x, '|' order by o) as chunk_ids from i group by all)
    select session_id, turn, round(coalesce(avg(confidence), 0.6), 6) as confidence, arg_max(action, step) as last_action, any_value(chunk_ids) as chunk_ids from u join j using (session_id, turn) group by session_id, turn""")
def combined_steps(spark, sf_dir):
    s = _turns(spark, sf_dir).drop("action").withColumn("step", F.explode(F.array(*map(F.lit, range(6)))))
    n = F.col("turn") + F.col("step")
    ids = F.array(F.concat(F.lit("c"), F.floor(F.col("step") / 2).cast("string")), F.concat(F.lit("c"), (n % 4).cast("string")))
    s = s.select("session_id", "turn", "step", _pick(["explain", "ask", "hint"], n).alias("action"), F.when(F.col("step") % 2 == 0, n % 10 / 10.0).alias("confidence"), ids.alias("chunk_ids"))
    return L.combine_steps(s).withColumn("chunk_ids", F.array_join("chunk_ids", "|"))
