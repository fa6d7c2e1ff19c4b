"""Queries of tutor turns without a model: focus, responses, records, assessments, request checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import quality
from ..operators import tutoring as U
from .inputs import _quoted, sql_any, table
from .registry import Registry
from .reward_queries import _ids, _pick, _sp

REGISTRY = Registry()
add = REGISTRY.add
_STRIP = "regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
ACTIONS = ["question", "worked_example", "review", "explain", "reflect"]
CONCEPTS = [" heat", "gradient", None, "flux", "", "tensor"]
LEVELS = ["beginner", "developing", "proficient", None]
KINDS = {None: "Question", "multiple_choice": "Multiple Choice", "": "Question", "short answer": "Short Answer"}
HARD = ["very_easy", None, "hard", ""]
PATH = ["heat", "flux", "gradient", "tensor"]


def _turns(spark, sf_dir):
    """A turn of a conversation with its retrieved chunks: thirds of its whole text, some blank, some without id."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("n", F.col("conv_id") + 3 * F.col("turn"))
    n, body = F.col("n"), F.coalesce("text", F.lit(""))
    third = F.floor((F.length(body) + 2) / 3).cast("int")
    cid = lambda i: F.when((n + i) % 5 == 0, F.lit(None).cast("string")).when((n + i) % 11 == 0, "").otherwise(F.concat(F.lit("c"), (n + i).cast("string")))
    cut = lambda i: F.when((n + i) % 7 == 0, "  ").otherwise(F.substring(body, F.lit(i) * third + 1, third))
    each = F.array(*(F.struct(cid(i).alias("id"), cut(i).alias("snippet")) for i in range(3)))
    known = F.map_from_arrays(F.array(*map(F.lit, PATH)), F.array(*(((n * (k + 3)) % 100) / 100.0 for k in range(len(PATH)))))
    return t.select(
        "conv_id", "turn", "n", "text", _pick(ACTIONS, n).alias("action"), _pick(CONCEPTS, F.floor(n / 2)).alias("concept"), F.coalesce(_pick(LEVELS, n), F.lit("beginner")).alias("level"), _pick(list(KINDS), F.floor(n / 3)).alias("question_type"),
        _pick(HARD, F.floor(n / 4)).alias("difficulty"), F.slice(each, 1, (n % 4).cast("int")).alias("chunks"), known.alias("known"), F.array(*map(F.lit, PATH)).alias("path"), F.array(F.lit(""), _pick(["entropy", None], n)).alias("fallback"),
    )


def _list(values):
    return "[" + ", ".join("null" if v is None else _quoted(v) for v in values) + "]"


_TURNS = f"""g as (select conv_id, turn, min(text) as text, conv_id + 3 * turn as n from conversations group by conv_id, turn),
    t as (select *, {_sp(ACTIONS, 'n')} as action, {_sp(CONCEPTS, 'n // 2')} as concept, coalesce({_sp(LEVELS, 'n')}, 'beginner') as level, {_sp(list(KINDS), 'n // 3')} as question_type, {_sp(HARD, 'n // 4')} as difficulty, {_list(PATH)} as path,
        list_transform(range(0, n % 4), lambda i: {{'id': case when (n + i) % 5 = 0 then null when (n + i) % 11 = 0 then '' else 'c' || (n + i)::varchar end, 'snippet': case when (n + i) % 7 = 0 then '  ' else substring(coalesce(text, ''), i * ((length(coalesce(text, '')) + 2) // 3) + 1, (length(coalesce(text, '')) + 2) // 3) end}}) as chunks,
        [{', '.join(f'(n * {k + 3}) % 100 / 100.0::double' for k in range(len(PATH)))}] as mastery, ['', {_sp(['entropy', None], 'n')}] as fallback, nullif(trim(coalesce({_sp(CONCEPTS, 'n // 2')}, '')), '') as asked from g)"""


@add(f"""with {_TURNS}, f as (select *, list_filter(path, lambda c: mastery[list_position(path, c)] < {rules.PATH_MASTERED}::double)[1] as open, list_filter(fallback, lambda c: coalesce(c, '') <> '')[1] as other,
      case when asked is not null and coalesce(mastery[list_position(path, asked)], 0) < {rules.PRIMARY_MASTERED}::double then asked end as mine from t)
    select conv_id, turn, coalesce(mine, open, other, asked, path[1]) as focus, coalesce(case when list_contains(path, asked) and n % 3 = 0 then case when n % 2 = 0 then 'flux' end end, open, asked, path[1]) as focus_ready from f""")
def focus_concepts(spark, sf_dir):
    n = F.col("n")
    plain = U.focus(F.col("concept"), F.col("path"), F.col("known"), F.col("fallback"))
    ready = U.focus_with_prerequisites(F.col("concept"), F.col("path"), F.col("known"), n % 3 != 0, F.when(n % 2 == 0, "flux"))
    return _turns(spark, sf_dir).select("conv_id", "turn", plain.alias("focus"), ready.alias("focus_ready"))


_FLAT = _STRIP.format("regexp_replace(s, '[ \\t\\n\\r\\f]+', ' ', 'g')")
_SHORT = f"case when length({_FLAT}) <= 140 then {_FLAT} else regexp_extract({_FLAT}, '^(.{{0,139}})(?: |$)', 1) || '…' end"
_TITLE = "case coalesce(question_type, '') " + " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in KINDS.items() if k is not None) + " end"
_NL = "chr(10)"


def _sql_text(text: str) -> str:
    return " || chr(10) || ".join(map(_quoted, text.split("\n")))


@add(f"""with {_TURNS}, l as (select *, list_filter(list_transform(chunks, lambda c, i: case when {_STRIP.format('c.snippet')} <> '' then '[Chunk ' || i::varchar || ' | ' || coalesce(nullif(c.id, ''), '?') || '] ' || {_STRIP.format('c.snippet')} end), lambda x: x is not null) as lines,
        list_filter(list_transform(list_slice(chunks, 1, 3), lambda c: left({_STRIP.format('c.snippet')}, 160)), lambda s: s <> '') as sn from t),
    b as (select *, {_STRIP.format(f"split_part(coalesce(lines[1], ''), {_NL}, 1)")} as head, len(lines) > 0 as has, {_STRIP.format("coalesce(chunks[1].snippet, '')")} as top, trim(replace(coalesce(difficulty, ''), '_', ' ')) as hard from l),
    h as (select *, {_TITLE} || ' for ' || coalesce(asked, 'this concept') || case when hard <> '' then ' (' || hard || ')' else '' end as header, case when len(sn) > 0 then sn else ['Revisit the core definition of ' || coalesce(asked, 'our topic') || '.', {_quoted(rules.REVIEW_HINT)}] end as items from b)
    select conv_id, turn, case action
        when 'question' then case when has then header || ':' || {_NL} || head || {_NL} || 'What step should come next?' else header || ': Let''s recall one key fact about ' || coalesce(asked, 'this concept') || '.' end
        when 'worked_example' then case when has then 'Let''s step through a worked example on ' || coalesce(asked, 'this concept') || '.' || {_NL} || 'Given: ' || head else 'Let''s outline a worked example for ' || coalesce(asked, 'this concept') || ' even without detailed context.' end || {_NL} || {f" || {_NL} || ".join(map(_quoted, rules.EXAMPLE_STEPS))}
        when 'review' then 'Quick review for ' || coalesce(asked, 'our topic') || ' (' || level || ' level):' || {_NL} || array_to_string(list_transform(items, lambda s: '- ' || {_SHORT}), {_NL})
        else case when len(chunks) = 0 then {_quoted(rules.NO_CHUNKS)} when top <> '' then {_sql_text(rules.SNIPPET_BEFORE)} || top || {_sql_text(rules.SNIPPET_AFTER)} else {_quoted(rules.NO_SNIPPET)} end end as response,
      case action when 'question' then case when has then 0.7 else 0.6 end when 'worked_example' then case when has then 0.65 else 0.55 end when 'review' then case when len(chunks) > 0 then 0.6 else 0.5 end else case when len(chunks) > 0 then {rules.SNIPPET_CONFIDENCE} else 0.2 end end::double as confidence,
      array_to_string(list_filter(list_transform(chunks, lambda c: c.id), lambda i: coalesce(i, '') <> ''), '|') as source_ids from h""")
def tutor_responses(spark, sf_dir):
    return U.respond(_turns(spark, sf_dir)).select("conv_id", "turn", "response", "confidence", F.array_join("source_ids", "|").alias("source_ids"))


@add(f"select conv_id, turn, text, {sql_any('lower(coalesce(text, chr(32)))', rules.AGREEMENT)} as correct, case when {sql_any('lower(coalesce(text, chr(32)))', rules.AGREEMENT)} then 0.8 else 0.4 end::double as quality from (select conv_id, turn, case when (conv_id + turn) % 3 = 0 then 'That is Right: ' else '' end || coalesce(text, '') as text from conversations)")
def student_assessments(spark, sf_dir):
    said = F.concat(F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "That is Right: ").otherwise(""), F.coalesce("text", F.lit("")))
    right, quality_ = U.assessment(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text")).select("conv_id", "turn", "text", right.alias("correct"), quality_.alias("quality"))


@add("""with e as (select event_type as concept, case user_id % 3 when 0 then 'easy' when 1 then 'hard' end as difficulty, (user_id % 2)::varchar as context_type, event_id as seq, value % 1 as relevance, (event_id % 10) / 10.0::double as confidence from events),
    k as (select *, row_number() over (partition by concept, difficulty, context_type order by seq) as r from e where relevance >= 0.6 and confidence >= 0.5) select concept, difficulty, context_type, seq, 'example ' || seq::varchar as example, relevance, confidence from k where r = 1""")
def accepted_examples(spark, sf_dir):
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("concept"), F.when(u % 3 == 0, "easy").when(u % 3 == 1, "hard").alias("difficulty"), (u % 2).cast("string").alias("context_type"), F.lit("general").alias("student_background"), F.lit("").alias("prerequisites"),
        F.lit("").alias("avoided"), F.col("event_id").alias("seq"), F.concat(F.lit("example "), F.col("event_id").cast("string")).alias("example"), (F.col("value") % 1).alias("relevance"), (F.col("event_id") % 10 / 10.0).alias("confidence"),
    )
    return U.accepted_examples(e).select("concept", "difficulty", "context_type", "seq", "example", "relevance", "confidence")


def _observed(spark, sf_dir):
    n = F.col("n")
    return _turns(spark, sf_dir).select(
        n.alias("seq"), F.col("text").alias("message"), F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("user_id"), F.when(n % 3 != 0, F.array("concept")).alias("target_concepts"), F.when(n % 4 != 0, F.lit("question")).alias("intent"),
        F.when(n % 5 != 0, F.lit("engaged")).alias("affect"), "concept", (n % 15 / 10.0).alias("classifier_confidence"), F.col("concept").alias("focus_concept"), F.when(n % 4 != 1, F.col("level")).alias("concept_level"), F.col("path").alias("learning_path"),
        F.col("chunks"), F.lit(None).cast("array<string>").alias("source_chunk_ids"), F.when(n % 2 == 0, F.array(F.lit("definition"))).alias("roles"), F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "action", F.lit(0.5).alias("confidence"), (n % 9 == 0).alias("cold_start"),
    )


@add(f"""with {_TURNS} select n as seq, coalesce(text, '') as message, 'u' || conv_id::varchar as user_id, case when n % 3 <> 0 then coalesce(concept, '') else '' end as target_concepts, case when n % 4 <> 0 then 'question' else 'unknown' end as intent,
    case when n % 5 <> 0 then 'engaged' else 'neutral' end as affect, concept as focus_concept, case when n % 4 <> 1 then level else 'beginner' end as concept_level, array_to_string(list_filter(list_transform(chunks, lambda c: c.id), lambda i: i is not null), '|') as chunk_ids,
    case when n % 2 = 0 then 'definition' else '' end as pedagogy_roles from t""")
def simplified_records(spark, sf_dir):
    """Nested observations are built from the turns, then put in their flat form."""
    s = U.simplified(U.observations(_observed(spark, sf_dir)))
    return s.withColumns({c: F.array_join(c, "|") for c in ("target_concepts", "chunk_ids", "pedagogy_roles")})


@add("""with e as (select user_id as session_id, event_id as turn_index, event_type as action, (event_id % 100) / 100.0::double as mastery from events)
    select session_id, row_number() over w::int as step, turn_index, action, mastery, round(mastery - coalesce(lag(mastery) over w, 0), 6) as change from e window w as (partition by session_id order by turn_index)""")
def step_timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_index"), F.col("event_type").alias("action"), (F.col("event_id") % 100 / 100.0).alias("mastery"))
    return U.step_timeline(e)


_AGENTS = [*rules.AGENT_KEYS, "other"]


@add(f"""with p as (select conv_id, turn, {_sp(_AGENTS, 'conv_id + turn')} as agent, case when turn % 2 = 0 then coalesce(text, '') end as message, case when turn % 3 = 0 then 'u1' end as user_id, case conv_id % 3 when 0 then 'why' when 1 then '' end as question, case when conv_id % 2 = 0 then 'heat' end as concepts, md5(conv_id::varchar) as h from conversations),
    k as (select *, list_filter(case agent {' '.join(f"when '{a}' then {_list(ks)}" for a, ks in rules.AGENT_KEYS.items() if ks)} else [] end, lambda x: coalesce(case x when 'message' then message when 'user_id' then user_id when 'question' then question when 'concepts' then concepts end, '') = '') as missing,
      case when conv_id % 4 = 0 then h else ' ' || upper(left(h, 8)) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] end as raw from p)
    select conv_id, turn, agent, array_to_string(missing, '|') as missing, case when regexp_matches(lower(trim(raw)), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') then trim(raw) end as resource_id from k""")
def payload_checks(spark, sf_dir):
    """Keys that a request to an agent lacks, and its resource's id if that is a UUID."""
    c, t = F.col("conv_id"), F.col("turn")
    values = {"message": F.when(t % 2 == 0, F.coalesce("text", F.lit(""))), "user_id": F.when(t % 3 == 0, "u1"), "question": F.when(c % 3 == 0, "why").when(c % 3 == 1, ""), "concepts": F.when(c % 2 == 0, "heat")}
    payload = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    h = F.md5(c.cast("string").cast("binary"))
    raw = F.when(c % 4 == 0, h).otherwise(F.concat(F.lit(" "), F.upper(F.left(h, F.lit(8))), *(F.concat(F.lit("-"), F.substring(h, a, n)) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _pick(_AGENTS, c + t).alias("agent"), payload.alias("payload"), raw.alias("raw"))
    return rows.select("conv_id", "turn", "agent", F.array_join(quality.missing_keys(F.col("agent"), F.col("payload")), "|").alias("missing"), quality.valid_uuid(F.col("raw")).alias("resource_id"))


@add("""with p as (select case when event_id % 6 = 0 then '{}' when event_id % 7 = 0 then '[1]' when event_id % 11 = 0 then '{bad' else props end as tags from events)
    select count(*) as total, count(*) filter (where json_valid(tags) and json_type(tags) = 'OBJECT') as valid_json, count(*) filter (where json_valid(tags) and json_type(tags) = 'OBJECT' and len(json_keys(tags)) = 0) as empty_tags from (select case when json_valid(tags) then tags end as tags, tags as raw from p where tags is not null)""")
def tag_structure(spark, sf_dir):
    i = F.col("event_id")
    tags = F.when(i % 6 == 0, "{}").when(i % 7 == 0, "[1]").when(i % 11 == 0, "{bad").otherwise(F.col("props"))
    return quality.tag_structure(table(spark, sf_dir, "events").select(tags.alias("tags")))


@add("select doc_id, source from documents order by md5(doc_id::varchar || ':42'), doc_id limit 25")
def seeded_sample(spark, sf_dir):
    """A sample is the feature here: 25 documents for a reader."""
    return quality.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 25, 42)


@add("""with q as (select item_id as query_id, lower(array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 2, 2), ' ')) as text from benchmark), h as (select query_id, doc_id as chunk_id, left(d.text, 300) as snippet, 1.0::double as score, row_number() over (partition by query_id order by doc_id)::int as rank
    from q join documents d on q.text <> '' and contains(lower(d.text), q.text)) select * from h where rank <= 10""")
def substring_mode(spark, sf_dir):
    """Search without vectors or an index: the first chunks by id that hold the question's second word."""
    from ..operators import retrieval as R

    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 2, 1), " ")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("text"))
    return R.substring_search(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("full_text")), 10)
