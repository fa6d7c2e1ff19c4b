"""Queries of text functions, chunking and tag statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators.similar import known_forms
from ..operators import chunking, quality
from .inputs import CHUNKS_SQL, SENTENCES_SQL, _quoted, chunks, sentences, sql_any, sql_ladder, table
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add
_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
PACK = 60


@add(f"with {SENTENCES_SQL} select doc_id, pos, sentence from s")
def sentence_split(spark, sf_dir):
    return sentences(spark, sf_dir)


@add(f"select doc_id, greatest(len({_WORDS.format('coalesce(text, chr(32))')}), 1)::int as tokens from documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.coalesce("text", F.lit(""))).alias("tokens"))


@add(f"""with recursive {SENTENCES_SQL}, n as (select *, len({_WORDS.format('sentence')})::int as n from s),
    f as (select doc_id, pos, sentence, n as tokens, 0 as idx from n where pos = 0
      union all select n.doc_id, n.pos, n.sentence, case when f.tokens + n.n > {PACK} then n.n else f.tokens + n.n end, case when f.tokens + n.n > {PACK} then f.idx + 1 else f.idx end from f join n on n.doc_id = f.doc_id and n.pos = f.pos + 1)
    select doc_id, idx::int as idx, string_agg(sentence, ' ' order by pos) as chunk from f group by doc_id, idx""")
def token_packing(spark, sf_dir):
    return chunking.split_documents(table(spark, sf_dir, "documents"), PACK)


_UNITS = f"""cut as (select doc_id, coalesce(text, '') as page, unnest(range(length(coalesce(text, '')) // 700 + 1)) as k from documents),
    units as (select doc_id * 1000000 + k as unit_id, page, (k * 700 - case when k % 9 = 8 then 10000 else 0 end)::int as start, (k * 700 + case when k % 5 = 4 then 8 else 690 end)::int as stop, (array['concept_intro', 'derivation', 'example', 'summary', null])[(doc_id + k) % 5 + 1] as kind, (doc_id + k) as n from cut)"""


def _units(spark, sf_dir):
    """Spans of 690 characters every 700, some too short, some before their page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("page"))
    k = F.col("k")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.length("page") / 700).cast("int"))))
    kinds = F.array(*map(F.lit, ["concept_intro", "derivation", "example", "summary", None]))
    return d.select(
        (F.col("doc_id") * 1_000_000 + k).alias("unit_id"), "page", (k * 700 - F.when(k % 9 == 8, 10_000).otherwise(0)).cast("int").alias("start"), (k * 700 + F.when(k % 5 == 4, 8).otherwise(690)).cast("int").alias("stop"),
        F.element_at(kinds, ((F.col("doc_id") + k) % 5 + 1).cast("int")).alias("kind"), (F.col("doc_id") + k).alias("n"),
    )


_MOST = "case coalesce(kind, '') " + " ".join(f"when '{k}' then {v[1]}" for k, v in rules.SIZE_LIMITS.items()) + f" else {rules.SIZE_DEFAULT[1]} end"
_TEXT = "regexp_replace(substring(page, start + 1, stop - start), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_CUT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])[ \t\n\r\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '')"


@add(f"""with recursive {_UNITS}, u as (select unit_id, start, kind, {_TEXT} as text, {_MOST} as most from units where stop > start and start >= 0), k as (select *, len({_WORDS.format('text')}) as words from u where length(text) >= 20),
    s as (select unit_id, most, unnest(l) as sentence, unnest(range(len(l)))::int as pos from (select unit_id, most, {_CUT} as l from k where words > most)), n as (select *, len({_WORDS.format('sentence')})::int as n from s),
    f as (select unit_id, pos, sentence, n as tokens, 0 as idx from n where pos = 0
      union all select n.unit_id, n.pos, n.sentence, case when f.tokens + n.n > n.most then n.n else f.tokens + n.n end, case when f.tokens + n.n > n.most then f.idx + 1 else f.idx end from f join n on n.unit_id = f.unit_id and n.pos = f.pos + 1),
    p as (select unit_id, idx::int as idx, string_agg(sentence, ' ' order by pos) as chunk from f group by unit_id, idx),
    o as (select unit_id, idx, chunk, coalesce(sum(length(chunk)) over (partition by unit_id order by idx rows between unbounded preceding and 1 preceding), 0) as begin from p union all select unit_id, 0, text, 0 from k where words <= most)
    select unit_id, idx, (start + begin)::int as source_offset, len({_WORDS.format('chunk')})::int as token_count, false as has_equation, coalesce(kind, 'unknown') as content_type, left(chunk, 300) as text_snippet, chunk as full_text from o join k using (unit_id)""")
def unit_chunks(spark, sf_dir):
    return chunking.unit_chunks(_units(spark, sf_dir), chunking.ChunkPlan(preserve_formulas=False))


@add()
def planned_chunks(spark, sf_dir):
    """All a plan can add: formulas kept whole, tags, formula bodies."""
    c = chunking.unit_chunks(_units(spark, sf_dir), chunking.ChunkPlan(tags=True, formulas=True))
    return c.withColumn("formulas", F.array_join("formulas", "|"))


_ROLE = sql_ladder("lower(full_text)", rules.ROLE_LADDER, sql_ladder("lower(section_title)", rules.ROLE_TITLE_LADDER, _quoted(rules.ROLE_DEFAULT)))
_CLAMPED = f"""c as (select unit_id as span_id, greatest(0, least(start, length(page) - 1)) as low, page, stop, case when n % 3 = 0 then 'Summary' else '' end as section_title from units where stop > 0 and stop > start and {_TEXT.replace('substring(page, start + 1, stop - start)', 'page')} <> ''),
    h as (select *, greatest(low + 1, least(stop, length(page))) as high from c), x as (select *, regexp_replace(substring(page, low + 1, high - low), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') as full_text from h)"""


@add(f"with {_UNITS}, {_CLAMPED} select span_id, low::int as source_offset, len({_WORDS.format('full_text')})::int as token_count, {_ROLE} as pedagogy_role, left(full_text, 300) as text_snippet, full_text from x where length(full_text) >= 20")
def structural_chunks(spark, sf_dir):
    spans = _units(spark, sf_dir).withColumnRenamed("unit_id", "span_id").withColumn("section_title", F.when(F.col("n") % 3 == 0, "Summary").otherwise(""))
    return chunking.structural_chunks(spans)


_CONTENT = sql_ladder("lower(full_text)", rules.CONTENT_LADDER, f"case when {sql_any(f'left(lower(full_text), {rules.CONTENT_INTRO_CHARS})', rules.CONTENT_INTRO)} then 'concept_intro' else 'unknown' end")


@add(f"with {CHUNKS_SQL} select chunk_id, {_ROLE} as role, {_CONTENT} as content_type from chunks")
def chunk_roles(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", T.pedagogy_role(F.col("full_text"), F.col("section_title")).alias("role"), T.content_type(F.col("full_text")).alias("content_type"))


_LATEX = "list_concat(" * (len(rules.LATEX_PATTERNS) - 1) + f"regexp_extract_all(full_text, {_quoted(rules.LATEX_PATTERNS[0])}, 1)" + "".join(f", regexp_extract_all(full_text, {_quoted(p)}, 1))" for p in rules.LATEX_PATTERNS[1:])
_STRIPPED = "list_filter(list_transform({0}, lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), lambda x: x <> '')"


@add(f"with {CHUNKS_SQL} select distinct chunk_id, f as formula, {sql_ladder('f', rules.FORMULA_LADDER, _quoted('algebraic'))} as kind, left(sha256(doc_id::varchar || ':' || f), 16) as formula_id from (select chunk_id, doc_id, unnest({_STRIPPED.format(_LATEX)}) as f from chunks)")
def formula_types(spark, sf_dir):
    found = chunks(spark, sf_dir).where("full_text rlike '[$\\\\\\\\]'").select("chunk_id", "doc_id", F.explode(T.latex_formulas(F.col("full_text"))).alias("formula"))
    return found.select("chunk_id", "formula", T.formula_type(F.col("formula")).alias("kind"), F.left(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "formula"), 256), F.lit(16)).alias("formula_id"))


_PLAIN = "regexp_replace(formula, '" + "|".join(r"\\" + f for f in sorted(rules.LATEX_FUNCTIONS, key=len, reverse=True)) + "', '', 'g')"
_PARTS = f"list_zip({', '.join(f'regexp_extract_all({_PLAIN}, {_quoted(rules.VARIABLE)}, {g})' for g in (1, 2, 3))})"
_NO_NAME = "[" + ", ".join(map(_quoted, [*rules.LATEX_FUNCTIONS, *rules.GREEK, *(g.capitalize() for g in rules.GREEK)])) + "]"
_VARIABLES = f"list_sort(list_distinct(list_transform(list_filter({_PARTS}, lambda v: length(v[1]) <= 3 and not list_contains({_NO_NAME}, v[1])), lambda v: v[1] || case when coalesce(v[2], '') <> '' then '_' || v[2] else '' end || case when coalesce(v[3], '') <> '' then '^' || v[3] else '' end)))"


@add(f"with {CHUNKS_SQL}, f as (select unnest(list_distinct({_STRIPPED.format(_LATEX)})) as formula from chunks), u as (select formula, count(*) as uses from f group by formula) select formula, uses, array_to_string({_VARIABLES}, '|') as variables from u")
def formula_variables(spark, sf_dir):
    found = chunks(spark, sf_dir).where("full_text rlike '[$\\\\\\\\]'").select(F.explode(T.latex_formulas(F.col("full_text"))).alias("formula")).groupBy("formula").agg(F.count("*").alias("uses"))
    return found.select("formula", "uses", F.array_join(T.variables(F.col("formula")), "|").alias("variables"))


_BLOOM = "greatest(2, " + ", ".join(f"case when {sql_any('low', p)} then {n} else 0 end" for n, p in rules.BLOOM.items()) + ")"
_ABSTRACT = " + ".join(f"contains(low, '{w}')::int" for w in rules.ABSTRACT_WORDS)


@add(f"""with {CHUNKS_SQL}, t as (select *, lower(full_text) as low, len(list_distinct({_STRIPPED.format(_LATEX)})) as formulas, len({_WORDS.format('full_text')}) as words from tagged)
    select chunk_id, {_BLOOM}::int as bloom_level, {sql_ladder('low', rules.MATH_LEVELS[::-1], _quoted('none'))} as math_level, ({_ABSTRACT})::int as abstract_words, trunc(5 + words / 200.0::double + 2 * formulas + 2 * {_BLOOM} + len(prerequisites))::int as study_minutes from t""")
def complexity(spark, sf_dir):
    c, text = chunks(spark, sf_dir), F.col("full_text")
    return c.select("chunk_id", T.bloom_level(text).alias("bloom_level"), T.math_level(text).alias("math_level"), T.abstract_words(text).alias("abstract_words"), T.study_minutes(text, F.size(T.latex_formulas(text)), F.size("prerequisites")).alias("study_minutes"))


_POINTS = "list_sum(list_transform(fs, lambda f: case " + " ".join(f"when {sql_ladder('f', rules.FORMULA_LADDER, _quoted('algebraic'))} = '{k}' then {v}" for k, v in rules.FORMULA_POINTS.items()) + " else 0 end))"
_SCORE = f"(least(len(fs) * 5, 30) + coalesce({_POINTS}, 0) + least(len(prerequisites) * 5, 25) + least(10 * len(list_filter(key_concepts, lambda c: {sql_any('c', rules.ABSTRACT_CONCEPTS)})), 20) + {sql_ladder('lower(full_text)', rules.MATH_POINTS, '5')})::int"


@add(f"""with {CHUNKS_SQL}, t as (select *, list_distinct({_STRIPPED.format(_LATEX)}) as fs from tagged), q as (select chunk_id, {_SCORE} as score from t)
    select chunk_id, score, case when score < 30 then 'introductory' when score < 60 then 'intermediate' else 'advanced' end as difficulty from q""")
def difficulty(spark, sf_dir):
    c = chunks(spark, sf_dir)
    kinds = F.transform(T.latex_formulas(F.col("full_text")), T.formula_type)
    scored = c.select("chunk_id", T.difficulty_score(F.col("full_text"), kinds, F.col("prerequisites"), F.col("key_concepts")).alias("score"))
    return scored.withColumn("difficulty", T.difficulty(F.col("score")))


def _refs_sql(kind: int) -> str:
    _, written, patterns = rules.REFERENCES[kind]
    hits = "[]::varchar[]"
    for p in patterns:
        hits = f"list_concat({hits}, regexp_extract_all(full_text, {_quoted(p)}, 1))"
    return f"array_to_string(list_sort(list_distinct(list_transform({hits}, lambda h: {_quoted(written)} || h))), '|')"


@add(f"with {CHUNKS_SQL} select chunk_id, " + ", ".join(f"{_refs_sql(k)} as {r[0]}" for k, r in enumerate(rules.REFERENCES)) + " from chunks")
def cross_references(spark, sf_dir):
    found = chunks(spark, sf_dir).select("chunk_id", T.cross_references(F.col("full_text")).alias("r"))
    return found.select("chunk_id", *(F.array_join(f"r.{kind}", "|").alias(kind) for kind, _, _ in rules.REFERENCES))


@add("""with n as (select doc_id, coalesce(text, '') as name from documents)
    select doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(name, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'))), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) as canonical from n""")
def canonical_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical_name(F.coalesce("text", F.lit(""))).alias("canonical"))


_NAMES = ["FFT", " ode ", "Heat Xfer", "thermal  transfer", "Fourier’s law", "heat conduction", "Fourier Laws", "page 12", "1234", "iv", "(cid:7)", "Theory", "a+b=c*d!", "Boundary layer", "x", "Section 2", "20°C"]
_KNOWN = {v.lower(): sorted(g)[0] for g in rules.SYNONYMS for v in g}


@add(f"""with q as (select p_partkey, unnest([p_name, ([{', '.join(map(_quoted, _NAMES))}])[p_partkey % {len(_NAMES)} + 1]]) as name from part), s as (select *, regexp_replace(regexp_replace(regexp_replace(name, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), '[‘’′]', chr(39), 'g') as sq from q)
    select p_partkey, name, case upper(trim(name)) {' '.join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in rules.ACRONYMS.items())} else case lower(sq) {' '.join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in _KNOWN.items())} else sq end end as form,
      (length(trim(name)) < 3 or regexp_matches(lower(trim(name)), {_quoted('|'.join(rules.NOISE_PATTERNS))}) or lower(trim(name)) in ({', '.join(map(_quoted, rules.GENERIC_TERMS))}) or length(name) > 100 or length(regexp_replace(name, '[\\p{{L}}\\p{{N}} ,-]', '', 'g')) > length(name) // 3) as noise from s""")
def concept_forms(spark, sf_dir):
    """Every part's name, and one of the fixed names by its number."""
    return _concept_names(spark, sf_dir).select("p_partkey", "name", T.synonym(F.col("name")).alias("form"), T.is_noise_concept(F.col("name")).alias("noise"))


def _concept_names(spark, sf_dir):
    other = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array("p_name", other)).alias("name"))


@add()
def fuzzy_concepts(spark, sf_dir):
    """Known forms first, then the form most alike, else the name."""
    names = _concept_names(spark, sf_dir).select("name").distinct()
    forms = spark.createDataFrame([(min(group).lower(),) for group in rules.SYNONYMS], "form string")
    named = {min(group).lower(): min(group) for group in rules.SYNONYMS}
    spelt = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    found = known_forms(names, forms).select("name", F.try_element_at(spelt, F.col("form")).alias("like"))
    return found.select("name", F.coalesce(T.known_form(F.col("name")), F.col("like"), T.squeezed(F.col("name"))).alias("form"))


@add(f"with {CHUNKS_SQL} select chunk_id, left(full_text, 300) as snippet, 1.0::double as score from chunks where full_text ilike '%gradient%' order by chunk_id limit 50")
def substring_search(spark, sf_dir):
    hits = chunks(spark, sf_dir).where(F.col("full_text").ilike("%gradient%"))
    return hits.select("chunk_id", F.left("full_text", F.lit(300)).alias("snippet"), F.lit(1.0).alias("score")).orderBy("chunk_id").limit(50)


@add("select event_id from events where props is null or props = '{}' or json_extract_string(props, '$.k') is null or json_extract_string(props, '$.k')::int < 5")
def untagged_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(F.col("props").isNull() | (F.col("props") == "{}") | k.isNull() | (k.cast("int") < 5)).select("event_id")


@add(f"""with {CHUNKS_SQL}, r as (select {_ROLE} as role from chunks) select count(*) as total, count(*) filter (where role <> 'explanation') as tagged,
    round(100.0::double * count(*) filter (where role <> 'explanation') / nullif(count(*), 0), 2) as pct from r""")
def tag_coverage(spark, sf_dir):
    roles = chunks(spark, sf_dir).select(T.pedagogy_role(F.col("full_text"), F.col("section_title")).alias("role"))
    return quality.tag_coverage(roles, F.col("role") != rules.ROLE_DEFAULT)


@add(f"with {CHUNKS_SQL}, r as (select {_ROLE} as role from chunks) select role, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as share from r group by role")
def role_distribution(spark, sf_dir):
    roles = chunks(spark, sf_dir).select(T.pedagogy_role(F.col("full_text"), F.col("section_title")).alias("role"))
    return quality.distribution(roles, "role")


@add(f"""with {CHUNKS_SQL}, t as (select doc_id, {_CONTENT} as content_type, len({_WORDS.format('full_text')}) as tokens, len({_STRIPPED.format(_LATEX)}) > 0 as formula from chunks)
    select content_type, count(*) as n, round(avg(tokens), 4) as mean_tokens, count(*) filter (where formula) as with_formula from t group by content_type""")
def chunk_metrics(spark, sf_dir):
    text = F.col("full_text")
    rows = chunks(spark, sf_dir).select(T.content_type(text).alias("content_type"), F.size(T.words(text)).alias("tokens"), (F.size(T.latex_formulas(text)) > 0).alias("formula"))
    return rows.groupBy("content_type").agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.count_if("formula").alias("with_formula"))


_BODY = r"\s+" + rules.NUMBER + r"\s*[:\-]?\s*([^.]+(?:\.[^.]+)?)"
_STRIP1 = "regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


def _captions_sql(pattern: str, word: str, kind: str) -> str:
    both = ", ".join(f"regexp_extract_all(full_text, {_quoted(pattern)}, {g})" for g in (1, 2))
    return f"select chunk_id, '{word}' || z[1] as label, {_STRIP1.format('z[2]')} as caption, {kind} as kind from (select chunk_id, unnest(list_zip({both})) as z from chunks)"


def _axis_sql(axis: str, group: int) -> str:
    first, second = (_STRIP1.format(f"regexp_extract(lower(caption), {_quoted(p)}, {g})") for p, g in ((axis + r"[- ]axis:?\s*([^,;.]+)", 1), (rules.VERSUS, group)))
    return f"case when kind = 'graph' then coalesce(nullif({first}, ''), nullif({second}, '')) end as {axis}"


@add(f"""with {CHUNKS_SQL}, f as ({_captions_sql(r"(?i)(?:Figure|Fig\.?)" + _BODY, "Figure ", sql_ladder("lower(z[2])", rules.FIGURE_KINDS, "'unknown'"))})
    select chunk_id, label, kind, {_axis_sql('x', 2)}, {_axis_sql('y', 1)} from f where kind <> 'table'""")
def figure_axes(spark, sf_dir):
    found = chunks(spark, sf_dir).select("chunk_id", F.explode(T.figures(F.col("full_text"))).alias("f")).where("f.kind <> 'table'")
    return found.select("chunk_id", "f.label", "f.kind", T.axes(F.col("f.caption"), F.col("f.kind")).alias("axes")).select("chunk_id", "label", "kind", "axes.x", "axes.y")


@add(f"""with {CHUNKS_SQL}, f as ({_captions_sql(r"(?i)(?:Figure|Fig\.?)" + _BODY, "Figure ", sql_ladder("lower(z[2])", rules.FIGURE_KINDS, "'unknown'"))} union all {_captions_sql("(?i)Table" + _BODY, "Table ", "'table'")})
    select chunk_id, label, caption, kind, array_to_string(list_slice(list_filter(regexp_extract_all(regexp_replace(caption, '[À-ÖØ-öø-ʯ]', '0', 'g'), '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda c: length(c) > 3), 1, 5), '|') as concepts from f""")
def figure_captions(spark, sf_dir):
    found = chunks(spark, sf_dir).select("chunk_id", F.explode(T.figures(F.col("full_text"))).alias("f"))
    return found.select("chunk_id", "f.label", "f.caption", "f.kind", F.array_join(T.caption_concepts(F.col("f.caption")), "|").alias("concepts"))


@add()
def semantic_chunks(spark, sf_dir):
    s = sentences(spark, sf_dir)
    # a vector per sentence stands in for a model: letter and length statistics
    s = s.withColumn("embedding", F.array(*(F.regexp_count("sentence", F.lit(f"[{c}]")).cast("float") for c in ("aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz", " .,;"))))
    return chunking.semantic_chunks(s, threshold=0.9)


@add()
def formula_positions(spark, sf_dir):
    return chunking.formulas(table(spark, sf_dir, "documents"))


@add()
def formula_aware_chunks(spark, sf_dir):
    return chunking.formula_aware_split(table(spark, sf_dir, "documents"), PACK)


@add(f"with {CHUNKS_SQL}, t as (select chunk_id, {_CONTENT} as kind from chunks) select chunk_id, case kind " + " ".join(f"when '{k}' then {v[0]}" for k, v in rules.SIZE_LIMITS.items()) + " else 100 end::int as least, case kind " + " ".join(f"when '{k}' then {v[1]}" for k, v in rules.SIZE_LIMITS.items()) + " else 300 end::int as most from t")
def chunk_limits(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", chunking.size_limits(T.content_type(F.col("full_text"))).alias("m")).select("chunk_id", "m.least", "m.most")


@add("""with d as (select doc_id, (doc_id % 7)::varchar || '. ' || (doc_id % 3)::varchar || '.' as number, left(coalesce(text, ''), 6000) as page from documents)
    select doc_id, array_to_string(list_filter(string_split(replace(number, ' ', ''), '.'), lambda x: x <> ''), '|') as path, length(page) as chars from d""")
def section_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat((F.col("doc_id") % 7).cast("string"), F.lit(". "), (F.col("doc_id") % 3).cast("string"), F.lit(".")).alias("number"), chunking.page_text(F.coalesce("text", F.lit(""))).alias("page"))
    return d.select("doc_id", F.array_join(T.section_path(F.col("number")), "|").alias("path"), F.length("page").cast("long").alias("chars"))


@add("""with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as rest, coalesce(html, '') as html from pages)
    select page_id, lower(split_part(rest, '/', 1)) as host, (octet_length(encode(html)) <= 104857600) as accepted, length(html) as chars from p""")
def upload_checks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("rest"), F.coalesce("html", F.lit("")).alias("html"))
    return p.select("page_id", F.lower(F.split_part("rest", F.lit("/"), F.lit(1))).alias("host"), (F.octet_length("html") <= 100 * 1024 * 1024).alias("accepted"), F.length("html").cast("long").alias("chars"))


@add("""with g as (select user_id, event_type, count(*) as attempts, count(*) filter (where value > 30) as correct from events group by all)
    select user_id, event_type as concept, attempts, correct, case when attempts > 0 then round(correct / attempts::double, 4) else 0.0::double end as correct_rate from g""")
def mastery_export(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("concept")).agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 30).alias("correct"))
    return g.withColumn("correct_rate", F.when(F.col("attempts") > 0, F.round(F.col("correct") / F.col("attempts"), 4)).otherwise(0.0))


@add("select doc_id, source, n_chars from (select doc_id, source, n_chars, row_number() over (order by doc_id desc) as r from documents) where r > 20 and r <= 70")
def paged_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).offset(20).limit(50)


_TAGGED = """t as (select doc_id, (array[' Definition', 'theorem', 'other', null, 'FACT '])[doc_id % 5 + 1] as kind, [' Heat', 'heat', null, '', 'Flux ' || (doc_id % 3)::varchar, 'a', 'b', 'c', 'd'] as cs from documents)"""


@add(f"""with {_TAGGED}, k as (select doc_id, lower(trim(coalesce(kind, ''))) as kind, list_filter(list_transform(cs, lambda c: trim(coalesce(c, ''))), lambda c: c <> '') as ks from t), l as (select *, list_transform(ks, lambda c: lower(c)) as low from k)
    select doc_id, case when kind in ({', '.join(map(_quoted, rules.CHUNK_TYPES))}) then kind else 'summary' end as kind, array_to_string(list_slice(list_filter(ks, lambda c, i: list_position(low, lower(c)) = i), 1, 5), '|') as concepts from l""")
def normalised_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, [" Definition", "theorem", "other", None, "FACT "])), (F.col("doc_id") % 5 + 1).cast("int"))
    cs = F.array(F.lit(" Heat"), F.lit("heat"), F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("Flux "), (F.col("doc_id") % 3).cast("string")), *map(F.lit, "abcd"))
    return d.select("doc_id", T.normal_type(kind).alias("kind"), F.array_join(T.normal_concepts(cs), "|").alias("concepts"))


@add(f"select doc_id, round(n_chars * case when doc_id % 3 = 0 then {rules.TOKEN_PRICES['gpt-4']!r}::double else {rules.TOKEN_PRICES['gpt-3.5-turbo']!r}::double end, 9) as cost from documents")
def token_costs(spark, sf_dir):
    model = F.when(F.col("doc_id") % 3 == 0, "gpt-4").otherwise("unknown")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.token_cost(F.col("n_chars"), model), 9).alias("cost"))


@add(f"""with {CHUNKS_SQL}, w as (select chunk_id, unnest(list_concat(list_transform(regexp_extract_all(lower(section_title), '[a-z0-9]+'), lambda w: 'A' || w), list_concat(list_transform(regexp_extract_all(lower(full_text), '[a-z0-9]+'), lambda w: 'B' || w), list_transform(regexp_extract_all(lower(array_to_string(key_concepts, ' ')), '[a-z0-9]+'), lambda w: 'C' || w)))) as x from tagged)
    select distinct chunk_id, x[2:] as word, x[1:1] as weight from w""")
def search_index(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", F.explode(T.weighted_tokens(F.col("section_title"), F.col("full_text"), F.array_join("key_concepts", " "))).alias("t")).select("chunk_id", "t.word", "t.weight")
