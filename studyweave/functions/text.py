"""Column expressions over text; all stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: White space as both Java's and other engines' ASCII classes see it.
WS = r"[ \t\n\r\f]"


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether any phrase occurs in the text."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def ladder(text: Column, steps: Sequence[tuple], default) -> Column:
    """The outcome of the first step of which a phrase occurs."""
    (first, phrases), *rest = steps
    out = F.when(contains_any(text, phrases), F.lit(first))
    for outcome, phrases in rest:
        out = out.when(contains_any(text, phrases), F.lit(outcome))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def truthy(value: Column, kind: str = "string") -> Column:
    """Present and not empty: no null, '', [] or 0."""
    empty = {"string": value == "", "array": F.size(value) == 0, "number": value == 0}[kind]
    return F.coalesce(~empty, F.lit(False))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def token_count(text: Column, least: int = 1) -> Column:
    """Words separated by white space, at least ``least``."""
    return F.greatest(F.size(words(text)), F.lit(least))


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences: white space after . ! ? or a line break separates them."""
    # the class comes first: few characters are white space, and only at those the engine looks behind
    return F.filter(F.transform(F.split(text, rf"{WS}(?<=[.!?\n]{WS}){WS}*"), strip), lambda s: s != "")


def pedagogy_role(text: Column, title: Column | None = None) -> Column:
    """Role of a chunk by its text, then by its section's title."""
    default = F.lit(rules.ROLE_DEFAULT)
    if title is not None:
        default = ladder(F.lower(F.coalesce(title, F.lit(""))), rules.ROLE_TITLE_LADDER, default)
    return ladder(F.lower(text), rules.ROLE_LADDER, default)


def content_type(text: Column) -> Column:
    low = F.lower(text)
    intro = F.when(contains_any(F.substring(low, 1, rules.CONTENT_INTRO_CHARS), rules.CONTENT_INTRO), "concept_intro").otherwise("unknown")
    return ladder(low, rules.CONTENT_LADDER, intro)


def formula_type(equation: Column) -> Column:
    return ladder(equation, rules.FORMULA_LADDER, "algebraic")


def signed(text: Column, signs: Sequence[str], found: Column) -> Column:
    """``found`` (an array of strings) where the text holds all signs without which a pattern finds nothing; plain
    searches for these are far cheaper than the pattern. Null texts give what ``found`` is for them."""
    holds = text.contains(signs[0])
    for s in signs[1:]:
        holds = holds & text.contains(s)
    return F.when(~holds, F.array().cast("array<string>")).otherwise(found)


def latex_formulas(text: Column) -> Column:
    """Stripped formula bodies in order of the patterns, each once."""
    found = F.flatten(F.array(*(signed(text, rules.SIGNS[p], F.regexp_extract_all(text, F.lit(p), F.lit(1))) for p in rules.LATEX_PATTERNS)))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda f: f != ""))


def variables(equation: Column) -> Column:
    """Sorted names of up to three letters with their sub- and superscripts; commands and Greek letters are none."""
    commands = "|".join(r"\\" + f for f in sorted(rules.LATEX_FUNCTIONS, key=len, reverse=True))
    plain = F.regexp_replace(F.coalesce(equation, F.lit("")), commands, "")
    base, sub, power = (F.regexp_extract_all(plain, F.lit(rules.VARIABLE), F.lit(g)) for g in (1, 2, 3))
    parts = F.arrays_zip(base.alias("base"), sub.alias("sub"), power.alias("power"))
    no_name = F.array(*map(F.lit, [*rules.LATEX_FUNCTIONS, *rules.GREEK, *(g.capitalize() for g in rules.GREEK)]))
    named = F.filter(parts, lambda v: (F.length(v["base"]) <= 3) & ~F.array_contains(no_name, v["base"]))
    mark = lambda sign, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(sign), v)).otherwise("")
    return F.array_sort(F.array_distinct(F.transform(named, lambda v: F.concat(v["base"], mark("_", v["sub"]), mark("^", v["power"])))))


def cross_references(text: Column) -> Column:
    """Struct of sorted, distinct references per kind."""

    def found(written: str, patterns: list[str]) -> Column:
        hits = F.flatten(F.array(*(signed(F.lower(text), rules.SIGNS[p], F.regexp_extract_all(text, F.lit(p), F.lit(1))) for p in patterns)))
        return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.concat(F.lit(written), h))))

    return F.struct(*(found(written, patterns).alias(kind) for kind, written, patterns in rules.REFERENCES))


def bloom_level(text: Column) -> Column:
    low = F.lower(text)
    return F.greatest(F.lit(2), *(F.when(contains_any(low, p), level).otherwise(0) for level, p in rules.BLOOM.items()))


def math_level(text: Column) -> Column:
    return ladder(F.lower(text), rules.MATH_LEVELS[::-1], "none")


def abstract_words(text: Column) -> Column:
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in rules.ABSTRACT_WORDS), F.lit(0))


def study_minutes(text: Column, formulas: Column, prerequisites: Column) -> Column:
    """Five minutes, reading at 200 words a minute, two per formula and level, one per prerequisite; whole minutes."""
    n = F.size(words(text)).cast("double")
    return (5 + n / 200 + 2 * formulas + 2 * bloom_level(text) + prerequisites).cast("int")


def difficulty_score(text: Column, formula_types: Column, prerequisites: Column, concepts: Column) -> Column:
    """0-25 for mathematics, up to 30 for the number of formulas and more for their kinds, up to 25 and 20 for prerequisites and abstract concepts."""
    points = F.create_map(*(F.lit(x) for kv in rules.FORMULA_POINTS.items() for x in kv))
    kinds = F.aggregate(formula_types, F.lit(0), lambda acc, t: acc + F.coalesce(F.try_element_at(points, t), F.lit(0)))
    abstract = F.size(F.filter(concepts, lambda c: contains_any(F.lower(c), rules.ABSTRACT_CONCEPTS)))
    return F.least(F.size(formula_types) * 5, F.lit(30)) + kinds + F.least(F.size(prerequisites) * 5, F.lit(25)) + F.least(abstract * 10, F.lit(20)) + ladder(F.lower(text), rules.MATH_POINTS, 5)


def difficulty(score: Column) -> Column:
    return F.when(score < 30, "introductory").when(score < 60, "intermediate").otherwise("advanced")


#: Accented Latin letters and their plain forms, for names of concepts.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz")


def canonical_name(name: Column) -> Column:
    """Lower case, accents off, other signs and hyphens as single blanks."""
    plain = F.translate(F.lower(strip(F.coalesce(name, F.lit("")))), *ACCENTS)
    return strip(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def is_noise_concept(name: Column) -> Column:
    low = F.lower(strip(name))
    special = F.length(F.regexp_replace(name, r"[\p{L}\p{N} ,-]", ""))
    noise = (F.length(strip(name)) < 3) | low.rlike("|".join(rules.NOISE_PATTERNS)) | low.isin(rules.GENERIC_TERMS) | (F.length(name) > 100) | (special > F.floor(F.length(name) / 3))
    return F.coalesce(noise, F.lit(True))


def squeezed(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(name), f"{WS}+", " "), "[‘’′]", "'")


def known_form(name: Column) -> Column:
    """Acronyms spelled out, known variants as the first of their group, else null."""
    known = {v.lower(): sorted(group)[0] for group in rules.SYNONYMS for v in group}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    short = F.create_map(*(F.lit(x) for kv in rules.ACRONYMS.items() for x in kv))
    return F.coalesce(F.try_element_at(short, F.upper(strip(name))), F.try_element_at(table, F.lower(squeezed(name))))


def synonym(name: Column) -> Column:
    """The known form, else the squeezed name (without the fuzzy step)."""
    return F.coalesce(known_form(name), squeezed(name))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs in a text, ignoring case."""
    low, t = F.lower(text), F.lower(term)
    return F.when(F.length(t) > 0, ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int")).otherwise(0)


def figures(text: Column) -> Column:
    """Figure and table captions: label, caption and kind by the caption's words."""

    def captions(pattern: str, word: str, kind):
        labels, bodies = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
        return F.transform(F.arrays_zip(labels.alias("l"), bodies.alias("b")), lambda z: F.struct(F.concat(F.lit(word), z["l"]).alias("label"), strip(z["b"]).alias("caption"), kind(F.lower(z["b"])).alias("kind")))

    body = r"\s+" + rules.NUMBER + r"\s*[:\-]?\s*([^.]+(?:\.[^.]+)?)"
    return F.concat(captions(r"(?i)(?:Figure|Fig\.?)" + body, "Figure ", lambda c: ladder(c, rules.FIGURE_KINDS, "unknown")), captions("(?i)Table" + body, "Table ", lambda c: F.lit("table")))


def caption_concepts(caption: Column, most: int = 5) -> Column:
    """Capitalised phrases of more than three letters."""
    return F.slice(F.filter(F.regexp_extract_all(caption, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)), lambda c: F.length(c) > 3), 1, most)


def axes(caption: Column, kind: Column) -> Column:
    """Struct x, y of a graph's axes: named ones first, else the sides of "versus"; null where the caption has none."""
    low = F.lower(caption)
    named = lambda axis: F.nullif(strip(F.regexp_extract(low, axis + r"[- ]axis:?\s*([^,;.]+)", 1)), F.lit(""))
    side = lambda group: F.nullif(strip(F.regexp_extract(low, rules.VERSUS, group)), F.lit(""))
    return F.when(kind == "graph", F.struct(F.coalesce(named("x"), side(2)).alias("x"), F.coalesce(named("y"), side(1)).alias("y")))


def section_path(number: Column) -> Column:
    return F.filter(F.split(F.replace(number, F.lit(" "), F.lit("")), r"\."), lambda s: s != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length_of(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """Cosine of two equally long arrays in double precision; 0 where either is null or has no length.

    Lengths made before a join save two of three passes per pair."""
    size = (length_of(a) if length_a is None else length_a) * (length_of(b) if length_b is None else length_b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def fallback_embedding(text: Column, size: int = 384) -> Column:
    """What stands in for a model: the number of words in hundredths, repeated."""
    return F.array_repeat(F.pmod(F.size(words(text)), F.lit(100)) / F.lit(100.0), size)


def normal_type(kind: Column) -> Column:
    low = F.lower(strip(F.coalesce(kind, F.lit(""))))
    return F.when(low.isin(rules.CHUNK_TYPES), low).otherwise("summary")


def normal_concepts(concepts: Column, most: int = rules.MOST_CONCEPTS) -> Column:
    """Stripped, not empty, each once without regard to case (as first written), ``most`` at most."""
    kept = F.filter(F.transform(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    low = F.transform(kept, lambda c: F.lower(c))
    return F.slice(F.filter(kept, lambda c, i: F.array_position(low, F.lower(c)) == i + 1), 1, most)


def with_math(expressions: Column, text: Column) -> Column:
    """A tagger's expressions and those found in the text, each once."""
    return F.array_distinct(F.concat(F.coalesce(expressions, F.array().cast("array<string>")), latex_formulas(text)))


def token_cost(tokens: Column, model: Column) -> Column:
    prices = F.create_map(*(F.lit(x) for kv in rules.TOKEN_PRICES.items() for x in kv))
    return tokens * F.coalesce(F.try_element_at(prices, model), F.lit(rules.TOKEN_PRICES["gpt-3.5-turbo"]))


def weighted_tokens(heading: Column, body: Column, tags: Column) -> Column:
    """Words of a chunk with the weight of where they stand: A heading, B body, C tags."""
    def part(source, weight):
        # words are made distinct before they are structs, which Spark would compare each with each
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))

    return F.concat(part(heading, "A"), part(body, "B"), part(tags, "C"))
