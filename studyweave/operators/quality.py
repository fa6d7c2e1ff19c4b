"""Coverage, distributions and the quality report of a chunk table; each is one aggregation pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..functions.text import truthy


def _rate(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.greatest(whole, F.lit(1))


def tag_coverage(rows: DataFrame, tagged: Column) -> DataFrame:
    """total, tagged, pct (null for an empty table)."""
    found = rows.agg(F.count("*").alias("total"), F.count_if(tagged).alias("tagged"))
    return found.withColumn("pct", F.round(F.lit(100.0) * F.col("tagged") / F.nullif("total", F.lit(0)), 2))


def tag_structure(rows: DataFrame) -> DataFrame:
    """total, valid_json and empty_tags over rows whose JSON ``tags`` are not null: objects, and those without keys."""
    keys = F.json_object_keys("tags")  # null for what is no object
    return rows.where(F.col("tags").isNotNull()).agg(F.count("*").alias("total"), F.count_if(keys.isNotNull()).alias("valid_json"), F.count_if(F.size(keys) == 0).alias("empty_tags"))


def missing_keys(agent: Column, payload: Column) -> Column:
    """Keys that a request (map of strings) must have for its agent and lacks or leaves empty; unknown agents need none."""
    table = F.create_map(*(x for a, keys in rules.AGENT_KEYS.items() for x in (F.lit(a), F.array(*map(F.lit, keys)).cast("array<string>"))))
    wanted = F.coalesce(F.try_element_at(table, agent), F.array().cast("array<string>"))
    return F.filter(wanted, lambda k: F.coalesce(F.try_element_at(payload, k), F.lit("")) == "")


def valid_uuid(value: Column) -> Column:
    """The trimmed value if it is a UUID (8-4-4-4-12 hexadecimal digits), else null."""
    return F.when(F.lower(F.trim(value)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.trim(value))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a hash of their key and a seed: the same rows for the same seed, however they lie."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def observed(rows: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """rows, and their measures (count always) as they pass through a stage; read them after the stage's action."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in measures.items())), seen


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """n and share of each value; the window only sees one row per value."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def richness(chunk: dict[str, Column]) -> Column:
    """Points of a chunk's metadata, 0 to 100. ``chunk``: truth values of each kind of metadata."""
    # Points per field.
    points = {"full_text": 10, "domain": 7, "topic": 7, "subtopic": 6, "prerequisites": 8, "learning_objectives": 7, "formulas": 10, "formula_variables": 5, "complexity": 10, "context": 10, "relationships": 10, "continuity": 5, "sequence": 5}
    return F.least(sum((F.when(has, points[name]).otherwise(0) for name, has in chunk.items()), F.lit(0)), F.lit(100))


def report(chunks: DataFrame) -> DataFrame:
    """One row: the six checks' rates and results, richness and grade.

    ``chunks``: full_text, domain, topic, subtopic, prerequisites and learning_objectives arrays, formulas
    (array of structs id, latex, type, variables), and nullable structs context (previous_chunk_summary),
    relationships (previous_chunk_id, prerequisite_chunk_ids), continuity, sequence, complexity.
    """
    formulas = F.coalesce("formulas", F.array().cast("array<struct<id:string,latex:string,type:string,variables:array<string>>>"))
    size = lambda keep: F.coalesce(F.sum(F.size(F.filter(formulas, keep))), F.lit(0))
    array = lambda name: truthy(F.col(name), "array")
    present = lambda name: F.col(name).isNotNull()
    has = {c: array(c) for c in ("domain", "topic", "subtopic", "prerequisites", "learning_objectives", "formulas")} | {c: present(c) for c in ("complexity", "context", "relationships", "continuity", "sequence")}
    has |= {"full_text": truthy(F.col("full_text")), "formula_variables": F.exists(formulas, lambda f: truthy(f["variables"], "array"))}
    points = richness(has)
    # Least rates of the checks.
    sums = chunks.agg(
        F.count("*").alias("total"), size(lambda f: F.lit(True)).alias("formulas"), size(lambda f: f["id"].isNotNull() & f["latex"].isNotNull() & f["type"].isNotNull()).alias("kept"),
        size(lambda f: truthy(f["variables"], "array") & truthy(f["type"]) & truthy(f["latex"])).alias("complete"),
        F.count_if(has["domain"] & has["topic"]).alias("tagged"), F.count_if(has["prerequisites"]).alias("with_prerequisites"), F.count_if(has["context"]).alias("with_context"),
        F.count_if(has["relationships"]).alias("linked"), F.avg(points).alias("richness"), F.min(points).alias("least_richness"), F.max(points).alias("most_richness"),
    )
    checks = {"formulas_preserved": ("kept", "formulas", 95), "tags_hierarchical": ("tagged", "total", 90), "formulas_complete": ("complete", "formulas", 70), "prerequisites_present": ("with_prerequisites", "total", 30), "context_windows": ("with_context", "total", 95), "relationships_linked": ("linked", "total", 90)}
    rates = {name: _rate(F.col(part), F.col(whole)) for name, (part, whole, _) in checks.items()}
    passed = sum((F.when(rates[name] >= least, 1).otherwise(0) for name, (_, _, least) in checks.items()), F.lit(0))
    rich = F.coalesce("richness", F.lit(0.0))
    scored = sums.select("total", *(F.round(r, 2).alias(name) for name, r in rates.items()), passed.alias("checks_passed"), F.round(rich, 2).alias("richness"), F.coalesce("least_richness", F.lit(0)).alias("least_richness"), F.coalesce("most_richness", F.lit(0)).alias("most_richness"), (passed / 6 * 60 + rich * 0.4).alias("_s"))
    return scored.withColumn("grade", grade(F.col("_s"))).drop("_s")


def grade(score: Column) -> Column:
    return F.when(score >= 95, "A+").when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def run_comparison(runs: DataFrame) -> DataFrame:
    """Time and memory of an enhanced run against a basic one: mean multipliers and the share within 3x and 2x."""
    r = runs.select((F.col("enhanced_s") / F.col("basic_s")).alias("t"), (F.col("enhanced_mb") / F.col("basic_mb")).alias("m"))
    return r.agg(F.count("*").alias("n"), F.round(F.avg("t"), 4).alias("time_x"), F.round(F.avg("m"), 4).alias("memory_x"), F.round(F.lit(100.0) * F.count_if(F.col("t") < 3) / F.count("*"), 2).alias("time_ok"), F.round(F.lit(100.0) * F.count_if(F.col("m") < 2) / F.count("*"), 2).alias("memory_ok"))


def alerts(metrics: DataFrame) -> DataFrame:
    """Alerts of each resource's run: slow processing, lost formulas, untagged chunks."""
    # Limits and severities.
    limits = [("processing_time", "warning", F.col("total_ms") > 15000), ("formula_preservation", "critical", F.col("formula_pct") < 80), ("tag_coverage", "warning", F.col("tag_pct") < 70)]
    each = F.array(*(F.when(test, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"))) for name, severity, test in limits))
    return metrics.select("resource_id", F.explode(F.filter(each, lambda a: a.isNotNull())).alias("a")).select("resource_id", "a.alert", "a.severity")
