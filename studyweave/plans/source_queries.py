"""Queries of sources, sinks and answers: what was written is read back, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import quality, reward
from ..sources import io, ledger
from ..sources.staging import shared_path
from ..functions import rules
from ..functions import text as T
from .inputs import CHUNKS_SQL, _quoted, chunks, sql_ladder, table
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add
_TURNS = "select conv_id, turn, role, coalesce(text, '') as text from conversations"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


@add(f"with t as ({_TURNS}) select conv_id, turn, case when conv_id % 4 = 3 then 1 else 2 end as objects, text as answer, role as nested from t")
def json_answers(spark, sf_dir):
    """Objects in answers: fenced, with a trailing comma, after prose with braces in quotes, followed by another or cut off."""
    n = F.col("conv_id") % 4
    rows = _turns(spark, sf_dir)
    body = F.to_json(F.struct(F.col("text").alias("answer"), F.struct("role", F.lit('a } "quoted\\" { one').alias("odd")).alias("deep")))
    second = F.lit('{"also": [1, 2, {"x": "}"}]}')
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), F.concat(F.left(body, F.length(body) - 1), F.lit(",\n}")), F.lit("\n```\nand "), second)).when(n == 1, F.concat(F.lit('He said "so: '), body, F.lit("\n"), second, F.lit(" and {\"cut\": "))).when(n == 2, F.concat(F.lit("noise {} BEGIN_STRICT_JSON "), body, second, F.lit(" END_STRICT_JSON {}"))).otherwise(F.concat(body, F.lit(' {"cut": [1, 2')))
    found = rows.select("conv_id", "turn", io.json_objects(answer).alias("found"))
    return found.select("conv_id", "turn", F.size("found").alias("objects"), F.get_json_object(F.col("found")[0], "$.answer").alias("answer"), F.get_json_object(F.col("found")[0], "$.deep.role").alias("nested"))


@add(_TURNS)
def stored_records(spark, sf_dir):
    """Turns written as JSON lines and read with their schema."""
    rows = _turns(spark, sf_dir)
    path = shared_path(spark, "records")
    io.write_records(rows, path)
    return io.read_records(spark, path, StructType(rows.schema.fields))[0]


@add("select doc_id, n_chars from documents where doc_id in (select doc_id from labels)")
def rows_by_ids(spark, sf_dir):
    """Documents of a list of ids."""
    return io.by_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@add("""select conv_id, turn, '{"user":{"role":"' || role || '"},"session":{"turn":' || turn || '}}' as record from conversations""")
def redacted_records(spark, sf_dir):
    """Records without the ids of user and session."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.col("conv_id").alias("user_id"), "role").alias("user"), F.struct(F.col("conv_id").cast("string").alias("session_id"), "turn").alias("session"))
    return reward.redact(rows).select("conv_id", "turn", F.to_json(F.struct("user", "session")).alias("record"))


@add("select count(*)::bigint as rows, sum(length(coalesce(text, '')))::bigint as chars, count(*) filter (where coalesce(text, '') = '')::bigint as blank from documents")
def observed_stage(spark, sf_dir):
    """What passed through a stage that writes chunks of documents: measures taken on the way."""
    rows, seen = quality.observed(table(spark, sf_dir, "documents").select("doc_id", "text"), "chunking", chars=F.sum(F.length(F.coalesce("text", F.lit("")))), blank=F.count_if(F.coalesce("text", F.lit("")) == ""))
    rows.write.parquet(shared_path(spark, "observed"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["chars"], seen.get["blank"])], "rows long, chars long, blank long")


def _backfill(spark, sf_dir):
    """Roles of all chunks, filled in by a job that is stopped twice and meets an error once before it ends."""
    log, out = ledger.Ledger(spark, shared_path(spark, "ledger")), shared_path(spark, "roles")
    rows = chunks(spark, sf_dir).select("doc_id", "idx", "full_text")
    good = lambda part: part.select("doc_id", "idx", T.pedagogy_role(F.lower("full_text")).alias("role"))
    bad = lambda part: good(part).withColumn("role", F.raise_error(F.lit("the worker lost its model")).cast("string"))
    ledger.run(log, "roles", rows, "doc_id", good, out, pieces=6, stop_after=2)
    ledger.run(log, "roles", rows, "doc_id", bad, out, stop_after=1)
    ledger.run(log, "roles", rows, "doc_id", good, out)
    return log, out


@add(f"with {CHUNKS_SQL} select doc_id, idx, {sql_ladder('lower(full_text)', rules.ROLE_LADDER, _quoted(rules.ROLE_DEFAULT))} as role from chunks")
def resumed_backfill(spark, sf_dir):
    """What the backfill wrote: every chunk once."""
    log, out = _backfill(spark, sf_dir)
    return ledger.results(log, "roles", out)


@add("select 'done' as state, case when k = 2 then 2 else 1 end::bigint as attempts, k::int as piece from range(6) r(k)")
def backfill_states(spark, sf_dir):
    """The ledger's ranges after the backfill; the one that met an error was begun twice."""
    log, _ = _backfill(spark, sf_dir)
    return log.status("roles").select("state", "attempts", "piece")
