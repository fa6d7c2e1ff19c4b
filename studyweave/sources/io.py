"""Reading and writing: uploads, record files, reports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Larger uploads are refused.
MAX_UPLOAD = 100 * 1024 * 1024


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, content) of files in any store Spark reads, by the name's ending; too large ones are left out before they are read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_UPLOAD)
    return files.select("path", "length", file_kind(F.col("path")).alias("kind"), "content")


def file_kind(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("pdf", "pptx", "docx"), end).otherwise("text")


def text_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, text): a text file is one page; what is no UTF-8 gives an empty page. Files of other
    kinds need an extractor of their own (see :func:`pages_with`)."""
    return files.where("kind = 'text'").select("path", F.lit(1).alias("page_number"), F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("text"))


def pages_with(files: DataFrame, kind: str, extract) -> DataFrame:
    """(path, page_number, text) by ``extract``, a pandas UDF from content to an array of page texts; pages of
    fewer than two characters count as empty."""
    found = files.where(F.col("kind") == kind).select("path", F.posexplode(extract("content")).alias("n", "text"))
    return found.select("path", (F.col("n") + 1).alias("page_number"), F.when(F.length(F.trim("text")) >= 2, F.col("text")).otherwise("").alias("text"))


def with_math(pages: DataFrame, formulas: DataFrame) -> DataFrame:
    """Pages with the formulas found on them appended as a MATH: block; ``formulas``: path, page_number, pos, latex."""
    key = ["path", "page_number"]
    listed = formulas.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "latex"))).alias("fs"))
    joined = pages.join(listed, key, "left")
    block = F.concat(F.lit("\n\nMATH:\n"), F.array_join("fs.latex", "\n"))
    return joined.select(*key, F.when(F.col("fs").isNotNull(), F.concat("text", block)).otherwise(F.col("text")).alias("text"))


def job_status(log: DataFrame) -> DataFrame:
    """(job_id, status, at): the latest entry of an append-only log of queued, processing, done and error."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.max("at").alias("at"))


def read_records(spark: SparkSession, path: str, schema: StructType, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of JSON lines, or of JSON arrays in whole files; a bad line keeps its text in _bad."""
    text = spark.read.option("wholetext", array).text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_file"), "value")
    if array:
        parsed = text.withColumn("r", F.from_json("value", ArrayType(schema)))
        good = parsed.select(F.explode("r").alias("r"))
        bad = parsed.where("r is null")
    else:
        full = StructType(list(schema.fields)).add("_bad", "string")  # add() changes the list it is given
        parsed = text.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        good, bad = parsed.where("r._bad is null"), parsed.where("r._bad is not null")
    return good.select(*(F.col("r")[f.name].alias(f.name) for f in schema.fields)), bad.select("_file", F.col("value").alias("_bad"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with one of the ids; Spark picks the join by the sizes."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


# Marks around an answer's JSON.
_SENTINEL = re.compile(r"BEGIN_STRICT_JSON\s*(.*?)\s*END_STRICT_JSON", re.IGNORECASE | re.DOTALL)
_FENCE = re.compile(r"^```(?:json)?[ \t]*$|```", re.IGNORECASE | re.MULTILINE)
_MARK = re.compile(r'\\.|["{}\]]|,(?=\s*[}\]])', re.DOTALL)


def scan_objects(text: str) -> list[str]:
    """Every top-level object of a text: a fold over braces, quotes and escapes. Quotes count within objects only, braces
    outside strings only; commas before a closing bracket go, if they stand outside strings. An object that is cut off
    is none, but whole objects within it are not looked for either."""
    found, depth, quoted, start, gone = [], 0, False, 0, []
    for m in _MARK.finditer(text):
        mark = m[0]
        if depth and mark == '"':
            quoted = not quoted
        elif quoted or mark[0] == "\\" or mark in '"]':
            continue
        elif mark == "{":
            if not depth:
                start, gone = m.start(), []
            depth += 1
        elif mark == "," and depth:
            gone.append(m.start())
        elif mark == "}" and depth:
            depth -= 1
            if not depth:
                cuts = [start - 1, *gone, m.end()]
                found.append("".join(text[a + 1 : b] for a, b in zip(cuts, cuts[1:])))
    return found


@F.pandas_udf(ArrayType(StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """Every top-level JSON object of each text, in order; marked ones first, if there are marks. Null has none."""

    def one(text: str | None) -> list[str]:
        marked = _SENTINEL.search(text or "")
        return (scan_objects(marked[1]) if marked else None) or scan_objects(_FENCE.sub("", text or ""))

    return texts.map(one)


def extracted_json(text: Column) -> Column:
    """The first object of a model's answer as text, empty if it has none."""
    return F.coalesce(F.get(json_objects(text), F.lit(0)), F.lit(""))


def report_markdown(report: DataFrame, title: str) -> str:
    """A one-row report as Markdown."""
    row = report.first()
    return f"# {title}\n\n" + "\n".join(f"- {k}: {v}" for k, v in (row.asDict() if row else {}).items()) + "\n"
