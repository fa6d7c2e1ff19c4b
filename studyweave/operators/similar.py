"""Names that are alike: a similarity join by segments, exact for the ratio of matching blocks, and groups of aliases.

Matching blocks of two names keep their order, so a ratio of at least ``least`` leaves at most d = (1 - least) (sum of the
lengths) characters to delete or insert. A name cut into d + 1 segments then has one that stands unchanged in the other
name, shifted by no more than the deletions or insertions before it. Segments and the substrings that could be one meet
by equality of (length, number, text), never all names with all; pairs that pass the letter counts' bound are measured.

The lower ``least``, the shorter the segments: from 0.85 on they tell names apart, below 0.8 most names share one. Pairs
of one chunk, of which there are few, can be measured at lower ratios as they are (:func:`graph.co_occurrence`).
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..sources.staging import staged

#: The least ratio for which segments are never empty.
LOWEST = 0.6


def allowance(least: float, a: int, b: int) -> int:
    """Characters that may be deleted or inserted between names of these lengths."""
    return int((1 - least) * (a + b) + 1e-9)


def segments(length: int, least: float) -> list[tuple[int, int]]:
    """(start, end) of the segments of the shorter name of a pair."""
    longest = int(length * (2 - least) / least + 1e-9)
    parts = min(allowance(least, length, longest) + 1, length)
    return [(length * k // parts, length * (k + 1) // parts) for k in range(parts)]


def probes(name: str, least: float) -> set[tuple[int, int, str]]:
    """(length, number, text) of all segments that a name of no greater length could share with this one."""
    n, out = len(name), set()
    for short in range(max(1, int(-(-(n * least / (2 - least) - 1e-9) // 1))), n + 1):
        d, more = allowance(least, short, n), n - short
        for k, (a, b) in enumerate(segments(short, least)):
            for start in range(max(0, a - (d - more) // 2), min(n - (b - a), a + (d + more) // 2) + 1):
                out.add((short, k, name[start : start + b - a]))
    return out


def _pieces(least: float, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("low").to_pylist():
                found = [(len(name), k, name[a:b]) for k, (a, b) in enumerate(segments(len(name), least))] if whole else probes(name, least)
                rows += [(name, *f) for f in found]
            for low in range(0, len(rows), 50_000):
                columns = zip(*rows[low : low + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["low", "size", "k", "piece"])

    return run


def _measured(least: float):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            m = SequenceMatcher(None, x, y)
            return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    return ratio


def alike(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(low, other, ratio) of lower-cased names whose ratio of matching blocks, taken in this order, is at least ``least``.

    ``names`` and ``others`` have a column ``low`` of distinct texts; empty and null ones are like nothing.
    """
    if least < LOWEST:
        raise ValueError(f"least must be {LOWEST} or more")
    left, right = (df.where("low <> ''").select("low") for df in (names, others))
    cut = lambda df, whole, name: df.mapInArrow(_pieces(least, whole), "low string, size int, k int, piece string").withColumnRenamed("low", name)
    key = ["size", "k", "piece"]
    # either name may be the shorter one
    found = cut(left, True, "low").join(cut(right, False, "other"), key).select("low", "other").union(cut(left, False, "low").join(cut(right, True, "other"), key).select("low", "other"))
    return found.distinct().withColumn("ratio", _measured(least)("low", "other")).where(F.col("ratio") >= least)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of ``edges(a, b)``; the component is the smallest node reachable.

    Each round takes the smallest label of a node's neighbours and then that label's own label, so long chains shrink
    fast; each round's labels are a table in the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        best = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        after = staged(best.join(root, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels


def alias_groups(names: DataFrame, least: float = 0.9) -> DataFrame:
    """(name, canonical, members): names that are linked by the same letters and digits or by a ratio of at least
    ``least``, also over others in between; ``canonical`` is the one mentioned most, then the shortest, then the first.

    ``names``: name and mentions, a row per name; names without an alias are groups of one; empty and null names go.
    """
    rows = names.where("name <> ''").groupBy("name").agg(F.sum("mentions").alias("mentions")).withColumn("low", F.lower("name"))
    rows = staged(rows, "names")
    lows = rows.select("low").distinct()
    plain = lows.withColumn("plain", F.regexp_replace("low", "[^a-z0-9]+", ""))
    same = plain.join(plain.groupBy("plain").agg(F.min("low").alias("b")), "plain").select(F.col("low").alias("a"), "b")
    near = alike(lows, lows, least).where("low < other").select(F.col("low").alias("a"), F.col("other").alias("b"))
    group = components(same.union(near))
    rows = rows.join(group, rows["low"] == group["node"], "left").select("name", "mentions", F.coalesce("component", "low").alias("g"))
    best = rows.groupBy("g").agg(F.min_by("name", F.struct(-F.col("mentions"), F.length("name"), "name")).alias("canonical"), F.count("*").alias("members"))
    return rows.join(best, "g").select("name", "canonical", "members")


def rewrite_aliases(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (src, dst, type, confidence) between canonical names, each once with its highest confidence and none from a
    name to itself, and an ALIAS_OF edge from each other member to its canonical name."""
    named = groups.select("name", "canonical")
    out = edges
    for end in ("src", "dst"):
        out = out.join(named, out[end] == named["name"], "left").withColumn(end, F.coalesce("canonical", end)).drop("name", "canonical")
    aliases = named.where("name <> canonical").select(F.col("name").alias("src"), F.col("canonical").alias("dst"), F.lit("ALIAS_OF").alias("type"), F.lit(1.0).alias("confidence"))
    return out.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence")).unionByName(aliases)


def known_forms(names: DataFrame, forms: DataFrame, least: float = rules.FUZZY) -> DataFrame:
    """(name, form): each distinct name with the form most like it, ties to the first in order; null if none is alike.

    ``forms``: form, in lower case.
    """
    rows = names.select("name").distinct().withColumn("low", F.lower("name"))
    found = alike(rows.select("low").distinct(), forms.select(F.col("form").alias("low")).distinct(), least)
    best = found.withColumn("n", F.row_number().over(W.partitionBy("low").orderBy(F.desc("ratio"), "other"))).where("n = 1").select("low", F.col("other").alias("form"))
    return rows.join(best, "low", "left").select("name", "form")
