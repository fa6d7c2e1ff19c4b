"""Mentions of many names in texts: one automaton for all names of a resource, run once over each text.

Names and texts meet by resource. A resource with many chunks is dealt over several tasks, each with a copy of its
names, so that neither a task's texts nor the pairs of texts and names grow with the resource.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of a resource that one task searches.
SLOT_CHUNKS = 2_000


def automaton(names: list[str]):
    """All names but the empty one, each with its place in the list; None if there are none."""
    found = ahocorasick.Automaton()
    for place, name in enumerate(names):
        if name:
            found.add_word(name, place)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _search(most: int | None):
    """Named chunks from rows sorted by (resource, slot), a slot's names before its texts."""

    def prepared(names: list[tuple]) -> tuple:
        listed = sorted(names)
        # names that are equal in lower case share a pattern; the empty name stands in every text
        same: dict[str, list[int]] = {}
        for n, (_, _, _, low) in enumerate(listed):
            same.setdefault(low, []).append(n)
        patterns = list(same)
        return listed, same, patterns, automaton(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, names, ready = None, [], None
        for batch in batches:
            out = []
            for doc, slot, is_text, low, idx, own, name, first, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "slot", "is_text", "low", "idx", "own", "name", "first", "place"))):
                if (doc, slot) != here:
                    here, names, ready = (doc, slot), [], None
                if not is_text:
                    if low is not None:
                        names.append((first, place, name, low))
                    continue
                listed, same, patterns, machine = ready = ready or prepared(names)
                hits = {p for _, p in machine.iter(low)} if machine is not None and low else set()
                places = sorted([n for p in hits for n in same[patterns[p]]] + (same.get("", []) if low is not None else []))
                taken = set(own or ())
                kept = [listed[n][2] for n in places if listed[n][0] < idx and listed[n][2] not in taken]
                out.append((doc, idx, kept if most is None else kept[:most]))
            docs, places, found = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "idx", "named"])

    return run


def earlier_names(chunks: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, idx, named): names of a resource that first stand in an earlier chunk and that a chunk's text holds,
    without regard to case, in order of first appearance; none that the chunk has as its own.

    ``chunks``: doc_id, idx, full_text, own (array); ``names``: doc_id, name, idx and place of the first appearance.
    Null texts hold no name and null names stand nowhere; the empty name stands in every text.
    """
    slots = chunks.groupBy("doc_id").agg(F.ceil(F.count("*") / SLOT_CHUNKS).cast("int").alias("slots"))
    texts = chunks.join(slots, "doc_id").select("doc_id", F.pmod(F.xxhash64("idx"), F.col("slots")).cast("int").alias("slot"), "idx", F.lower("full_text").alias("low"), "own")
    copies = names.join(slots, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "name", F.lower("name").alias("low"), F.col("idx").alias("first"), "place")
    # one sorted stream a task, for most resources are small: a group of its own would cost each more than its search
    both = texts.withColumn("is_text", F.lit(True)).unionByName(copies.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    both = both.withColumns({"doc_id": F.col("doc_id").cast("long"), "idx": F.col("idx").cast("int")}).repartition("doc_id", "slot").sortWithinPartitions("doc_id", "slot", "is_text")
    return both.mapInArrow(_search(most), "doc_id long, idx int, named array<string>")
