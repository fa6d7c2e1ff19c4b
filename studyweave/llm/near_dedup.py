"""Near-duplicate groups by bottom-k sketches from one hash function.

1. Every text becomes its set of distinct word shingles (63-bit hashes) and a sketch: the SKETCH smallest
   hashes. Texts with equal sets collapse to one node first.
2. Inverted lists of the retained values tell which nodes can have a partner: two sets of Jaccard p share, among
   the SKETCH smallest of their union, a number of values that is binomial with mean SKETCH * p; the floor lies
   DEVIATIONS standard deviations below. For p = 0.8 that is 32 of 64, and a pair falls under it with probability
   2e-08. For sets that fit into the sketch the bound is certain. ``exact=True`` does without it: lists are then
   made over whole sets for all nodes and no estimate filters, so every link is found for certain, at more cost.
3. For those nodes the lists are ordered, rarest values first. Only the first values of a node matter (prefix
   and position bounds on what a partner must share), so a passage that many documents share makes no long list
   of candidates. The nodes of lists that are still long get lists over their whole sets instead, where the
   bounds are certain and drop all copies with too many changes of their own.
4. In each list the members are paired with the most central one; the union-sketch estimate drops hopeless
   pairs, full sets decide. Pairs left between different components of a list are decided in a second round:
   in lists over whole sets a member meets only those smaller ones whose size its position leaves within reach
   (classes of sizes are part of the join's key), and two members of the list's largest component never meet.
   Pairs inside a component cannot change the result, so a large group stays linear.

Defined cases: null, empty and blank texts have n_shingles 0 and stand alone; rows that repeat a doc_id are one
node of the graph; a null doc_id is linked with nothing, has a null component and is kept; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, free_name, hand_back, materialise, maybe_broadcast, remove, table_path, text_buffers
from .components import connected_components
from .shingles import mix, shingle_sets

SKETCH = 64
#: How many standard deviations below its mean an estimate may lie before a pair is ruled out.
DEVIATIONS = 6
#: Ratio of the sizes in one class of the second round's join.
CLASS_RATIO = 1.05
#: Longer lists of sketch values are replaced by lists over whole sets, whose bounds prune far more.
LONG_LIST = 64
_SKETCHES_DDL = "doc_id long, n long, fp1 long, fp2 long, sketch array<long>"
_SETS_DDL = "doc_id long, n long, sketch array<long>, shingles array<long>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.int64()))


def _per_text(width: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, counts, values in shingle_sets(data, offsets, width):
                ids = batch.column("doc_id")[low : low + len(counts)]
                begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
                rank = np.arange(len(values)) - np.repeat(begin, counts)
                sketch = _lists(values[rank < SKETCH], np.minimum(counts, SKETCH))
                if full:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(counts), sketch, _lists(values, counts)], ["doc_id", "n", "sketch", "shingles"])
                    continue
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values.astype(np.uint64)))])
                other = np.concatenate([[np.uint64(0)], np.cumsum(mix(values.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
                fp1, fp2 = ((x[begin + counts] - x[begin]).astype(np.int64) for x in (total, other))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(fp1), pa.array(fp2), sketch], ["doc_id", "n", "fp1", "fp2", "sketch"])
        hand_back()

    return run


def _fits(percent: int):
    """Whether stored full sets reach the threshold, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], ["a", "b", "linked"])

    return run


def floor_of(percent: int) -> int:
    """Least shared values, of SKETCH, for a pair of that Jaccard, but for DEVIATIONS; at least one."""
    p = percent / 100
    return max(1, math.ceil(SKETCH * p - DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)) - 1e-9))


def _least_shared(n, percent: int):
    """Values of a sketch that a partner must share: exact where the union fits into the sketch."""
    return F.when(n * 100 <= SKETCH * percent, F.ceil(n * percent / 100)).otherwise(F.lit(floor_of(percent)).cast("long"))


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule out the threshold."""
    t = percent / 100
    slim = sets.select("doc_id", "sketch")
    joined = pairs.join(slim.select(F.col("doc_id").alias("a"), F.col("sketch").alias("ka")), "a")
    joined = joined.join(slim.select(F.col("doc_id").alias("b"), F.col("sketch").alias("kb")), "b")
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
    room = F.when(F.size(union) < SKETCH, 0.0).otherwise(DEVIATIONS * F.sqrt(F.size(union) * t * (1 - t)))
    return joined.where(shared >= F.size(union) * t - room - 1e-9).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """The pairs that full sets confirm."""
    full = sets.select("doc_id", "shingles")
    joined = (pairs if exact else _estimated(pairs, sets, percent)).join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    joined = joined.join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = joined.mapInArrow(_fits(percent), "a long, b long, linked boolean")
    return materialise(links.where("linked").select("a", "b"), "links")


def _ranked_lists(sets: DataFrame, values: str, need) -> DataFrame:
    """(value, doc_id, n, size, need, pos) of the retained values, rarest first, up to the prefix a partner must meet.

    ``need``: how many of the ``size`` values of a node any partner shares. Values that no other node holds come
    first in the order: they take up positions but make no list.
    """
    each = sets.select("doc_id", F.explode(values).alias("value"))
    rarity = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(rarity, "value")
    ranked = shared.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("df", "value"))).withColumn("held", F.count("*").over(W.partitionBy("doc_id")))
    ranked = ranked.join(sets.select("doc_id", "n", F.size(values).cast("long").alias("size"), need.alias("need")), "doc_id")
    ranked = ranked.withColumn("pos", F.col("nth") - 1 + F.col("size") - F.col("held"))
    return ranked.where("pos <= size - need").select("value", "doc_id", "n", "size", "need", "pos")


def _possible(x, y, percent: int):
    """Set sizes fit, and what two members of a list can share from its value on reaches what they must share."""
    whole = F.ceil((x("n") + y("n")) * percent / (100 + percent) - 1e-9)
    need = F.when((x("size") == x("n")) & (y("size") == y("n")), whole).otherwise(F.greatest(x("need"), y("need")))
    return (F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent) & (F.least(x("size") - x("pos"), y("size") - y("pos")) >= need)


def _candidate_lists(sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Lists of sketch values (kind 0), and of whole sets (kind 1) for the nodes of long lists or, if exact, for all."""
    if exact:
        return materialise(_ranked_lists(sets, "shingles", F.ceil(F.col("n") * percent / 100)).withColumn("kind", F.lit(1)), "lists")
    short = materialise(_ranked_lists(sets, "sketch", _least_shared(F.col("n"), percent)), "sketch-lists")
    long = short.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") > LONG_LIST).select("value")
    crowd = materialise(short.join(long, "value", "left_semi").select("doc_id").distinct(), "crowd")
    whole = sets.join(maybe_broadcast(crowd, crowd.count()), "doc_id", "left_semi")
    whole = _ranked_lists(whole, "shingles", F.ceil(F.col("n") * percent / 100))
    return materialise(short.join(long, "value", "left_anti").withColumn("kind", F.lit(0)).unionByName(whole.withColumn("kind", F.lit(1))), "lists")


def _rest(placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(Pairs (a, b) between different components of a list that bounds don't rule out, the long lists' table).

    With x the larger set: x's position leaves it n_x - pos values to share, so its partner has at most
    (n_x - pos) * (100 + p) / p - n_x of them; likewise for y. Only members that reach their own size can be y.
    """
    sides = lambda s: (lambda c: F.col(f"{s}.{c}"))
    x, y = sides("x"), sides("y")
    apart = (x("value") == y("value")) & (x("component") != y("component")) & _possible(x, y, percent)
    pair = [F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")]
    short = placed.where("kind = 0")  # at most LONG_LIST members each
    found = short.alias("x").join(short.alias("y"), apart & (x("doc_id") < y("doc_id"))).select(*pair)
    reach = (F.col("size") - F.col("pos")) * ((100 + percent) / percent) - F.col("n")
    size_class = lambda n: F.floor(F.log(n) / math.log(CLASS_RATIO)).cast("int")
    long = placed.where("kind = 1").withColumn("reach", reach + 1e-6)
    # a table of its own, so that a long list can be split or meets a broadcast in the join
    most = long.groupBy("value", "component").agg(F.count("*").alias("m")).groupBy("value").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    most = materialise(most, "main-components")
    long = materialise(long.join(maybe_broadcast(most, most.count(), 24), "value").withColumn("main", F.col("component") == F.col("largest")).drop("largest"), "long-lists")
    remove(placed.sparkSession, table_path(most))
    least = F.ceil(F.col("n") * percent / 100 - 1e-9)
    larger = long.where(F.col("reach") >= least).withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.least("n", F.floor("reach"))))))
    smaller = long.where(F.col("reach") >= F.col("n")).withColumn("class", size_class(F.col("n")))
    ordered = F.struct(y("n"), y("doc_id")) < F.struct(x("n"), x("doc_id"))
    for left, right in ((larger.where("not main"), smaller), (larger.where("main"), smaller.where("not main"))):
        found = found.union(left.alias("x").join(right.alias("y"), apart & (x("class") == y("class")) & ordered).select(*pair))
    return found.distinct(), long


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = materialise(texts.mapInArrow(_per_text(width, False), _SKETCHES_DDL), "sketches")
    usable = sketches.where("n > 0 and doc_id is not null")
    copies = usable.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = materialise(copies, "copies")  # so that neither side of the join comes grouped and a large group can be split
    member = sketches.select("doc_id", "n", "fp1", "fp2").join(maybe_broadcast(copies, copies.count(), 32), ["n", "fp1", "fp2"], "left")
    member = materialise(member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), "members")
    others = member.where("rep <> doc_id").select("doc_id")
    nodes = usable.join(maybe_broadcast(others, others.count()), "doc_id", "left_anti").select("doc_id", "n", "sketch")

    if exact:
        wanted = nodes.select("doc_id")
    else:
        values = nodes.select("doc_id", F.explode("sketch").alias("value"))
        lists = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select("value")
        overlaps = values.join(lists, "value", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))
        wanted = overlaps.join(nodes.select("doc_id", "n"), "doc_id").where(F.col("shared") >= _least_shared(F.col("n"), percent)).select("doc_id")
    wanted = materialise(wanted, "candidates")
    sets = texts.join(maybe_broadcast(wanted, wanted.count()), "doc_id", "left_semi").mapInArrow(_per_text(width, True), _SETS_DDL)
    sets = materialise(sets.where("n > 0"), "sets")
    remove(spark, table_path(wanted))
    ranked = _candidate_lists(sets, percent, exact)

    centre = ranked.groupBy("kind", "value").agg(F.min(F.struct("pos", "doc_id", "n", "size", "need")).alias("c"), F.count("*").alias("m")).where("m > 1").drop("m")
    star = ranked.join(centre, ["kind", "value"]).where(F.col("doc_id") != F.col("c.doc_id"))
    star = star.where(_possible(F.col, lambda c: F.col(f"c.{c}"), percent))
    star = star.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
    first = _verified(star, sets, percent, exact)
    found = connected_components(first)

    placed = ranked.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("kind", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("kind", "value")
    placed = materialise(placed.join(mixed, ["kind", "value"]), "mixed")
    rest, long_lists = _rest(placed, percent)
    second = _verified(rest, sets, percent, exact)
    joined = second.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    final = _compose(found, merged)
    remove(spark, *(table_path(t) for t in (sketches, copies, sets, ranked, placed, long_lists, first, second)))
    out = member.join(final, "rep", "left")
    component = F.coalesce("component_id", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _compose(found: DataFrame, merged: DataFrame) -> DataFrame:
    """(rep, component_id) from first-round components and the merges between them."""
    roots = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    one = found.join(roots, "component", "left").select(F.col("node").alias("rep"), F.coalesce("root", "component").alias("component_id"))
    alone = merged.join(found.select("node"), "node", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    return one.union(alone)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """The rows that stay (one document of each group), with all their columns."""
    gone = near_copies(docs, width, percent, exact).where("not kept").select(F.col("doc_id").alias(free_name(docs, "copy_id")))
    return docs.join(maybe_broadcast(gone, gone.count()), docs["doc_id"] == gone[gone.columns[0]], "left_anti")
