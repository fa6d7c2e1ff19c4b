"""Phrase collocation mining.

Words that occur often enough in their language are encoded by a dictionary over (lang, word); pieces of text break at
all others, since no frequent phrase holds them. From each word on, up to ``longest`` ids are packed into a key of fixed
width, 64 bits a column, zeros behind a piece's end. A task sorts and counts its keys, so that each is sent once.
Splitters sampled from the keys deal them over ranges; a task sorts a range and run-length counts the keys' prefixes:
one sort gives the counts of phrases of all lengths. A phrase whose run touches a border of its range is reported with
its part of the count, and the parts are added. Scores, cuts and containment are joins on phrases of ids.

The dictionary holds words with at least ``least`` occurrences, so its size is known once words are counted: up to
NARROW words get 21-bit ids, three in a column, and the dictionary is broadcast. Beyond that, a word's id is its 64-bit
hash together with its language's, nothing is broadcast, and pieces don't break at rare words; two words of one hash
raise an error.

Defined cases: null texts are empty, null languages are ``und``; words are cut at space and tab, pieces at . , ; : ! ?
and line ends; the same phrase in two languages is two phrases; rows that repeat a doc_id count each; other columns
are ignored; an empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, byte_slices, hand_back, materialise, maybe_broadcast, partitions, remove, table_path, text_buffers
from .repeats import SAMPLE_BYTES, SLICE_BYTES, _batch, _by_key
from .shingles import mix
from .words import LOWER, hashes, pack, table, unpack

#: Words of the dictionary that 21-bit ids can tell apart; 16 bytes each are broadcast.
NARROW = 1_000_000
#: Keys that a task sorts before it sends them, and keys of a range.
BLOCK = 400_000
RANGE = 500_000
#: Occurrences that a count must have.
LEAST = 100
_BREAKS = ".,;:!?\n\u000b\f\r"
_PIECE = table(*((ord(c), ord(c)) for c in _BREAKS))
_GAP = _PIECE | table((0x20, 0x20), (0x09, 0x09))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lang(docs: DataFrame):
    return F.coalesce(docs["lang"].cast("string"), F.lit("und"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): occurrences of every lower-cased word in each language."""
    text = F.translate(F.coalesce(docs["text"], F.lit("")), _UPPER, _UPPER.lower())
    words = docs.select(_lang(docs).alias("lang"), F.explode(F.split(text, r"[ \t.,;:!?\n\x0B\f\r]+")).alias("word"))
    return words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f"))


def _hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words as :func:`words.hashes` gives them."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    return hashes(data, np.cumsum(sizes) - sizes, np.zeros(256, bool))[0]


def _tongue(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of each language."""
    return _hashed([b"\0" + ("und" if x is None else x).encode() for x in langs.to_pylist()])


class Coder:
    """Ids of words in languages, and their packing into columns of 64 bits."""

    def __init__(self, known: np.ndarray | None):
        self.known = known  # sorted hashes of (lang, word), whose places are the ids less one; None: hashes are the ids
        self.per = 3 if known is not None else 1
        self.bits = 64 // self.per

    def ids(self, words: np.ndarray, tongues: np.ndarray) -> np.ndarray:
        joint = mix(words ^ (tongues * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
        if self.known is None:
            return joint
        at = np.searchsorted(self.known, joint)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == joint[hit]
        return np.where(hit, at + 1, 0).astype(np.uint64)

    def keys(self, ids: np.ndarray, piece: np.ndarray, longest: int) -> list[np.ndarray]:
        """Columns of the keys of all places that begin a phrase of at least two words."""
        n = len(ids)
        columns = [np.zeros(n, np.uint64) for _ in range(-(-longest // self.per))]
        alive = ids != 0
        two = np.zeros(n, bool)
        for k in range(longest):
            if k:
                alive = alive.copy()
                alive[max(n - k, 0) :] = False
                if n > k:
                    alive[: n - k] &= (piece[k:] == piece[: n - k]) & (ids[k:] != 0)
                if k == 1:
                    two = alive
            at = np.flatnonzero(alive)
            columns[k // self.per][at] |= ids[at + k] << np.uint64(self.bits * (self.per - 1 - k % self.per))
        return [c[two] for c in columns]

    def prefix(self, columns: list[np.ndarray], k: int) -> list[np.ndarray]:
        """The columns that the first k ids need, others cut off."""
        out = []
        for c in range(-(-k // self.per)):
            gone = self.bits * max(0, (c + 1) * self.per - k)
            out.append(columns[c] >> np.uint64(gone) << np.uint64(gone))
        return out

    def unpacked(self, columns: list[np.ndarray], k: int) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([(columns[j // self.per] >> np.uint64(self.bits * (self.per - 1 - j % self.per))) & mask for j in range(k)], 1)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the keys by a radix sort: 16 bits at a time, the last ones first; digits that are all equal are left out."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in range(0, 64, 16):
            digit = ((c >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Places where a sorted key differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _keys(batch: pa.RecordBatch, coder: Coder, longest: int) -> Iterator[list[np.ndarray]]:
    data, offsets = text_buffers(batch.column("text"))
    tongues = _tongue(batch.column("lang"))
    for low, high in byte_slices(offsets, SLICE_BYTES):
        part = data[offsets[low] : offsets[high]]
        words, starts, _, owner = hashes(part, offsets[low:high] - offsets[low], _GAP, LOWER)
        if len(words):
            # breaks before each word, with a new number for each text
            piece = np.cumsum(_PIECE[part])[starts] + owner
            yield coder.keys(coder.ids(words, tongues[low:high][owner]), piece, longest)


def _sampler(coder: Coder, longest: int, thin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _keys(batch, coder, longest):
                mixed = columns[0]
                for c in columns[1:]:
                    mixed = mix(mixed) ^ c
                yield pa.RecordBatch.from_arrays([pa.array([columns[0][mix(mixed) % np.uint64(thin) == 0].tobytes()], pa.binary())], ["keys"])

    return run


def _sender(coder: Coder, longest: int, borders: np.ndarray, ddl: str):
    """Keys of a task's texts, counted and dealt over ranges by their first column."""

    def send(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = radix_order(columns)
        columns = [c[order] for c in columns]
        starts = _changes(columns)
        times = np.diff(np.concatenate([starts, [len(order)]])).astype(np.uint32)
        columns = [c[starts] for c in columns]
        cuts = np.concatenate([[0], np.searchsorted(columns[0], borders), [len(starts)]])
        out = []
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[g], cuts[g + 1])
            out.append((g, cuts[g + 1] - cuts[g], *(pack(c[part], k == 0) for k, c in enumerate(columns)), pack(times[part])))
        return _batch(out, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for columns in _keys(batch, coder, longest):
                parts.append(columns)
                n += len(columns[0])
                if n >= BLOCK:
                    yield send(parts)
                    parts, n = [], 0
                    hand_back()
            hand_back()
        if n:
            yield send(parts)

    return run


def _counter(coder: Coder, longest: int, least: int):
    """Counts of phrases of all lengths in each range; rare ones only where they may go on beyond its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-longest // coder.per)
        for _, sent in _by_key(batches, "grp"):
            columns = [np.concatenate([unpack(r[f"key{c}"], r["n"], np.uint64, c == 0) for r in sent]) for c in range(width)]
            times = np.concatenate([unpack(r["times"], r["n"], np.uint32) for r in sent]).astype(np.int64)
            order = radix_order(columns)
            columns, times = [c[order] for c in columns], times[order]
            total = np.concatenate([[0], np.cumsum(times)])
            for k in range(2, longest + 1):
                head = coder.prefix(columns, k)
                starts = _changes(head)
                counts = np.diff(total[np.concatenate([starts, [len(times)]])])
                ids = coder.unpacked([c[starts] for c in head], k)
                edge = np.zeros(len(starts), bool)
                edge[[0, -1]] = True
                keep = ((counts >= least) | edge) & (ids[:, -1] != 0)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(list(ids[keep].view(np.int64)), pa.list_(pa.int64())), pa.array(counts[keep])], ["phrase", "f"])
            hand_back()

    return run


def _borders(sampled: np.ndarray, ranges: int) -> np.ndarray:
    sampled = np.sort(sampled)
    return np.unique(sampled[len(sampled) * np.arange(1, ranges) // ranges]) if len(sampled) else sampled


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, dictionary, totals): (phrase, f) for id phrases of one word and more with f >= least; (id, lang, word, f); (lang, n)."""
    spark = docs.sparkSession
    bound_batches(spark)
    counted = materialise(word_counts(docs), "word-counts")
    totals = materialise(counted.groupBy("lang").agg(F.sum("f").alias("n")), "lang-totals")
    frequent = materialise(counted.where(F.col("f") >= least), "frequent-words")
    remove(spark, table_path(counted))

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = Coder(None).ids(_hashed([w.encode() for w in batch.column("word").to_pylist()]), _tongue(batch.column("lang")))
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), *batch.columns], ["id", "lang", "word", "f"])

    named = frequent.mapInArrow(joint, "id long, lang string, word string, f long")
    size, distinct = named.agg(F.count("*"), F.count_distinct("id")).first()
    if size != distinct:
        raise RuntimeError("two words have one hash")
    known = None
    if size <= NARROW:
        known = np.sort(np.array([r.id for r in named.select("id").collect()], np.int64).view(np.uint64))

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.set_column(0, "id", pa.array(np.searchsorted(known, batch.column("id").to_numpy().view(np.uint64)) + 1, pa.int64()))

        named = named.mapInArrow(numbered, "id long, lang string, word string, f long")
    dictionary = materialise(named, "dictionary")
    remove(spark, table_path(frequent))
    coder = Coder(known)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), _lang(docs).alias("lang"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4 * partitions(spark), chars // 6 // RANGE)
    part = min(1.0, SAMPLE_BYTES / max(chars, 1))
    thin = max(1, int(chars * part / 6 / (400 * ranges)))
    sample = (rows if part == 1 else rows.sample(part, 1)).mapInArrow(_sampler(coder, longest, thin), "keys binary").collect()
    borders = _borders(np.frombuffer(b"".join(r["keys"] for r in sample), np.uint64), ranges)
    ddl = "grp int, n int, " + "".join(f"key{c} binary, " for c in range(-(-longest // coder.per))) + "times binary"
    sent = rows.mapInArrow(_sender(coder, longest, borders, ddl), ddl).repartition(partitions(spark), "grp").sortWithinPartitions("grp")
    parts = sent.mapInArrow(_counter(coder, longest, least), "phrase array<long>, f long")
    phrases = parts.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialise(phrases.union(dictionary.select(F.array("id"), "f")), "phrases"), dictionary, totals


def _score(a, n, left, right):
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def collocations(docs: DataFrame, least: int = LEAST, longest: int = 5, best: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``best`` phrases of two words and more (None: all).

    A phrase scores as its lowest-scoring cut into two parts; a phrase that occurs only within a longer one is left out.
    """
    phrases, dictionary, totals = phrase_counts(docs, least, longest)
    rows = phrases.count()
    f = maybe_broadcast(phrases, rows, 8 * longest + 32)
    long = phrases.where(F.size("phrase") > 1)
    # a phrase within a longer one is within one that is longer by a word and occurs no less often than that
    last = F.col("phrase")
    inside = long.where(F.size("phrase") > 2).select(F.explode(F.array(F.slice(last, F.lit(1), F.size(last) - 1), F.slice(last, F.lit(2), F.size(last) - 1))).alias("phrase"), F.col("f").alias("longer")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    free = long.join(inside, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("phrase", F.col("f").alias("a"))
    cut = free.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("head"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("tail"))
    parts = cut.join(f.select(F.col("phrase").alias("head"), F.col("f").alias("l")), "head").join(f.select(F.col("phrase").alias("tail"), F.col("f").alias("r")), "tail")
    words = maybe_broadcast(dictionary, dictionary.count(), 60)
    lang = parts.join(words.select(F.col("id").alias("first"), "lang"), F.col("phrase")[0] == F.col("first")).join(maybe_broadcast(totals, totals.count(), 40), "lang")
    scored = lang.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    least_cut = scored.groupBy("phrase", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = least_cut.select("phrase", F.posexplode("phrase").alias("place", "id")).join(words.select("id", "word"), "id").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    named = least_cut.join(spelt, "phrase").select("lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # Spark orders strings by their UTF-8 bytes; ranks up to ``best`` are found before rows of a language meet in one task
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")).cast("long"))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    return ranked.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
