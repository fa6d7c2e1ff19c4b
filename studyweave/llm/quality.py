"""Quality of documents by co-training.

Two views of a document are kept apart: its text (letter, symbol and repetition statistics) and its metadata
(language, source, length). Each has a logistic regression. In rounds, each classifier scores all documents without
a label and hands those of which it is most confident to the other as further training rows. Both are then calibrated on labelled rows that were held out, and their calibrated log-odds are added, the prior counted
once. All documents are scored with both views.

Only fitting uses a sample: at most LABELLED labelled rows, drawn by a hash of doc_id. Features are made once per
document and staged; a round is a pass over them. What comes to the driver is bounded by LABELLED: the fitted rows,
and in each round the share HANDED of their number.

Defined cases: null text is empty; a null language, source or length has its own value; labels that are null or
name no document are not used, a doc_id with several labels has the larger; without rows of both classes every
document scores the share of good labels (1 without labels) and is kept; rows that repeat a doc_id are scored
separately; metadata columns that a table doesn't have count as null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, byte_slices, hand_back, materialise, remove, table_path, text_buffers
from .shingles import _words

#: Bound of the labelled rows that fitting reads.
LABELLED = 12_000
ROUNDS = 3
#: Share of the labelled rows' number that each view may hand over in a round, and how sure it must be.
HANDED = 0.1
SURE = 0.95
#: Documents are kept from this probability of being good on.
KEEP = 0.5
SLICE_BYTES = 1_000_000
_LANG_BUCKETS, _SOURCE_BUCKETS = 8, 32

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~+=<>\\/{}[]_", b"!?", b"|", b".,;:'\"()-", b" \t\r\v\f", b"\n"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
TEXT_FEATURES = 18


def text_features(column: pa.Array) -> np.ndarray:
    """Statistics of each text; nothing here depends on metadata."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(column), TEXT_FEATURES))
    for low, high in byte_slices(offsets, SLICE_BYTES):
        part, bounds, n = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], high - low
        counts = np.zeros((n, 11))
        for i in range(n):
            counts[i] = np.bincount(_CLASS[part[bounds[i] : bounds[i + 1]]], minlength=11)
        size = np.maximum(1, np.diff(bounds)).astype(float)
        words, of = _words(part, bounds[:-1])
        n_words = np.bincount(of, minlength=n).astype(float)
        order = np.lexsort((words, of))
        w, o = words[order], of[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[new], minlength=n)
        pair = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
        same = of[1:] == of[:-1]
        pair, po = pair[same], of[1:][same]
        order = np.lexsort((pair, po))
        pair, po = pair[order], po[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (po[1:] != po[:-1])
        n_pairs, pairs = np.bincount(po, minlength=n), np.bincount(po[fresh], minlength=n)
        letters = counts[:, 1] + counts[:, 2] + counts[:, 10]
        share = counts[:, 1:] / size[:, None]
        per_word = counts[:, [4, 5, 6]] / np.maximum(1, n_words)[:, None]
        rest = np.stack([counts[:, 1] / np.maximum(1, letters), letters / np.maximum(1, n_words) / 10, distinct / np.maximum(1, n_words), pairs / np.maximum(1, n_pairs), np.log1p(n_words) / 10], 1)
        out[low:high] = np.concatenate([share, np.minimum(per_word, 3), rest], 1)
    return out


def metadata_slots(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Each document's bucket of language and of source, and bin of the stated length, as places among META_FEATURES."""
    out = np.zeros((len(lang), 3), np.int32)
    for j, (values, first, n) in enumerate(((lang, 0, _LANG_BUCKETS), (source, _LANG_BUCKETS, _SOURCE_BUCKETS))):
        coded = values.dictionary_encode()
        bucket = np.array([zlib.crc32((v or "").encode()) % (n - 1) for v in coded.dictionary.to_pylist()] + [n - 1], np.int64)
        out[:, j] = first + bucket[coded.indices.fill_null(len(bucket) - 1).to_numpy()]
    length = np.maximum(0, n_chars.fill_null(0).to_numpy(zero_copy_only=False).astype(float))
    out[:, 2] = _LANG_BUCKETS + _SOURCE_BUCKETS + np.minimum(11, np.log2(1 + length) // 1.5).astype(int)
    return out


META_FEATURES = _LANG_BUCKETS + _SOURCE_BUCKETS + 12


def one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META_FEATURES))
    np.put_along_axis(out, slots.astype(np.int64), 1.0, 1)
    return out


def metadata_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """One-hot buckets of language and source, and bins of the stated length."""
    return one_hot(metadata_slots(lang, source, n_chars))


@dataclass
class Logistic:
    """Weights on standardised features, and the calibration of the log-odds."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> "Logistic":
        mean, spread = x.mean(0), x.std(0) + 1e-6
        z = np.concatenate([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))], 1)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, spread, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return self.slope * (z @ self.weight[:-1] + self.weight[-1]) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that fitting has not seen."""
        if len(np.unique(y)) == 2:
            raw = self.odds(x)[:, None]
            own = Logistic.fit(raw, y)
            slope = own.weight[0] / own.spread[0]
            if slope >= 0:
                self.slope, self.shift = float(slope), float(own.weight[1] - slope * own.mean[0])


@dataclass
class Model:
    """Both calibrated views; without them a constant."""

    text: Logistic | None
    meta: Logistic | None
    prior: float

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, metadata view) probabilities."""
        n = batch.num_rows
        if self.text is None:
            p = np.full(n, self.prior)
            return p, p, p
        a = self.text.odds(text_features(batch.column("text")))
        b = self.meta.odds(metadata_features(*(batch.column(c) for c in ("lang", "source", "n_chars"))))
        both = a + b - np.log(self.prior / (1 - self.prior))
        return tuple(1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (both, a, b))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t, m = text_features(batch.column("text")), metadata_slots(*(batch.column(c) for c in ("lang", "source", "n_chars")))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)), pa.array(x.ravel())) for x in (t, m)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "t", "m"])
        hand_back()


def _views(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of both views from columns t and m."""
    t, m = ((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten().to_numpy(zero_copy_only=False) for c in (table.column("t"), table.column("m")))
    return t.reshape(-1, TEXT_FEATURES).astype(float), one_hot(m.reshape(-1, 3))


_METADATA = {"lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    meta = ((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *meta)


_SURE_DDL = "view int, label double, sure double, row long, t array<double>, m array<int>"


def _surest(models: list[Logistic], taken: list[np.ndarray], most: dict[float, int]):
    """Of a task's documents, those of which a view is surest (view, label, sure, row and features): no more than it
    may hand over, so what a task holds is bounded."""

    def best(found: list[pa.RecordBatch], v: int, label: float) -> pa.RecordBatch:
        rows = pa.concat_batches(found)
        order = np.lexsort((rows.column("row").to_numpy(), -rows.column("sure").to_numpy()))[: most[label]]
        return rows.take(pa.array(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, float], pa.RecordBatch] = {}
        for batch in batches:
            views, rows = _views(batch), batch.column("row").to_numpy()
            for v in (0, 1):
                p = 1 / (1 + np.exp(-np.clip(models[v].odds(views[v]), -40, 40)))
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    at = np.flatnonzero((sure >= SURE) & ~np.isin(rows, taken[1 - v]))
                    if len(at):
                        part = batch.take(pa.array(at))
                        part = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(np.full(len(at), label)), pa.array(sure[at]), *(part.column(c) for c in ("row", "t", "m"))], ["view", "label", "sure", "row", "t", "m"])
                        kept[v, label] = best([*([kept[v, label]] if (v, label) in kept else []), part], v, label)
        yield from kept.values()

    return run


def _handed(pool: DataFrame, models: list[Logistic], taken: list[np.ndarray], most: dict[float, int]) -> pa.Table:
    """The documents of a pool that each view hands over, ranked over all tasks in two steps."""
    found = pool.mapInArrow(_surest(models, taken, most), _SURE_DDL)
    limit = F.when(F.col("label") > 0, most[1.0]).otherwise(most[0.0])
    for keys in (["view", "label", F.pmod("row", F.lit(64))], ["view", "label"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sure"), "row"))
        found = found.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    return found.toArrow().sort_by([("view", "ascending"), ("label", "ascending"), ("row", "ascending")])


def co_train(text: np.ndarray, meta: np.ndarray, good: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> tuple[Logistic, Logistic]:
    """Fit both views; each round every view hands the rows of the pool (row, t, m) of which it is surest, in the
    classes' shares, to the other."""
    x, y, taken = [text, meta], [good, good], [np.zeros(0, np.int64)] * 2
    most = {1.0: int(HANDED * len(good) * good.mean()), 0.0: int(HANDED * len(good) * (1 - good.mean()))}
    for _ in range(rounds):
        new = _handed(pool, [Logistic.fit(x[v], y[v]) for v in (0, 1)], taken, most)
        if not len(new):
            break
        views, of = _views(new), new.column("view").to_numpy()
        for v in (0, 1):
            got = of == 1 - v  # what the other view hands over
            x[v], y[v] = np.concatenate([x[v], views[v][got]]), np.concatenate([y[v], new.column("label").to_numpy()[got]])
            taken[v] = np.concatenate([taken[v], new.column("row").to_numpy()[got]])
    return Logistic.fit(x[0], y[0]), Logistic.fit(x[1], y[1])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Fit on a bounded sample of the labelled documents and on what the views are surest of among all others."""
    bound_batches(docs.sparkSession)
    made = materialise(_columns(docs).mapInArrow(_featured, "doc_id long, t array<double>, m array<int>"), "features")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("double").alias("good"))
    some = marks.join(made.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(labelled)  # at most so many rows, which bounds the broadcast
    table = made.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    good = table.column("good").to_numpy()
    model = Model(None, None, float(good.mean()) if len(good) else 1.0)
    held = np.array([zlib.crc32(str(i).encode()) % 10 < 3 for i in table.column("doc_id").to_pylist()], bool)
    used = [made]
    if len(np.unique(good[~held])) == 2:
        t, m = _views(table)
        pool = materialise(made.join(marks, "doc_id", "left_anti").select(F.monotonically_increasing_id().alias("row"), "t", "m"), "pool")
        used.append(pool)
        text, meta = co_train(t[~held], m[~held], good[~held], pool)
        text.calibrate(t[held], good[held])
        meta.calibrate(m[held], good[held])
        model = Model(text, meta, min(max(model.prior, 1e-6), 1 - 1e-6))
    remove(docs.sparkSession, *map(table_path, used))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, a, b = model.scores(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(a), pa.array(b), pa.array(p >= KEEP)], ["doc_id", "score", "text_score", "metadata_score", "kept"])
        hand_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_score, metadata_score, kept of every document."""
    return _columns(docs).mapInArrow(_scored(model), "doc_id long, score double, text_score double, metadata_score double, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of documents that the classifier keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = (batch.column(c).cast(t) if c in batch.schema.names else pa.nulls(batch.num_rows, t) for c, t in _METADATA.items())
            plain = [batch.column("text").fill_null(""), *held]
            yield batch.filter(pa.array(model.scores(pa.RecordBatch.from_arrays(plain, ["text", "lang", "source", "n_chars"]))[0] >= KEEP))
        hand_back()

    return docs.mapInArrow(run, docs.schema)
