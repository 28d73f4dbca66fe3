"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams over its words and over their
shapes: words (1, 2), shapes (1, 2, 3), whether a word repeats the one before it,
and the logarithm of the word count as one more gram at the text's end.  They are
hashed to ``DIMENSIONS`` places.  Each indicator is scaled by the log ratio of its
smoothed frequencies in the two classes, and a linear model with hinge loss is
fitted to the scaled indicators by dual coordinate descent.  A logistic curve
fitted to cross-validated margins turns a margin into a score from 0 to 1.

Fitting takes at most ``MAX_TRAIN_PER_CLASS`` labelled rows of each class, those
with the smallest digests of their id, and of these as many as have
``MAX_TRAIN_PLACES`` feature places together; the classes' true sizes, counted over all
labelled rows, weigh them in the calibration.  Scoring covers every row where it
is read: the model (2 MB, whatever the input) is broadcast and nothing is shuffled.

Defined results: a null text is scored like an empty one; rows of one id are
scored by their own texts; a label row with a null id or label isn't used, an id
labelled twice counts by its smallest label; with no labels of one class the
score is the share of label 1 (0.5 without labels); only the id and the text are
looked at, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stored, ship_package
from . import kernels as K
from .runtime import list_array

DIMENSIONS = 1 << 18
#: Bounds of the sample that is fitted: rows of each class, and feature places (4 bytes each) of all.
MAX_TRAIN_PER_CLASS = 4000
MAX_TRAIN_PLACES = 1 << 24
THRESHOLD = 0.3
FOLDS = 5
_U = np.uint64


def _shape_table() -> np.ndarray:
    kinds = np.full(256, 1, np.uint8)  # a letter beyond ASCII, or a part of one
    kinds[0x61:0x7B] = 2
    kinds[0x41:0x5B] = 3
    kinds[0x30:0x3A] = 4
    for i, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        kinds[c] = 5 + i
    kinds[0:0x20] = 60
    kinds[0x7F] = 60
    return kinds


_SHAPES = _shape_table()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, how many for each text): the distinct feature places of each text of a chunk, ascending."""
    n = len(offsets) - 1
    words = K.Words(data, offsets, K.NONSPACE_BYTES, lower=False)
    # a word's shape: its byte kinds with repeats dropped
    kinds = _SHAPES[data]
    kinds = np.where(kinds == 1, 2, kinds)
    change = np.ones(len(data), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[words.starts] = True
    kept = np.flatnonzero(change)
    shape = K.range_hashes(kinds[kept], np.searchsorted(kept, words.starts), np.searchsorted(kept, words.ends))
    room = words.room()
    doc = words.doc.astype(np.int64)
    grams = [(words.hashes, 1), (K.gram_hashes(words.hashes, 2), 2), (shape ^ _U(0x51), 1), (K.gram_hashes(shape, 2) ^ _U(0x52), 2), (K.gram_hashes(shape, 3) ^ _U(0x53), 3)]
    places = [(doc[room >= k] * DIMENSIONS) + (h[room >= k] >> _U(46)).astype(np.int64) for h, k in grams]
    same = np.zeros(len(words), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    counts = words.counts()
    repeats = np.bincount(doc[same], minlength=n) * 16 // np.maximum(counts, 1)
    at_end = [np.floor(2 * np.log2(counts + 1)).astype(np.int64) + 100, repeats + 300]
    places += [np.arange(n) * DIMENSIONS + (K.mix(x.astype(_U)) >> _U(46)).astype(np.int64) for x in at_end]
    found = np.unique(np.concatenate(places))
    owner = found // DIMENSIONS
    return (found - owner * DIMENSIONS).astype(np.int32), np.bincount(owner, minlength=n)


class Model:
    """Weights (already times the log-count ratios), bias, and the logistic curve over margins."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, data, off in K.chunks(texts):
            places, counts = features(data, off)
            owner = np.repeat(np.arange(hi - lo), counts)
            margin = np.bincount(owner, weights=self.weights[places], minlength=hi - lo) + self.bias
            out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))
        return out


class Rows:
    """Feature rows laid end to end: places of row i are places[edge[i]:edge[i + 1]]."""

    def __init__(self, places: np.ndarray, counts: np.ndarray):
        self.places, self.counts = places, counts
        self.edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.counts)

    def part(self, mask: np.ndarray) -> Rows:
        return Rows(self.places[np.repeat(mask, self.counts)], self.counts[mask])

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over the places of each row."""
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return sums[self.edge[1:]] - sums[self.edge[:-1]]


def log_count_ratios(rows: Rows, labels: np.ndarray) -> np.ndarray:
    counts = []
    for label in (1, 0):
        of = rows.part(labels == label)
        counts.append((np.bincount(of.places, minlength=DIMENSIONS) + 1.0) / (len(of) + 2.0))
    return np.log(counts[0] / counts[1])


def _lengths(rows: Rows, scale: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(rows.total(scale[rows.places] ** 2)), 1e-9)


def dual_coordinate_descent(rows: Rows, labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights over places and bias of the hinge-loss model on indicators times ``scale``, rows of unit length."""
    y = np.where(labels == 1, 1.0, -1.0)
    length = _lengths(rows, scale)
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    square = rows.total(scale[rows.places] ** 2) / length**2 + 1.0
    n_pos = max((y > 0).sum(), 1)
    upper = np.where(y > 0, cost * len(y) / (2.0 * n_pos), cost * len(y) / (2.0 * max(len(y) - n_pos, 1)))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at = rows.places[rows.edge[i] : rows.edge[i + 1]]
            values = scale[at] / length[i]
            slope = y[i] * (w[at] @ values + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * values
                bias += step
                alpha[i] = new
    return w, bias


def _margins(rows: Rows, scale: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return rows.total((w * scale)[rows.places]) / _lengths(rows, scale) + bias


def _logistic(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the weighted log loss, lightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - labels)
        h = weight * p * (1 - p) + 1e-9
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum() + 1e-6 * b
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


class UnitModel(Model):
    """Scores rows of unit length, as they were fitted."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, bias: float, slope: float, shift: float):
        super().__init__(weights * scale, bias, slope, shift)
        self.squares = (scale**2).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, data, off in K.chunks(texts):
            places, counts = features(data, off)
            owner = np.repeat(np.arange(hi - lo), counts)
            size = np.sqrt(np.bincount(owner, weights=self.squares[places], minlength=hi - lo))
            margin = np.bincount(owner, weights=self.weights[places], minlength=hi - lo) / np.maximum(size, 1e-9) + self.bias
            out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))
        return out


def fit(rows: Rows, labels: np.ndarray, sizes: tuple[int, int]) -> Model:
    """The model from feature rows; ``sizes`` counts the labels 0 and 1 of which the rows are a sample."""
    have = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if not have.all():
        share = min(max(sizes[1] / max(sum(sizes), 1) if sum(sizes) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log(share / (1 - share))))
    margin = np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for f in range(FOLDS):
        train = fold != f
        if len(set(labels[train])) < 2:
            continue
        part = rows.part(train)
        scale = log_count_ratios(part, labels[train])
        w, bias = dual_coordinate_descent(part, labels[train], scale, rounds=6)
        margin[~train] = _margins(rows.part(~train), scale, w, bias)
    weight = (np.array(sizes) / have)[labels]
    slope, shift = _logistic(margin, labels.astype(float), weight * len(rows) / weight.sum())
    scale = log_count_ratios(rows, labels)
    w, bias = dual_coordinate_descent(rows, labels, scale)
    return UnitModel(w, scale, bias, slope, shift)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """True for ids that labels are never learned from: crc32 of the id as text divides by ``parts``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", most: int = MAX_TRAIN_PER_CLASS, most_places: int = MAX_TRAIN_PLACES) -> Model:
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # 2 * most rows at most
    # a repeated id gives one row: that of the smallest text digest
    texts = texts.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(2)):
                places, counts = features(data, off)
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), list_array(pa.array(places), counts)], ["id", "y", "places"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(extract, f"id {kind}, y int, places array<int>")
    # 2 * most rows at most: as many of them as the bound on places allows, by their sizes alone
    stored = Stored(spark)
    rows = stored.put(rows, "features")
    so_far = F.sum("size").over(W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = rows.select("id", F.size("places").alias("size")).withColumn("so_far", so_far).filter(F.col("so_far") <= most_places).select("id")
    table = rows.join(F.broadcast(taken), "id").toArrow().sort_by("id").combine_chunks()  # 2 * most ids at most
    stored.drop(rows)
    lists = table["places"].combine_chunks()
    found = Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    model = fit(found, table["y"].to_numpy().copy(), (sizes.get(0, 0), sizes.get(1, 0)))
    del found, lists, table
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model predicts to be good, with all their columns."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(scan, docs.schema)
