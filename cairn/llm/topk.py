"""Exact top-k search by pivot elimination.

Vectors are turned into integers, floor(256 * x) for each component, and scored
by their integer inner product.  With q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2, the
triangle inequality over a table of distances to many pivots gives
d(q,x) >= max_p |d(q,p) - d(x,p)|, hence an upper bound of the score.  In each
block of vectors a query evaluates candidates in the order of their bounds and
stops when the next bound is below its k-th score so far: everything left is
worse, so the result is exact.  Equal bounds are still evaluated, since a tie
goes to the smaller id.

Pivots are spread over a sample of at most ``PIVOT_SAMPLE`` vectors by
farthest-first traversal.  The k-th score that a query has within the sample is a
floor from which every task starts.  Both decide only how much is skipped.

Each task reads its share of the vectors block by block (an Arrow batch at a
time) and carries the queries' best scores from block to block; it returns k rows
a query, of which the k best overall are kept.  Queries are taken in passes of
at most ``MAX_QUERY_VALUES`` components; what a pass finds is written before the
next one is broadcast, so what is held has a bound whatever the number of queries.

Scores are exact: products are summed as doubles where all sums are below 2**53,
else as 64-bit integers, and where those might not suffice as integers of any length.

Defined results: a vector that is null, or holds a null or non-finite component,
takes no part; vectors of different lengths are compared on queries of their own
length only; a null vec_id takes no part (it can't be named).  A query's own
vector, that is every row of its vec_id, is no candidate of it.  If a vec_id
repeats, it is listed once with its best score, and the smallest of its vectors
is the query.  Fewer candidates than k: all of them.  A score beyond a bigint is given
as the nearest bigint; a component of 2**55 and more has no bigint, and its vector takes
no part either.  vec_id is a whole number.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stored, ship_package

PIVOTS = 64
PIVOT_SAMPLE = 2000
#: Components of the queries of one pass (8 bytes each in the broadcast).
MAX_QUERY_VALUES = 1 << 22
#: Vectors that a task bounds and evaluates at a time.
BLOCK = 4096
_STEP = 256
_TILE = 32
_LONG = (1 << 63) - 1


def quantise(vector: Column) -> Column:
    """floor(256 * x) of each component as bigint; null unless all components are finite (and below 2**55)."""
    x = vector.cast("array<double>")
    clean = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**55)))
    return F.when(vector.isNotNull() & clean, F.transform(x, lambda v: F.floor(v * 256.0)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _distances(x: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms[:, None] + (pivots**2).sum(1) - 2.0 * (x @ pivots.T), 0.0))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer vector, held within a bigint."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if most < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    return np.array([min(max(int(v), -_LONG - 1), _LONG) for v in exact], np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal from the sample's first vector."""
    if not len(sample):
        return sample
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        nxt = int(away.argmax())
        if away[nxt] == 0:
            break
        chosen.append(nxt)
        away = np.minimum(away, ((sample - sample[nxt]) ** 2).sum(1))
    return sample[chosen]


def _first_of_each(ids: np.ndarray) -> np.ndarray:
    """The first entry of each id, in order."""
    return np.sort(np.unique(ids, return_index=True)[1])


def sample_floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k best reach: the k-th within the sample, or the least there is."""
    once = _first_of_each(sample_ids)
    sample_ids, sample = sample_ids[once], sample[once]
    floors = np.full(len(ids), -_LONG - 1)
    for i in range(len(ids)):
        scores = products(sample, queries[i])[sample_ids != ids[i]]
        if len(scores) >= k:
            floors[i] = -np.partition(-scores.astype(np.float64), k - 1)[k - 1] if np.abs(scores).max() < 2**53 else np.sort(scores)[-k]
    return floors


class _Best:
    """The k best (score, id) of each query so far, none below its floor; ids are distinct."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k = k
        self.floors = floors.astype(np.int64)
        self.scores = np.full((len(floors), k), -_LONG - 1, np.int64)
        self.ids = np.zeros((len(floors), k), np.int64)
        self.filled = np.zeros(len(floors), np.int64)

    def floor(self, i: int) -> int:
        return max(int(self.floors[i]), int(self.scores[i, -1])) if self.filled[i] == self.k else int(self.floors[i])

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor(i)
        if not good.any():
            return
        had = self.filled[i]
        s = np.concatenate([self.scores[i, :had], scores[good]])
        x = np.concatenate([self.ids[i, :had], ids[good]])
        order = np.lexsort((x, ~s))  # ~s falls as s rises, without overflow
        s, x = s[order], x[order]
        once = _first_of_each(x)[: self.k]  # an id's first entry is its best
        self.filled[i] = len(once)
        self.scores[i, : len(once)], self.ids[i, : len(once)] = s[once], x[once]


class Searcher:
    """Queries with their pivot table; ``scan`` takes one block of vectors."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.q, self.pivots = ids, queries, pivots.astype(np.float64)
        real = queries.astype(np.float64)
        self.norms = (real**2).sum(1)
        self.table = _distances(real, self.norms, self.pivots).T.astype(np.float32)
        self.best = _Best(np.full(len(ids), -_LONG - 1) if floors is None else floors, k)
        #: pairs that were scored, of those there were
        self.evaluated = self.pairs = 0

    def scan(self, ids: np.ndarray, x: np.ndarray) -> None:
        real = x.astype(np.float64)
        norms = (real**2).sum(1)
        table = _distances(real, norms, self.pivots).T.astype(np.float32)
        slack = 1e-4 * (norms.max(initial=0.0) + self.norms.max(initial=0.0) + 1.0)  # float32 distances are good to 1e-7
        self.pairs += len(x) * len(self.ids) - int(np.isin(ids, self.ids).sum())
        step = max(_STEP, 2 * self.best.k)
        low, apart = (np.empty((_TILE, len(x)), np.float32) for _ in range(2))
        for tile in range(0, len(self.ids), _TILE):
            n = min(_TILE, len(self.ids) - tile)
            low[:n] = 0  # the bound of every pair, one pivot at a time
            for p in range(len(table)):
                np.subtract(self.table[p, tile : tile + n, None], table[p], out=apart[:n])
                np.abs(apart[:n], out=apart[:n])
                np.maximum(low[:n], apart[:n], out=low[:n])
            for i in range(tile, tile + n):
                self._search(i, ids, x, (self.norms[i] + norms - low[i - tile].astype(np.float64) ** 2) / 2.0 + slack, step)

    def _search(self, i: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, step: int) -> None:
        left = np.flatnonzero(bound >= self.best.floor(i))
        if not len(left):
            return
        b = bound[left]
        if len(left) > step:  # the most promising first, to raise the floor
            head = np.argpartition(-b, step)[:step]
            self._evaluate(i, ids, x, left[head])
            rest = np.ones(len(left), bool)
            rest[head] = False
            left, b = left[rest], b[rest]
            live = b >= self.best.floor(i)
            left, b = left[live], b[live]
        order = np.argsort(-b, kind="stable")
        for lo in range(0, len(order), 4 * step):
            part = order[lo : lo + 4 * step]
            if b[part[0]] < self.best.floor(i):
                break
            self._evaluate(i, ids, x, left[part])

    def _evaluate(self, i: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
        at = at[ids[at] != self.ids[i]]
        self.evaluated += len(at)
        self.best.add(i, products(x[at], self.q[i]), ids[at])


def top_k(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    base = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), quantise(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).filter("vec_id is not null and v is not null")
    asked = base.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    kinds = asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row for each length
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    stored, parts = Stored(spark), []
    for dim, n in ((r["dim"], r["n"]) for r in kinds):
        same = base.filter(F.size("v") == dim).select("vec_id", "v")
        passes = max(1, -(-n * max(dim, 1) // MAX_QUERY_VALUES))
        drawn = same.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).collect()
        sample_ids, sample = np.array([r["vec_id"] for r in drawn], np.int64), np.array([r["v"] for r in drawn], np.int64).reshape(-1, dim)
        chosen = choose_pivots(sample.astype(np.float64), pivots)
        for turn in range(passes):
            mine = asked.filter((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn)).toArrow()
            ids = mine["vec_id"].to_numpy()
            q = _matrix(mine["v"].combine_chunks() if isinstance(mine["v"], pa.ChunkedArray) else mine["v"], dim) if len(ids) else np.zeros((0, dim), np.int64)
            shared = spark.sparkContext.broadcast((ids, q, chosen, sample_floors(ids, q, sample_ids, sample, k)))
            parts.append(stored.put(same.mapInArrow(_pass(shared, k, dim), "query_id bigint, vec_id bigint, score bigint"), "pass"))
            shared.destroy()
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(shared, k: int, dim: int):
    """Task over the vectors: the k best of its share for each query of the pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, spread, floors = shared.value
        search = Searcher(names, asked, spread, k, floors)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            for lo in range(0, len(own), BLOCK):
                search.scan(own[lo : lo + BLOCK], x[lo : lo + BLOCK])
        at, col = np.nonzero(np.arange(k) < search.best.filled[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(search.best.ids[at, col]), pa.array(search.best.scores[at, col])], ["query_id", "vec_id", "score"])

    return scan
