"""Vietoris-Rips persistence (H0, H1) of small point clouds, its statistics and images.

Clouds arrive as arrays in Arrow batches and are reduced in Python workers, one
cloud at a time.  H0 is a minimal spanning tree.  H1 comes from cohomology over two
elements: an edge outside the tree that is the longest of some triangle dies with the
first of these, at once; only the other edges, few in a cloud, begin loops that last,
and their coboundaries are reduced from the longest edge down, as bit sets over the
triangles in the order of the filtration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

STATS = ("count", "l1_norm", "c1_norm", "mean_persistence", "median_persistence", "std_persistence", "entropy", "landscape_l2")
RESOLUTION = 10


@lru_cache(maxsize=16)
def _simplices(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges' ends, each triangle's three edges, and each edge's n - 2 triangles."""
    i, j = np.triu_indices(n, 1)
    at = np.zeros((n, n), np.int64)
    at[i, j] = np.arange(len(i))
    a, b, c = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    keep = (a < b) & (b < c)
    a, b, c = a[keep], b[keep], c[keep]
    triangles = np.stack([at[a, b], at[a, c], at[b, c]], axis=1)
    around = np.argsort(triangles.ravel(), kind="stable") // 3
    return i, j, triangles, around.reshape(len(i), n - 2)


def _tree(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> list[int]:
    """Places in the order of the edges of a minimal spanning tree (Kruskal)."""
    group = list(range(n))
    members = [[v] for v in range(n)]
    tree = []
    for place, (u, v) in enumerate(zip(i[order].tolist(), j[order].tolist(), strict=True)):
        a, b = group[u], group[v]
        if a == b:
            continue
        tree.append(place)
        if len(tree) == n - 1:
            break
        if len(members[a]) < len(members[b]):
            a, b = b, a
        for w in members[b]:
            group[w] = a
        members[a] += members[b]
    return tree


def rips(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finite (birth, death) pairs of H0 and H1 with positive persistence."""
    points = np.asarray(points, np.float64)  # of float vectors the pairs would be floats, which the columns of doubles can't hold
    n = len(points)
    empty = np.zeros((0, 2))
    if n < 2:
        return empty, empty
    i, j, triangles, around = _simplices(n)
    length = np.sqrt(((points[i] - points[j]) ** 2).sum(axis=1))
    order = np.argsort(length, kind="stable")
    sorted_length = length[order]
    tree = _tree(n, i, j, order)
    deaths = sorted_length[tree]
    deaths = deaths[deaths > 0]
    h0 = np.column_stack([np.zeros(len(deaths)), deaths])
    if n < 3:
        return h0, empty
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest = rank[triangles].max(axis=1)
    by_time = np.argsort(longest, kind="stable")
    longest = longest[by_time]
    time = np.empty(len(by_time), np.int64)
    time[by_time] = np.arange(len(by_time))
    begins = np.ones(len(longest), bool)
    begins[1:] = longest[1:] != longest[:-1]
    first = np.flatnonzero(begins)
    # the edge whose coboundary begins with a triangle: for a start, the longest edge of the first triangle of its length
    owner: dict[int, int] = dict(zip(first.tolist(), longest[first].tolist(), strict=True))
    loops = np.ones(len(order), bool)
    loops[tree] = False
    loops[longest[first]] = False
    last = len(by_time) - 1
    reduced: dict[int, int] = {}

    def coboundary(edge: int) -> int:
        if edge not in reduced:
            bits = 0
            for t in time[around[order[edge]]].tolist():
                bits |= 1 << (last - t)  # the earliest triangle is the highest bit
            reduced[edge] = bits
        return reduced[edge]

    pairs = []
    for edge in np.flatnonzero(loops)[::-1].tolist():
        column = coboundary(edge)
        while column:
            t = last + 1 - column.bit_length()
            if t not in owner:
                owner[t], reduced[edge] = edge, column
                if sorted_length[longest[t]] > sorted_length[edge]:
                    pairs.append((sorted_length[edge], sorted_length[longest[t]]))
                break
            column ^= coboundary(owner[t])
    pairs.sort(key=lambda x: (x[1], x[0]))
    return h0, np.array(pairs).reshape(-1, 2)


def statistics(diagram: np.ndarray) -> list[float]:
    """The eight numbers in STATS; zeros for an empty diagram."""
    p = diagram[:, 1] - diagram[:, 0] if len(diagram) else np.zeros(0)
    p = p[p > 0]
    if not len(p):
        return [0.0] * len(STATS)
    share = p / p.sum()
    return [float(len(p)), p.sum(), p.max(), p.mean(), float(np.median(p)), p.std(), -(share * np.log(share + 1e-12)).sum(), math.sqrt((p * p).sum())]


def _diagram_column(diagrams: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in diagrams])]).astype(np.int32)
    every = np.concatenate(diagrams) if diagrams else np.zeros((0, 2))
    pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, c])) for c in range(2)], ["birth", "death"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


_POINT = "array<struct<birth:double,death:double>>"


def diagrams(clouds: DataFrame, keep: list[str], points: str = "points", centre: str | None = None, scale: str | None = None) -> DataFrame:
    """keep, h0 and h1: the diagrams of each row's cloud, after subtracting ``centre`` and dividing by ``scale``."""
    ship_package(clouds.sparkSession)
    cols = [c for c in (points, centre, scale) if c]
    slim = clouds.select(*keep, *cols)
    n_keep = len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cloud = batch.column(n_keep)
            edge, inner = cloud.offsets.to_numpy(), cloud.values.offsets.to_numpy()
            flat = cloud.values.values.to_numpy(zero_copy_only=False)
            moved = [np.asarray(batch.column(n_keep + i).flatten()).reshape(batch.num_rows, -1) for i in range(1, len(cols))]
            found: tuple[list, list] = ([], [])
            for r in range(batch.num_rows):
                x = flat[inner[edge[r]] : inner[edge[r + 1]]].reshape(edge[r + 1] - edge[r], -1) if edge[r + 1] > edge[r] else np.zeros((0, 1))
                if centre:
                    x = x - moved[0][r]
                if scale:
                    x = x / moved[-1][r]
                for target, d in zip(found, rips(x), strict=True):
                    target.append(d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *map(_diagram_column, found)], [*keep, "h0", "h1"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema.fields)
    return slim.mapInArrow(scan, f"{head}, h0 {_POINT}, h1 {_POINT}")


def _scalars(dim: str) -> dict:
    """Columns of one dimension's statistics, from its sorted persistences ``<dim>_p`` and their sum ``<dim>_s``."""
    q, n, s, name = F.col(f"{dim}_p"), F.size(f"{dim}_p"), F.col(f"{dim}_s"), dim.upper()
    mean = s / n

    def some(value):
        return F.when(n > 0, value).otherwise(0.0)

    def nth(k):
        return F.element_at(q, k.cast("int"))

    return {
        f"{name}_count": n.cast("double"), f"{name}_l1_norm": s, f"{name}_c1_norm": some(F.array_max(q)), f"{name}_mean_persistence": some(mean),
        f"{name}_median_persistence": some((nth(F.floor((n + 1) / 2)) + nth(F.floor(n / 2) + 1)) / 2.0),
        f"{name}_std_persistence": some(F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)),
        f"{name}_entropy": some(-F.aggregate(q, F.lit(0.0), lambda a, x: a + x / s * F.ln(x / s + 1e-12))),
        f"{name}_landscape_l2": F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x)),
    }


def scalar_features(diagrams_: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the sixteen statistics, by array functions."""
    out = diagrams_
    for dim in ("h0", "h1"):
        p = F.array_sort(F.filter(F.transform(dim, lambda x: x["death"] - x["birth"]), lambda x: x > 0))
        out = out.withColumn(f"{dim}_p", p).withColumn(f"{dim}_s", F.aggregate(f"{dim}_p", F.lit(0.0), lambda a, x: a + x))
        out = out.withColumns(_scalars(dim))
    return out.select(*keep, *[f"{d}_{s}" for d in ("H0", "H1") for s in STATS])


def image_bounds(train: DataFrame) -> DataFrame:
    """(h0_top, h1_top): side of the square that holds the train rows' births and persistences; null without points."""
    aggs = []
    for dim in ("h0", "h1"):
        born, lives = F.array_max(F.transform(dim, lambda x: x["birth"])), F.array_max(F.transform(dim, lambda x: x["death"] - x["birth"]))
        top = F.greatest(1.1 * F.max(born), 1.1 * F.max(lives), F.lit(1e-3))
        aggs.append(F.when(F.max(lives).isNotNull(), top).alias(f"{dim}_top"))
    return train.agg(*aggs)


def image(diagram: list, top: float | None, resolution: int = RESOLUTION, sigma: float = 1.0) -> np.ndarray:
    """Mass of Gaussians at (birth, persistence), weighted by persistence, in each pixel of [0, top]^2."""
    out = np.zeros((resolution, resolution))
    if top is None or not diagram:
        return out.ravel()
    edge = np.linspace(0.0, top, resolution + 1)
    mass = lambda c: np.diff([0.5 * (1 + math.erf((e - c) / (sigma * math.sqrt(2)))) for e in edge])
    for birth, death in diagram:
        out += (death - birth) * np.outer(mass(birth), mass(death - birth))
    return out.ravel()


def persistence_images(diagrams_: DataFrame, bounds: tuple[float | None, float | None], keep: list[str], resolution: int = RESOLUTION, sigma: float = 1.0) -> DataFrame:
    """keep and image (2 * resolution^2 numbers), with bounds that were fitted elsewhere."""
    ship_package(diagrams_.sparkSession)
    slim = diagrams_.select(*keep, "h0", "h1")
    n_keep = len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h0, h1 in zip(batch.column(n_keep).to_pylist(), batch.column(n_keep + 1).to_pylist(), strict=True):
                parts = [image([(x["birth"], x["death"]) for x in d], top, resolution, sigma) for d, top in zip((h0, h1), bounds, strict=True)]
                rows.append(np.concatenate(parts).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(rows, pa.list_(pa.float64()))], [*keep, "image"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema.fields)
    return slim.mapInArrow(scan, f"{head}, image array<double>")
