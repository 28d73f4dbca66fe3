"""Connected components of a link table by contraction.

In each round every vertex takes the smallest of itself and its neighbours as
parent, parents are followed to the end of their chain by pointer jumping, and
links are rewritten to the parents; links inside one component vanish and the
others are distinct again.  Vertices are digests, so their order is random and
every round removes a constant share of the vertices that still have links.  Once
``ONE_TASK`` links or fewer are left, a single task joins what they link: rounds over
so few rows are all overhead.  Only tables are passed on; the driver sees their row counts.

Defined results: a link with a null end, or from a vertex to itself, is none; repeated
and turned links are one; a vertex without links is not listed; no links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, ship_package

#: Links (16 bytes each) that one task may hold.
ONE_TASK = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the smallest vertex of the component of each) by rounds of taking the smaller root of every link."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(names))  # numbers in the order of the names
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            return names, names[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _join_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    vertex, root = roots_of(*(np.concatenate([h[c] for h in held]) if held else np.zeros(0, np.int64) for c in range(2)))
    yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(root)], ["vertex", "root"])


def components(links: DataFrame, stored: Stored, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex that has a link; the root is the smallest vertex of the component."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    ship_package(links.sparkSession)
    edges = stored.put(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    while left := edges.count():
        if left <= ONE_TASK:
            return _with(roots, stored.put(edges.select("a", "b").coalesce(1).mapInArrow(_join_links, "vertex bigint, root bigint"), "last-roots"), stored)
        both = edges.select(F.col("a").alias("vertex"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("a").alias("other")))
        parent = both.groupBy("vertex").agg(F.min("other").alias("p")).select("vertex", F.least("vertex", "p").alias("root"))
        parent = stored.put(parent, "parents")
        while True:  # follow parents: each pass halves the chains
            up = parent.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
            jumped = stored.put(parent.join(up, "root").select("vertex", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumped")
            moved = not jumped.filter("moved").isEmpty()
            parent = jumped.drop("moved")
            if not moved:
                break
        roots = _with(roots, parent, stored)
        pa = parent.select(F.col("vertex").alias("a"), F.col("root").alias("ra"))
        pb = parent.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(pa, "a").join(pb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = stored.put(edges, "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def _with(roots: DataFrame | None, parent: DataFrame, stored: Stored) -> DataFrame:
    """The roots so far, followed to those of a later round."""
    if roots is None:
        return parent
    up = parent.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
    return stored.put(roots.join(up, "root", "left").select("vertex", F.coalesce("next", "root").alias("root")), "roots")
