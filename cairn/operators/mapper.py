"""Mapper graphs over entity feature vectors, and patterns in them.

Points are covered by overlapping intervals of a lens, clustered within each
interval, and clusters that share points are linked.  Covering, node statistics and
links are DataFrame operations; a clusterer sees one interval at a time and the
graph analysis the node graph alone, whose size is intervals times clusters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from .joins import cover_intervals


def standardise(points: DataFrame, columns: list[str]) -> DataFrame:
    """x: the columns by mean and population deviation, as one array."""
    s = points.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_s") for c in columns])
    out = points.crossJoin(F.broadcast(s))  # one row
    return out.withColumn("x", F.array(*[(F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s") for c in columns])).drop(*s.columns)


def l2_lens(x: str = "x"):
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def pca_lens(points: DataFrame, x: str = "x", k: int = 1) -> DataFrame:
    """lens: the first principal component (its sign is arbitrary); lens_2 too if k is 2."""
    df = points.withColumn("_v", array_to_vector(x))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(df)
    p = vector_to_array("_p")
    out = model.transform(df).withColumn("lens", p[0])
    return (out.withColumn("lens_2", p[1]) if k > 1 else out).drop("_v", "_p")


def dbscan(x: np.ndarray, eps: float = 0.8, least: int = 2) -> np.ndarray:
    """Cluster numbers in the order of their first point, -1 for noise."""
    near = lambda i: np.flatnonzero(((x - x[i]) ** 2).sum(-1) <= eps * eps)  # noqa: E731  one row of distances at a time
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if label[i] >= 0 or len(near(i)) < least:
            continue
        label[i] = k
        queue = deque([i])
        while queue:
            around = near(queue.popleft())
            if len(around) >= least:  # the point is a core: what is near belongs to the cluster
                fresh = around[label[around] < 0]
                label[fresh] = k
                queue.extend(fresh)
        k += 1
    return label


def mapper_members(points: DataFrame, point_id: str, n_intervals: int = 8, overlap: float = 0.3, lens=None, clusterer: Callable[[np.ndarray], np.ndarray] = dbscan) -> DataFrame:
    """(interval, label, point_id, lens, x): a row for each point of each cluster; noise and lone points are dropped."""
    ship_package(points.sparkSession)
    covered = cover_intervals(points.select(F.col(point_id).alias("point_id"), "x", *([F.col("lens").alias("given")] if lens is None else [])), F.col("given") if lens is None else lens, n_intervals, overlap)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        out = pdf[["interval", "point_id", "lens", "x"]].assign(label=0)
        if len(pdf) < 2:
            return out.iloc[:0][["interval", "label", "point_id", "lens", "x"]]
        try:
            out["label"] = clusterer(np.stack(pdf["x"].to_numpy()))
        except ValueError:  # a clusterer that can't take these points: one cluster
            out["label"] = 0
        return out[out["label"] >= 0][["interval", "label", "point_id", "lens", "x"]]

    kind = covered.schema["point_id"].dataType.simpleString()
    return covered.select("interval", "point_id", "lens", "x").groupBy("interval").applyInPandas(cluster, f"interval int, label int, point_id {kind}, lens double, x array<double>")


def mapper_nodes(members: DataFrame) -> DataFrame:
    """(node_id, interval, label, size, lens_mean, members, centroid)."""
    node = F.concat_ws("-", F.lpad(F.col("interval").cast("string"), 4, "0"), F.lpad(F.col("label").cast("string"), 4, "0"))
    dims = F.posexplode("x").alias("d", "v")
    centre = members.select("interval", "label", dims).groupBy("interval", "label", "d").agg(F.avg("v").alias("v"))
    centre = centre.groupBy("interval", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("centroid"))
    nodes = members.groupBy("interval", "label").agg(F.count("*").alias("size"), F.avg("lens").alias("lens_mean"), F.array_sort(F.collect_list("point_id")).alias("members"))
    return nodes.join(centre, ["interval", "label"]).withColumn("node_id", node).select("node_id", "interval", "label", "size", "lens_mean", "members", "centroid")


def mapper_edges(members: DataFrame) -> DataFrame:
    """(source, target, weight): nodes that share points; a point is in few intervals, so few rows meet."""
    node = F.concat_ws("-", F.lpad(F.col("interval").cast("string"), 4, "0"), F.lpad(F.col("label").cast("string"), 4, "0"))
    m = members.select("point_id", node.alias("source"))
    pairs = m.join(m.select("point_id", F.col("source").alias("target")), "point_id").filter("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n_nodes"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_node_size"), F.coalesce(F.max("size"), F.lit(0)).alias("max_node_size"))
    return n.crossJoin(edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("avg_edge_weight")))


def betweenness(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, float]:
    """Normalised betweenness of an unweighted graph (Brandes)."""
    near: dict[str, list[str]] = {v: [] for v in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        seen, back, paths, dist = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0.0), {s: 0}
        paths[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            seen.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    back[w].append(v)
        carried = dict.fromkeys(nodes, 0.0)
        for w in reversed(seen):
            for v in back[w]:
                carried[v] += paths[v] / paths[w] * (1 + carried[w])
            if w != s:
                score[w] += carried[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


def connected(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, str]:
    """The smallest node of each node's component."""
    root = {v: v for v in nodes}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def cycle_basis(nodes: list[str], edges: list[tuple[str, str]], least: int = 3) -> list[list[str]]:
    """Fundamental cycles with respect to a breadth-first tree."""
    near: dict[str, list[str]] = {v: [] for v in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    up: dict[str, str | None] = {}
    rings = []
    for s in sorted(nodes):
        if s in up:
            continue
        up[s] = None
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for w in sorted(near[v]):
                if w not in up:
                    up[w] = v
                    queue.append(w)

    def path(v: str) -> list[str]:
        out = [v]
        while up[out[-1]] is not None:
            out.append(up[out[-1]])
        return out

    for a, b in sorted(edges):
        if up[a] == b or up[b] == a:
            continue
        pa, pb = path(a), path(b)
        while len(pa) > 1 and len(pb) > 1 and pa[-2:] == pb[-2:]:
            pa.pop()
            pb.pop()
        ring = pa + pb[-2::-1] if pa[-1] == pb[-1] else pa + pb[::-1]
        if len(ring) >= least:
            rings.append(ring)
    return rings


def _one_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ship_package(nodes.sparkSession)
    return nodes.select(F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b")).union(edges.select("source", "target")).withColumn("one", F.lit(1))


def _graph_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple[str, str]]]:
    return sorted(pdf.loc[pdf["b"].isna(), "a"]), [(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True) if isinstance(b, str)]


def graph_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, betweenness, component, n_rings) of every node, and how many rings pass it.

    The node graph is small (intervals times clusters, whatever the number of
    points), so it is one group.
    """
    both = _one_graph(nodes, edges)

    def analyse(pdf: pd.DataFrame) -> pd.DataFrame:
        names, links = _graph_of(pdf)
        score, root = betweenness(names, links), connected(names, links)
        found = cycle_basis(names, links)
        return pd.DataFrame([{"node_id": v, "betweenness": score[v], "component": root[v], "n_rings": sum(v in r for r in found), "rings_total": len(found)} for v in names], columns=["node_id", "betweenness", "component", "n_rings", "rings_total"])

    return both.groupBy("one").applyInPandas(analyse, "node_id string, betweenness double, component string, n_rings int, rings_total int")


def bottlenecks(patterns: DataFrame, k: int = 3) -> DataFrame:
    # sums of fractions: equal up to the ninth digit is equal
    return patterns.orderBy(F.desc(F.round("betweenness", 9)), "node_id").limit(k).select("node_id", "betweenness")


def communities(patterns: DataFrame) -> DataFrame:
    """(rank, component, size, nodes), the largest first."""
    found = patterns.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node_id")).alias("nodes"))
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "component"))).select("rank", "component", "size", "nodes")  # a row a component


def rings(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(ring, nodes): the first k independent cycles of at least three nodes, in the order of the link that closes them."""
    both = _one_graph(nodes, edges)

    def analyse(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cycle_basis(*_graph_of(pdf))[:k]
        return pd.DataFrame({"ring": pd.Series(range(len(found)), dtype="int32"), "nodes": pd.Series(found, dtype="object")})

    return both.groupBy("one").applyInPandas(analyse, "ring int, nodes array<string>")


def report(nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """One row on the graph: its summary, the k worst bottlenecks, the largest communities, the rings."""
    patterns = graph_patterns(nodes, edges)
    worst = bottlenecks(patterns, k).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.round("betweenness", 9)).alias("b"), "node_id"))), lambda s: s["node_id"]).alias("bottlenecks"))
    sizes = communities(patterns).agg(F.count("*").alias("n_communities"), F.slice(F.sort_array(F.collect_list("size"), asc=False), 1, k).alias("largest_communities"))
    cycles = ring_count(nodes, edges, patterns).select("n_rings")
    return graph_summary(nodes, edges).crossJoin(worst).crossJoin(sizes).crossJoin(cycles)  # one row each


def ring_count(nodes: DataFrame, edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Independent cycles: edges - nodes + components."""
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(patterns.agg(F.count_distinct("component").alias("n_components"))).withColumn("n_rings", F.col("n_edges") - F.col("n_nodes") + F.col("n_components"))
