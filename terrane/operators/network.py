"""Spatial networks: nodes, edges, and bridges between components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.geometry import centroid
from terrane.operators.contiguity import SNAP, snap_edges
from terrane.operators.graph import connected_components
from terrane.sources.workspace import materialise


@dataclass
class SpatialNetwork:
    """`nodes` (the polygons), `edges` (src, dst, is_bridge), `contiguity_edges` (src, dst)."""

    nodes: DataFrame
    edges: DataFrame
    contiguity_edges: DataFrame


def components(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """`(node_id, component)` of every node, isolated ones too."""
    found = connected_components(edges)
    return nodes.select(F.col(node).alias("node_id")).join(found.withColumnRenamed("node", "node_id").hint("merge"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def neighbour_lists(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """`(node_id, neighbours)`: sorted neighbours of every node, an empty array for none."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lists = both.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    out = nodes.select(F.col(node).alias("node_id")).join(lists.hint("merge"), "node_id", "left")
    return out.select("node_id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def network_summary(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """One row: n_nodes, n_edges, n_components."""
    n = components(nodes, edges, node).agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("n_edges"))).select("n_nodes", "n_edges", "n_components")


def nearest_other(points: DataFrame, seekers: DataFrame, start: float, rounds: int = 60) -> DataFrame:
    """For every component of `seekers`, its closest pair (d2, lo, hi) with a point of another component, by growing grid rings.

    No join is a broadcast, which would send its side to the driver each round.
    At radius R points within R are in the 3 x 3 cells of side R around; a
    component with a hit within R is settled, as its other points are farther.
    """
    found, left, radius = None, seekers, start
    for _ in range(rounds):
        cell = lambda c: F.floor(F.col(c) / F.lit(radius))  # noqa: B023, E731
        around = left.withColumn("i", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("j", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        around = around.select("node_id", "x", "y", "component", (cell("x") + F.col("i")).alias("cx"), (cell("y") + F.col("j")).alias("cy"))
        other = points.select(F.col("node_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("component").alias("oc"), cell("x").alias("cx"), cell("y").alias("cy"))
        d2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        hits = around.join(other.hint("merge"), ["cx", "cy"]).where("component <> oc").select("component", d2.alias("d2"), F.least("node_id", "o").alias("lo"), F.greatest("node_id", "o").alias("hi"))
        best = hits.where(F.col("d2") <= F.lit(radius * radius)).groupBy("component").agg(F.min(F.struct("d2", "lo", "hi")).alias("best"))
        best = materialise(best, "hits")
        found = best if found is None else found.unionByName(best)
        left = materialise(left.join(best.hint("merge"), "component", "left_anti"), "left")
        if left.isEmpty():
            return found.select("component", "best.*")
        radius *= 2
    raise RuntimeError("points too far apart for the starting radius")


def closest_between(table: pa.Table) -> pa.Table:
    """`(a, b, d, src, dst)`: the closest points of every two components of two blocks, or of one; ties to the lower, then the higher id."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    names = ["node_id", "x", "y", "component"]
    block, order = table.column("block").to_numpy(), np.lexsort([table.column(c).to_numpy() for c in ("node_id", "component")])
    (p, px, py, pc), (q, qx, qy, qc) = ([table.column(c).to_numpy()[order[block[order] == k]] for c in names] for k in (i, j))
    parts = []
    if len(p) and len(q):
        left, right = (np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) for c in (pc, qc))
        for low, high in zip(left, [*left[1:], len(p)]):  # a component of the left block against all of the right
            best = None
            for k in range(low, high, 64):
                rows = slice(k, min(k + 64, high))
                d2 = (px[rows, None] - qx) ** 2 + (py[rows, None] - qy) ** 2
                least = np.minimum.reduceat(d2.min(axis=0), right)
                x, y = np.nonzero(d2 == np.repeat(least, np.diff([*right, len(q)])))
                got = np.stack([qc[y], np.minimum(p[rows][x], q[y]), np.maximum(p[rows][x], q[y])])
                found = (d2[x, y], got) if best is None else (np.r_[best[0], d2[x, y]], np.concatenate([best[1], got], axis=1))
                by = np.lexsort([found[1][2], found[1][1], found[0], found[1][0]])
                by = by[np.r_[True, np.diff(found[1][0][by]) != 0]]
                best = found[0][by], found[1][:, by]
            keep = best[1][0] > pc[low] if i == j else best[1][0] != pc[low]
            own = np.full(keep.sum(), pc[low])
            c, src, dst = best[1][:, keep]
            parts.append((np.minimum(own, c), np.maximum(own, c), np.sqrt(best[0][keep]), src, dst))
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64)]
    return pa.table(dict(zip(["a", "b", "d", "src", "dst"], cols)))


def bridge_edges(points: DataFrame, edges: DataFrame, start: float | None = None) -> DataFrame:
    """`(src, dst, distance)`: the edges that join the components at least total distance.

    `points` has node_id, x, y.  Equal to adding the closest pair of different
    components again and again, in the order (distance, lower id, higher id):
    rounds in which every component but the largest takes its closest pair.
    """
    state = materialise(points.select("node_id", "x", "y").join(components(points, edges).hint("merge"), "node_id"), "points")
    if start is None:
        s = state.agg(F.count(F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        start = max(s[1] or 0.0, s[2] or 0.0, 1e-9) / max(1.0, float(s[0])) ** 0.5
    out = points.sparkSession.createDataFrame([], "src bigint, dst bigint, distance double")
    while True:
        sizes = state.groupBy("component").count()
        top = sizes.orderBy(F.desc("count"), "component").limit(2).collect()
        if len(top) < 2:
            return out
        new = nearest_other(state, state.where(F.col("component") != top[0]["component"]), start)
        new = materialise(new.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.sqrt("d2").alias("distance")).distinct(), "bridges")
        out = out.unionByName(new)
        label = lambda c: state.select(F.col("node_id").alias(c), F.col("component").alias(f"{c}_part")).hint("merge")  # noqa: B023, E731
        merged = connected_components(new.join(label("src"), "src").join(label("dst"), "dst"), "src_part", "dst_part").select(F.col("node").alias("component"), F.col("component").alias("into"))
        state = materialise(state.join(merged.hint("merge"), "component", "left").select("node_id", "x", "y", F.coalesce("into", "component").alias("component")), "points")


def connect_components(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """`(src, dst, is_bridge)`: the edges and the bridges between their components, by centroid distance."""
    c = nodes.select(F.col(node).alias("node_id"), centroid(F.col("rings")).alias("c")).select("node_id", "c.x", "c.y")
    return edges.select("src", "dst", F.lit(False).alias("is_bridge")).unionByName(bridge_edges(c, edges).select("src", "dst", F.lit(True).alias("is_bridge")))


def spatial_network(polygons: DataFrame, contiguity: str = "queen", min_shared_length: float = 0.0, connect_islands: bool = True, snap: float = SNAP, node: str = "node_id") -> SpatialNetwork:
    """Neighbours of `polygons` (with `rings`) as a network; `connect_islands` adds bridges until it is connected."""
    if "rings" not in polygons.columns:
        raise ValueError("polygons must have a 'rings' column")
    near = materialise(snap_edges(polygons, contiguity, snap, min_shared_length, node), "contiguity")
    edges = connect_components(polygons, near, node) if connect_islands else near.withColumn("is_bridge", F.lit(False))
    return SpatialNetwork(polygons, edges, near)


def polygon_to_network(polygons: DataFrame, min_shared_length: float = 0.0, connect_islands: bool = True, node: str = "node_id") -> SpatialNetwork:
    """Queen contiguity."""
    return spatial_network(polygons, "queen", min_shared_length, connect_islands, node=node)


def dev_polygon_to_network(polygons: DataFrame, min_shared_length: float = 0.0, connect_islands: bool = True, node: str = "node_id") -> SpatialNetwork:
    """Rook contiguity, which this variant runs although it is described as queen."""
    return spatial_network(polygons, "rook", min_shared_length, connect_islands, node=node)
