"""Distributed graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.workspace import drop, materialise


def _written(edges: DataFrame) -> DataFrame:
    """The edges written, with their number and a digest of them `observed`."""
    return materialise(edges, "edges", observe={"n": F.count(F.lit(1)), "x": F.expr("bit_xor(xxhash64(u, v))")})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """Components of the nodes that have edges: `(node, component)`, component = least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which end
    after O(log^2 n) rounds.  Every step is a partially aggregated minimum and
    a join, so a node with very many edges is combined before the shuffle and
    split by AQE after it; each round is written to the shared folder.  Nulls
    and self loops give no edge.  The joins are never broadcasts: a written
    table of sorted numbers looks small on disk, and each round would send it
    to the driver.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    e = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = _written(e)
    for _ in range(max_rounds):
        if not e.observed["n"]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, _written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(last)
        if e.observed == last.observed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
