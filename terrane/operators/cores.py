"""Core regions: contiguous groups of units that surely belong to a class."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.attributes import numeric, require
from terrane.operators.contiguity import touch_edges
from terrane.operators.graph import connected_components
from terrane.sources.workspace import materialise


_log = logging.getLogger(__name__)


def class_cores(units: DataFrame, membership_cols: list[str], cutoff: float, node: str = "node_id") -> DataFrame:
    """`(cls, node_id, u)` of the memberships that reach the cutoff; missing ones do not."""
    long = units.select(F.col(node).alias("node_id"), *[F.col(c).cast("double") for c in membership_cols]).unpivot(["node_id"], membership_cols, "cls", "u")
    return long.where(~F.isnan("u") & (F.col("u") >= cutoff))


def core_regions(units: DataFrame, membership_cols: list[str] | None = None, cutoff: float = 0.5, queen: bool = True, edges: DataFrame | None = None, cell: float | None = None, node: str = "node_id") -> DataFrame:
    """`(cls, node_id, core_region_id)`: for each class the units with membership >= cutoff, their contiguous groups numbered from 1 by least node.

    Contiguity is exact touch of `rings` (in a line unless `queen`), or the
    given `edges`.  A class that no unit reaches has no rows.
    """
    if edges is None and "rings" not in units.columns:
        raise ValueError("units must have a 'rings' column")
    if not 0 <= cutoff <= 1:
        raise ValueError("cutoff must lie between 0 and 1")
    cols = membership_cols if membership_cols is not None else numeric(units, (node,))
    require(units, cols)
    core = class_cores(units, cols, cutoff, node)
    if edges is None:
        edges = touch_edges(units.join(core.select(F.col("node_id").alias(node)).distinct(), node, "left_semi"), queen, cell, node)
    a, b = (core.select("cls", F.col("node_id").alias(c)) for c in ("src", "dst"))
    own = edges.join(a.hint("merge"), "src").join(b.hint("merge"), ["cls", "dst"])
    # one run over all classes
    ids = core.select("cls", "node_id").withColumn("k", F.xxhash64("cls", "node_id"))
    key = lambda c: F.xxhash64("cls", c)
    parts = connected_components(own.select(key("src").alias("src"), key("dst").alias("dst"))).withColumnRenamed("node", "k")
    grouped = materialise(ids.join(parts.hint("merge"), "k", "left").select("cls", "node_id", F.coalesce("component", "k").alias("component")), "grouped")
    # groups are numbered, not their units: one row a group and class to sort
    first = grouped.groupBy("cls", "component").agg(F.min("node_id").alias("first"))
    number = first.select("cls", "component", F.row_number().over(Window.partitionBy("cls").orderBy("first")).alias("core_region_id"))
    return grouped.join(number.hint("merge"), ["cls", "component"]).select("cls", "node_id", "core_region_id")


def core_polygons(units: DataFrame, cores: DataFrame, membership_cols: list[str], node: str = "node_id", geometry: str = "rings") -> dict[str, DataFrame]:
    """For each class its core units, whole: the core region's number first, then the units' columns, the geometry last.

    A class without core units has an empty table and is logged.
    """
    there = {r["cls"] for r in cores.select("cls").distinct().collect()}  # a row per class
    rest = [c for c in units.columns if c != geometry]
    out = {}
    for c in membership_cols:
        if c not in there:
            _log.warning("no unit reaches the cutoff in class %s", c)
        own = cores.where(F.col("cls") == c).select(F.col("node_id").alias("__n"), F.col("core_region_id"))
        out[c] = own.join(units, F.col("__n") == F.col(node)).select("core_region_id", *rest, geometry)
    return out
