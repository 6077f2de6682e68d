"""Spatial units made from the driver's tables: customers on a square grid, with order statistics as variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geometry import unit_square

HOLES = ("MACHINERY", "BUILDING")
VARIABLES = ["v1", "v2", "v3"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(node_id, v2, v3)` of customers with pending orders: their sum and number."""
    pending = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return pending.groupBy(F.col("o_custkey").alias("node_id")).agg(F.sum("o_totalprice").alias("v2"), F.count(F.lit(1)).alias("v3"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(node_id, gx, gy, v1, segment, nation)`."""
    c = read(spark, sf_dir, "customer")
    side = c.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("w"))  # one row
    out = c.join(F.broadcast(side)).select(F.col("c_custkey").cast("long").alias("node_id"), F.expr("c_custkey % w").alias("gx"), F.expr("c_custkey div w").alias("gy"), F.col("c_acctbal").alias("v1"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return out


def units(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """Cells with `rings`, the centre `x, y`, and variables v1, v2, v3 (null without pending orders)."""
    c = cells(spark, sf_dir)
    if holes:
        c = c.where(~F.col("segment").isin(*HOLES))
    out = c.join(attributes(spark, sf_dir).hint("merge"), "node_id", "left")
    return out.withColumns({"rings": unit_square(F.col("gx"), F.col("gy")), "x": F.col("gx") + 0.5, "y": F.col("gy") + 0.5})


#: The same in DuckDB's SQL: `u` (all units) and `h` (with holes).
UNITS_SQL = """
w AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer),
p AS (SELECT o_custkey, sum(o_totalprice) AS v2, count(*) AS v3 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
u AS (SELECT c_custkey AS node_id, c_custkey % w AS gx, c_custkey // w AS gy, c_acctbal AS v1, p.v2, p.v3, c_mktsegment AS segment, c_nationkey AS nation
  FROM customer CROSS JOIN w LEFT JOIN p ON o_custkey = c_custkey),
h AS (SELECT * FROM u WHERE segment NOT IN ('MACHINERY', 'BUILDING'))"""
EDGES_SQL = {
    "queen": "SELECT a.node_id AS src, b.node_id AS dst FROM {t} a JOIN {t} b ON a.node_id < b.node_id AND greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1",
    "rook": "SELECT a.node_id AS src, b.node_id AS dst FROM {t} a JOIN {t} b ON a.node_id < b.node_id AND abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1",
}


def components_sql(nodes: str, edges: str) -> str:
    """CTEs `reach` and `comp` (node_id, component) for a recursive WITH."""
    return f"""reach AS (SELECT node_id, node_id AS m FROM {nodes} UNION
  SELECT e.b, r.m FROM reach r JOIN (SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}) e ON e.a = r.node_id WHERE r.m < e.b),
comp AS (SELECT node_id, min(m) AS component FROM reach GROUP BY 1)"""
