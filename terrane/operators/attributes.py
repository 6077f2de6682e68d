"""Attribute joins, missing values, standardising and edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.sources.workspace import materialise


def numeric(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def attach(units: DataFrame, attributes: DataFrame, key: str, digits: dict[str, int] | None = None) -> DataFrame:
    """Units that have attributes (left-semi), with them (left join); columns of `digits` rounded half up."""
    require(units, [key])
    require(attributes, [key])
    out = units.join(attributes.select(key), key, "left_semi").join(attributes, key, "left")
    return out.withColumns({c: F.round(c, n) for c, n in (digits or {}).items()})


def na_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """`(column, n_missing)`, NaN counted as missing; one pass."""
    require(df, cols)
    one = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "n_missing")


def _missing(df: DataFrame, c: str) -> Column:
    nan = F.isnan(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
    return F.col(c).isNull() | nan


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def nearest_donor(units: DataFrame, column: str, start: float, node: str = "node_id", rounds: int = 60) -> DataFrame:
    """`(node_id, donor_id, value)` for every unit whose `column` is missing: the closest unit (x, y) that has it, least id on ties.

    Donors are looked up in grid cells of side R around, with R doubled for
    those who have found none within R.  Donors' values are the originals.
    Without any donor there are no rows.
    """
    have = units.where(~_missing(units, column)).select(F.col(node).alias("donor_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col(column).alias("value"))
    left = materialise(units.where(_missing(units, column)).select(F.col(node).alias("node_id"), "x", "y"), "left")
    out = None
    if have.isEmpty():
        rounds = 0
    for k in range(rounds):
        radius = start * 2.0**k
        cell = lambda c: F.floor(F.col(c) / F.lit(radius))  # noqa: B023, E731
        around = left.withColumn("i", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("j", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        around = around.select("node_id", "x", "y", (cell("x") + F.col("i")).alias("cx"), (cell("y") + F.col("j")).alias("cy"))
        d2 = ((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2).alias("d2")
        hits = around.join(have.withColumns({"cx": cell("ox"), "cy": cell("oy")}), ["cx", "cy"]).select("node_id", d2, "donor_id", "value").where(F.col("d2") <= F.lit(radius * radius))
        best = materialise(hits.groupBy("node_id").agg(F.min(F.struct("d2", "donor_id", "value")).alias("b")).select("node_id", "b.donor_id", "b.value"), "best")
        out = best if out is None else out.unionByName(best)
        left = materialise(left.join(best, "node_id", "left_anti"), "left")
        if left.isEmpty():
            break
    if out is None:
        out = left.select("node_id", F.lit(None).cast("long").alias("donor_id"), F.lit(None).cast("double").alias("value")).limit(0)
    return out


def impute_nearest(units: DataFrame, columns: list[str], start: float, node: str = "node_id") -> DataFrame:
    """`units` with missing values of `columns` taken from the nearest donor of each column."""
    out = units
    for c in columns:
        fill = nearest_donor(units, c, start, node).select(F.col("node_id").alias(node), F.col("value").alias("__fill"))
        out = out.join(fill, node, "left").withColumn(c, F.when(_missing(units, c), F.col("__fill")).otherwise(F.col(c))).drop("__fill")
    return out


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns centred and divided by the sample standard deviation; null where that is 0 or null."""
    require(df, cols)
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    out = df.join(F.broadcast(stats))  # one row
    out = out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in cols})
    return out.drop(*[f"__{k}_{c}" for k in "ms" for c in cols])


def add_edge_weight(nodes: DataFrame, edges: DataFrame, id_col: str | list[str] | None = None, variables: list[str] | None = None, node: str = "node_id") -> DataFrame:
    """`(src, dst, weight)`: Euclidean distance of the end nodes' standardised variables.

    `variables` are used if given (they must exist and be numeric), else every
    numeric column but `id_col` and the node id.  A variable that is null at
    either end is left out and the squared sum scaled up to all variables; a
    weight is null if every variable is.  One row per pair, whatever order and
    however often the edge is given.
    """
    skip = (node, *([id_col] if isinstance(id_col, str) else id_col or []))
    cols = list(variables) if variables is not None else numeric(nodes, skip)
    require(nodes, cols)
    if not cols:
        raise ValueError("no variables to weigh edges by")
    if bad := [c for c in cols if c not in numeric(nodes)]:
        raise ValueError(f"variables are not numeric: {', '.join(bad)}")
    z = zscore(nodes.select(F.col(node).alias("__n"), *cols), cols)
    v = z.select("__n", F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = pairs.join(v.select(F.col("__n").alias("src"), F.col("v").alias("a")), "src").join(v.select(F.col("__n").alias("dst"), F.col("v").alias("b")), "dst")
    squares = F.filter(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), lambda x: x.isNotNull())
    total = F.aggregate("sq", F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("sq", squares).select("src", "dst", F.sqrt(total * float(len(cols)) / F.nullif(F.size("sq"), F.lit(0))).alias("weight"))


def heaviest_edges(edges: DataFrame, group: str, k: int) -> DataFrame:
    """The `k` heaviest edges of each group, by (weight, then src and dst ascending); null and NaN weights last."""
    w = Window.partitionBy(group).orderBy(F.when(~F.isnan("weight"), F.col("weight")).desc_nulls_last(), "src", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def constant_columns_by(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """`(by, column)`: the columns with one different value in a group, null counted as a value; one aggregate for all groups."""
    n = df.groupBy(by).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias(c) for c in cols])
    return n.unpivot([by], cols, "column", "n").where("n = 1").select(by, "column")


def constant_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with one different value, null counted as a value."""
    if not cols:
        return []
    found = {r["column"] for r in constant_columns_by(df.withColumn("__all", F.lit(1)), "__all", cols).collect()}
    return [c for c in cols if c in found]


#: Shares of an area that add up to a constant.
GEOLOGY = ("area_sediment", "area_calcareous", "area_siliceous")


def with_geology(constant: list[str], cols: list[str]) -> list[str]:
    """The constant columns, and the third geology share where the two others are constant."""
    for c in GEOLOGY:
        if c in cols and c not in constant and all(o in constant for o in GEOLOGY if o != c):
            return [*constant, c]
    return constant


def dropped_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Constant columns, and the third geology share where the two others are constant."""
    return with_geology(constant_columns(df, cols), cols)
