"""Tables for maps of memberships: colours, ternary coordinates, small multiples, dominant class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rename_classes(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Membership columns renamed to class1..classn by position."""
    names = [f"class{i}" for i in range(1, len(cols) + 1)]
    return df.withColumnsRenamed(dict(zip(cols, names))), names


def _three(cols: list[str], mode: str) -> None:
    if len(cols) != 3:
        raise ValueError(f"mode '{mode}' needs exactly 3 classes, not {len(cols)}")


def rgb(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds `color`, '#RRGGBB' of three memberships in [0, 1]."""
    _three(cols, "RGB")
    channel = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255 + 0.5).cast("int") for c in cols]
    known = F.col(cols[0]).isNotNull() & F.col(cols[1]).isNotNull() & F.col(cols[2]).isNotNull()
    return df.withColumn("color", F.when(known, F.format_string("#%02X%02X%02X", *channel)))


def barycentric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds `left`, `top`, `right`: three memberships as shares of their sum."""
    _three(cols, "ternary1")
    total = F.nullif(F.col(cols[0]) + F.col(cols[1]) + F.col(cols[2]), F.lit(0.0))
    return df.withColumns({n: F.col(c) / total for n, c in zip(("left", "top", "right"), cols)})


def ternary_color(df: DataFrame, cols: list[str], chroma: float = 0.2, lightness: float = 0.8, contrast: float = 0.4) -> DataFrame:
    """Adds `tric_color`: three hues a third of a circle apart, mixed by the shares; greyer and by `contrast` darker near the centre.

    The mix is the vector sum of the hues (our own definition; other ternary
    scales differ in detail).
    """
    _three(cols, "ternary2")
    out = barycentric(df, cols)
    x = F.col("left") - (F.col("top") + F.col("right")) / 2
    y = (F.col("top") - F.col("right")) * F.lit(3**0.5 / 2)
    far = F.sqrt(x * x + y * y)
    light = F.lit(lightness) - F.lit(contrast) * (1 - far) / 2
    tint = lambda turn: light + F.lit(chroma) * far * F.cos(F.atan2(y, x) - F.lit(turn))
    channel = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tint(t))) * 255 + 0.5).cast("int") for t in (0.0, 2.0943951023931953, 4.1887902047863905)]
    return out.withColumn("tric_color", F.when(x.isNotNull(), F.format_string("#%02X%02X%02X", *channel))).drop("left", "top", "right")


def small_multiples(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per unit and class: the other columns, `Class`, `Probability`."""
    return df.unpivot([c for c in df.columns if c not in cols], cols, "Class", "Probability")


def dominant(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds `Max_Prob` (null if a class is null), `Dominant_Class` (the first on ties) and `alpha`, Max_Prob rescaled to [0.3, 1]."""
    missing: Column = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    top = F.when(~missing, F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]))
    place = F.array_position(F.array(*cols), top).cast("int")
    out = df.withColumn("Max_Prob", top).withColumn("Dominant_Class", F.when(place > 0, F.element_at(F.array(*map(F.lit, cols)), place)))
    ends = out.agg(F.min("Max_Prob").alias("__lo"), F.max("Max_Prob").alias("__hi"))
    span = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    out = out.join(F.broadcast(ends))  # one row
    alpha = F.when(F.col("Max_Prob").isNotNull(), F.coalesce(F.lit(0.3) + F.lit(0.7) * (F.col("Max_Prob") - F.col("__lo")) / span, F.lit(0.65)))
    return out.withColumn("alpha", alpha).drop("__lo", "__hi")


MODES: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"RGB": rgb, "ternary1": barycentric, "ternary2": ternary_color, "small multiples": small_multiples, "dominant": dominant}


def fuzzy_area(polygons: DataFrame, memberships: DataFrame, mode: str | None, auto_rename: bool = True, node: str = "node_id") -> DataFrame:
    """The table for a map of `memberships` (node and class columns) in one of `MODES`."""
    if mode is None:
        raise ValueError(f"choose a mode: {', '.join(MODES)}")
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}'; choose from {', '.join(MODES)}")
    if polygons.count() != memberships.count():
        raise ValueError("polygons and memberships must have as many rows")
    cols = [c for c in memberships.columns if c != node]
    if auto_rename:
        memberships, cols = rename_classes(memberships, cols)
    return MODES[mode](polygons.join(memberships, node), cols)


def numbered(df: DataFrame, order: list[str], name: str = "node_id") -> DataFrame:
    """Adds a dense number from 1 over an order, without a single-task sort: ranges are numbered, then their rows."""
    from terrane.sources.workspace import materialise

    parts = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(sizes.select("__part", before.alias("__before")), "__part").withColumn(name, F.col("__before") + rank).drop("__part", "__before")
