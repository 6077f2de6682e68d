"""Bounded samples of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.workspace import materialise


def bounded_sample(rows: DataFrame, group: str, key: str, bound: int) -> DataFrame:
    """About `bound` rows of each group (none of the null one): those with the least hash of `key`.

    The share to keep comes from counts over all rows, so no group is gathered
    or sorted, and there may be any number of groups: their counts are joined.
    All rows are kept of a group within the bound; a larger one gives `bound`
    rows in expectation.  The counts are written first, so that the size of
    their files decides on the join and a small one leaves the rows in place.
    """
    counts = materialise(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n")), "counts")
    place = F.pmod(F.xxhash64(F.lit(23), key), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(counts, group).where(place < F.lit(float(bound)) / F.col("__n")).select(*rows.columns)
