"""Comparing river types: Bhattacharyya distances and principal components of centroids."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
DET_FLOOR = 1e-10


def bhattacharyya_dist(mu1, sigma1, mu2, sigma2, det_floor: float | None = DET_FLOOR) -> float:
    """Bhattacharyya distance of two Gaussians; scalars count as one dimension.

    With `det_floor` the product of the two determinants is kept at least that
    large, so that small covariances give values below 0; None is exact.
    """
    d = np.atleast_1d(np.asarray(mu1, float)) - np.atleast_1d(np.asarray(mu2, float))
    s1, s2 = np.atleast_2d(np.asarray(sigma1, float)), np.atleast_2d(np.asarray(sigma2, float))
    mid = (s1 + s2) / 2
    far = float(d @ np.linalg.solve(mid, d)) / 8
    if det_floor is None:
        log_mid, log_1, log_2 = (np.linalg.slogdet(s)[1] for s in (mid, s1, s2))
        return far + 0.5 * float(log_mid - (log_1 + log_2) / 2)
    return far + 0.5 * float(np.log(np.linalg.det(mid) / np.sqrt(max(np.linalg.det(s1) * np.linalg.det(s2), det_floor))))


def shared_variables(models: DataFrame, region: str = "region") -> list[str]:
    """Variables of all models, in the first region's order."""
    rows = models.groupBy(region).agg(F.first("vars").alias("vars")).orderBy(region).collect()
    return [v for v in (rows[0]["vars"] if rows else []) if all(v in r["vars"] for r in rows)]


def pair_distances(types: DataFrame, vars: list[str] | None = None, det_floor: float | None = DET_FLOOR) -> DataFrame:
    """`(a, b, distance)`, a < b, of `types` (id, vars, mean, sigma) on the shared variables (null if there are none)."""
    other = types.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "vars", "mean", "sigma")])
    pairs = types.join(other, F.col("id") < F.col("id_b"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                use = [v for v in r["vars"] if v in r["vars_b"]] if vars is None else vars
                if not use:
                    out.append(None)
                    continue
                i, j = ([r[c].index(v) for v in use] for c in ("vars", "vars_b"))
                out.append(bhattacharyya_dist(np.array(r["mean"])[i], np.array(r["sigma"])[np.ix_(i, i)], np.array(r["mean_b"])[j], np.array(r["sigma_b"])[np.ix_(j, j)], det_floor))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("id_b"), pa.array(out, pa.float64())], ["a", "b", "distance"])

    kind = types.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}, distance double")


def compare_river_types(models: DataFrame, det_floor: float | None = DET_FLOOR) -> DataFrame:
    """`(a, b, distance)`: the whole symmetric matrix with a zero diagonal, over types `M{region number}_K{component}`."""
    shared = shared_variables(models)
    if not shared:
        log.warning("the models share no variable; distances are null")
    order = {r["region"]: i for i, r in enumerate(models.select("region").distinct().orderBy("region").collect(), 1)}
    number = F.create_map(*[x for r, i in order.items() for x in (F.lit(r), F.lit(i))]) if order else F.create_map()
    types = models.select(F.concat(F.lit("M"), number[F.col("region")], F.lit("_K"), F.col("component")).alias("id"), "vars", "mean", "sigma")
    upper = pair_distances(types, shared, det_floor)
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    return upper.unionByName(lower).unionByName(types.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")))


def principal_components(x: np.ndarray) -> np.ndarray:
    """Scores of centred, scaled rows, each component's largest loading made positive; constant columns are refused."""
    sd = x.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
    if (sd == 0).any():
        raise ValueError("a constant variable cannot be scaled")
    z = (x - x.mean(axis=0)) / sd
    _, _, load = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(load[np.arange(len(load)), np.abs(np.round(load, 9)).argmax(axis=1)])
    return z @ (load * sign[:, None]).T


def river_centroids(models: DataFrame) -> DataFrame:
    """`(PC1..PCq, TypeID, Region)`: principal components of all type centroids on the shared variables."""
    shared = shared_variables(models)
    if len(shared) < 2:
        raise ValueError("fewer than two variables are common to all models")
    rows = models.orderBy("region", "component").collect()  # one row per type
    score = principal_components(np.array([[r["mean"][r["vars"].index(v)] for v in shared] for r in rows], float))
    data = [(*map(float, s), f"{r['region']}_Type{r['component']}", r["region"]) for s, r in zip(score, rows)]
    return models.sparkSession.createDataFrame(data, ", ".join(f"PC{i + 1} double" for i in range(score.shape[1])) + ", TypeID string, Region string")
