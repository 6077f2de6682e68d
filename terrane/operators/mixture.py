"""Gaussian mixtures per region, chosen by BIC, and membership-weighted type probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.attributes import constant_columns_by, numeric, require, with_geology

#: Covariance families: one or each component's (E, V) volume, shape and orientation, or none (I).
FAMILIES = ("EII", "VII", "EEI", "VVI", "EEE", "VVV")
#: With the families between these.  Of one variable there are two, E and V, which EII and VII give.
ALL_FAMILIES = (*FAMILIES, "VEI", "EVI", "VEE", "EEV", "VEV", "EVV", "EVE", "VVE")
MODEL = "region string, component int, pro double, vars array<string>, mean array<double>, sigma array<array<double>>, covariance_model string, bic double"


def parameters(family: str, g: int, p: int) -> int:
    """Free parameters: proportions, means, and of the covariances the volumes, shapes and orientations."""
    times = {"E": 1, "V": g, "I": 0}
    volume, shape, turn = (times[c] for c in family)
    return g - 1 + g * p + volume + shape * (p - 1) + turn * (p * (p - 1) // 2)


def log_density(x: np.ndarray, mean: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """log N(x; mean_k, sigma_k), rows by components; LinAlgError if a sigma is not positive definite."""
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        low = np.linalg.cholesky(sigma[k])
        z = np.linalg.solve(low, (x - mean[k]).T)
        out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def posterior(x: np.ndarray, pro: np.ndarray, mean: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, float]:
    """Component probabilities by row, and the log-likelihood."""
    with np.errstate(divide="ignore"):
        log = np.log(pro) + log_density(x, mean, sigma)
    top = log.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
    return np.exp(log - total), float(total.sum())


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (the last two axes) as volume, the p-th root of the determinant, and a matrix of determinant 1."""
    volume = np.exp(np.linalg.slogdet(m)[1] / m.shape[-1])
    return volume, m / volume[..., None, None]


def _common_axes(w: np.ndarray, inverse: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """A step towards the orthogonal D of least sum of tr(W_k D A_k^-1 D') (Browne and McNicholas 2014); `inverse`: diagonals of A_k^-1."""
    most = np.linalg.eigvalsh(w)[:, -1]
    f = np.einsum("kp,qp,kqr->pr", inverse, axes, w) - np.einsum("k,kp,qp->pq", most, inverse, axes)
    u, _, vt = np.linalg.svd(f)
    return -(vt.T @ u.T)


def _alternate(family: str, w: np.ndarray, size: np.ndarray, rounds: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Families without a closed form: volumes, shapes and common axes in turn until the objective stands."""
    g, p = len(w), w.shape[1]
    n, last = size.sum(), np.inf
    axes = np.linalg.eigh(w.sum(axis=0))[1]
    own = np.linalg.eigh(w)[1][:, :, ::-1]  # falling eigenvalues, so that shapes match
    shape = {"VEI": lambda s: s * np.eye(p), "VEE": lambda s: s, "VEV": lambda s: s * np.eye(p)}.get(family)
    turned = np.einsum("kqp,kqr,krs->kps", own, w, own) if family == "VEV" else w
    volume = np.full(g, 1.0)
    for _ in range(rounds):
        if shape:  # one shape (VEE: and orientation) at volumes of their own
            one = _unit(shape((turned / volume[:, None, None]).sum(axis=0)))[1]
            volume = np.einsum("pq,kqp->k", np.linalg.inv(one), turned) / (p * size)
            sigma = volume[:, None, None] * (own @ one @ own.transpose(0, 2, 1) if family == "VEV" else one)
        else:  # EVE, VVE: shapes of their own on common axes
            spread = np.einsum("qp,kqr,rp->kp", axes, w, axes)
            root = np.exp(np.log(spread).mean(axis=1))
            own_volume = root / size if family == "VVE" else np.full(g, root.sum() / n)
            scale = own_volume[:, None] * spread / root[:, None]
            sigma = np.einsum("pq,kq,rq->kpr", axes, scale, axes)
            axes = _common_axes(w, 1 / scale, axes)
        now = float(size @ np.linalg.slogdet(sigma)[1] + np.einsum("kpq,kqp->", w, np.linalg.inv(sigma)))
        if last - now <= tol * abs(now):
            break
        last = now
    return sigma


def covariances(family: str, x: np.ndarray, z: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """M-step of the covariances (Celeux and Govaert 1995)."""
    n, p = x.shape
    size = z.sum(axis=0)
    w = np.stack([((z[:, k, None] * (d := x - mean[k])).T @ d) for k in range(len(mean))])
    one, g = np.eye(p), len(mean)
    if family in ("EII", "EEI", "EEE"):
        s = w.sum(axis=0) / n
        s = {"EII": one * np.trace(s) / p, "EEI": np.diag(np.diag(s)), "EEE": s}[family]
        return np.repeat(s[None], g, axis=0)
    if family in ("EVI", "EVV"):
        volume, unit = _unit(w * one if family == "EVI" else w)
        return volume.sum() / n * unit
    if family == "EEV":
        values, axes = np.linalg.eigh(w)
        return np.einsum("kpq,q,krq->kpr", axes, values.sum(axis=0) / n, axes)
    if family in ALL_FAMILIES[len(FAMILIES) :]:
        return _alternate(family, w, size)
    s = w / np.maximum(size, 1e-300)[:, None, None]
    return {"VII": lambda: one * (np.trace(s, axis1=1, axis2=2) / p)[:, None, None], "VVI": lambda: s * one, "VVV": lambda: s}[family]()


def fit_mixture(x: np.ndarray, g: int, family: str, seed: int = 0, restarts: int = 3, rounds: int = 500, tol: float = 1e-5):
    """(loglik, pro, mean, sigma) by EM from the best of some k-means++ starts; None if every start degenerates."""
    best = None
    n, p = x.shape
    if g > n:
        return None
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    for start in range(1 if g == 1 else restarts):
        rng = np.random.Generator(np.random.PCG64([seed, g, ALL_FAMILIES.index(family), start]))
        u = x / scale
        centres = u[rng.integers(n)][None]
        while len(centres) < g:
            d = ((u[:, None] - centres[None]) ** 2).sum(-1).min(axis=1)
            centres = np.concatenate([centres, u[rng.choice(n, p=d / d.sum())][None] if d.sum() > 0 else u[rng.integers(n)][None]])
        for _ in range(10):
            near = ((u[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
            centres = np.stack([u[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(g)])
        z = (near[:, None] == np.arange(g)).astype(float)
        last = -np.inf
        try:
            for _ in range(rounds):
                size = z.sum(axis=0)
                if (size < 1e-8).any():
                    raise np.linalg.LinAlgError
                pro, mean = size / n, (z.T @ x) / size[:, None]
                sigma = covariances(family, x, z, mean)
                if min(np.linalg.eigvalsh(s)[0] / max(np.linalg.eigvalsh(s)[-1], 1e-300) for s in sigma) < 1e-12:
                    raise np.linalg.LinAlgError
                z, loglik = posterior(x, pro, mean, sigma)
                if abs(loglik - last) <= tol * (1 + abs(loglik)):
                    break
                last = loglik
        except np.linalg.LinAlgError:
            continue
        if best is None or loglik > best[0]:
            best = (loglik, pro, mean, sigma)
    return best


def fit_models(training: DataFrame, variables: dict[str, list[str]], components=range(1, 10), families=FAMILIES, seed: int = 0) -> DataFrame:
    """Models (one row per component) of every region of `training` (`region` and the variables).

    Fits of all (region, number of components, family) run as independent
    groups; the largest BIC = 2 loglik - parameters * ln(n) wins, ties to fewer
    parameters.  A region's training rows must fit one task.
    """
    if empty := sorted(set(variables) - {r["region"] for r in training.select("region").distinct().collect()}):
        raise ValueError(f"no training rows for {', '.join(empty)}")
    spark = training.sparkSession
    names = sorted({c for v in variables.values() for c in v})
    trials = spark.createDataFrame([(r, int(g), f) for r in sorted(variables) for g in components for f in families], "region string, g int, family string")
    rows = training.select("region", *[F.col(c).cast("double") for c in names]).join(F.broadcast(trials), "region")  # regions x components x families

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        region, g, family = key
        own = variables[region]
        x = frame[own].dropna().to_numpy(float)
        x = x[np.lexsort(x.T[::-1])]  # row order does not matter
        alone = len(own) == 1
        got = None if alone and family not in ("EII", "VII") else fit_mixture(x, int(g), family, seed)
        cols = ["region", "component", "pro", "vars", "mean", "sigma", "covariance_model", "bic", "npar"]
        if got is None:
            return pd.DataFrame(columns=cols)
        loglik, pro, mean, sigma = got
        npar = parameters(family, int(g), len(own))
        family = family[0] if alone else family
        bic = 2 * loglik - npar * np.log(len(x))
        return pd.DataFrame([(region, k + 1, pro[k], own, mean[k].tolist(), sigma[k].tolist(), family, bic, npar) for k in range(int(g))], columns=cols)

    fits = rows.groupBy("region", "g", "family").applyInPandas(fit, MODEL + ", npar int")
    best = fits.groupBy("region").agg(F.max(F.struct("bic", -F.col("npar"), "covariance_model")).alias("b"))
    return fits.join(best, "region").where((F.col("bic") == F.col("b.bic")) & (F.col("covariance_model") == F.col("b.covariance_model")) & (-F.col("npar") == F.col("b.col2"))).drop("b", "npar")


def type_probabilities(rows: DataFrame, models: DataFrame, node: str = "node_id", round_digits: int | None = 2) -> DataFrame:
    """`(node_id, region, component, p)`: posterior of every row in every region's mixture; stateless, so `rows` may be a stream.

    A row with a missing variable has p null.  Variables are matched by name.
    The models, one row per component, are broadcast.
    """
    kept = models.orderBy("region", "component").toPandas()
    plan = [(r, f["vars"].iloc[0], f["pro"].to_numpy(float), np.stack(f["mean"].to_list()), np.stack([np.stack(list(s)) for s in f["sigma"]])) for r, f in kept.groupby("region", sort=True)]
    names = sorted({c for _, v, *_ in plan for c in v})
    require(rows, names)

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for region, own, pro, mean, sigma in plan:
                x = frame[list(own)].to_numpy(float)
                ok = ~np.isnan(x).any(axis=1)
                z = np.full((len(x), len(pro)), np.nan)
                if ok.any():
                    z[ok] = posterior(x[ok], pro, mean, sigma)[0]
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(frame["node"].to_numpy(), len(pro))), pa.array([region] * (n * len(pro)), pa.string()), pa.array(np.tile(np.arange(1, len(pro) + 1, dtype=np.int32), n)), pa.array(z.ravel(), pa.float64(), from_pandas=True)],
                    ["node_id", "region", "component", "p"],
                )

    got = rows.select(F.col(node).cast("long").alias("node"), *[F.col(c).cast("double") for c in names]).mapInArrow(run, "node_id bigint, region string, component int, p double")
    return got if round_digits is None else got.withColumn("p", F.round("p", round_digits))


def weighted_types(probabilities: DataFrame, memberships: DataFrame) -> DataFrame:
    """`(node_id, region, component, p)`: each probability times the node's membership `u` in the region (`cls`)."""
    m = memberships.select("node_id", F.col("cls").alias("region"), "u")
    return probabilities.join(m, ["node_id", "region"]).select("node_id", "region", "component", (F.col("p") * F.col("u")).alias("p"))


def type_matrix(types: DataFrame, regions: dict[str, int]) -> DataFrame:
    """`(node_id, Region{i}RiverType{k}...)` for regions in the given order with their numbers of types."""
    cols: list[Column] = [F.max(F.when((F.col("region") == r) & (F.col("component") == k), F.col("p"))).alias(f"Region{i}RiverType{k}") for i, (r, n) in enumerate(regions.items(), 1) for k in range(1, n + 1)]
    return types.groupBy("node_id").agg(*cols)


def river_types(units: DataFrame, cores: DataFrame, membership_cols: list[str], n_types=range(1, 10), non_value_cols: tuple[str, ...] = (), families=FAMILIES, round_digits: int | None = 2, seed: int = 0, node: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(types matrix by node, models): a mixture per class's core units, its probabilities for all units, times membership.

    `cores` has cls and node_id.  Training drops the id, membership and
    `non_value_cols` columns and, per class, constant columns and the third of
    the geology shares when the two others are constant.
    """
    require(units, membership_cols)
    cols = numeric(units, (node, *membership_cols, *non_value_cols))
    training = units.join(cores.select(F.col("node_id").alias(node), F.col("cls").alias("region")), node).select("region", *cols)
    # one job for all classes: a row per class and constant column
    marked = constant_columns_by(training.withColumn("__there", F.lit(1)), "region", ["__there", *cols])
    constant: dict[str, set[str]] = {}
    for r in marked.collect():
        constant.setdefault(r["region"], set()).add(r["column"])
    variables = {}
    for c in membership_cols:
        if c not in constant:
            raise ValueError(f"no core units in class {c}")
        gone = with_geology([v for v in cols if v in constant[c]], cols)
        variables[c] = [v for v in cols if v not in gone]
        if not variables[c]:
            raise ValueError(f"every variable is constant in class {c}")
    models = fit_models(training, variables, n_types, families, seed)
    models = units.sparkSession.createDataFrame(models.toPandas(), MODEL)  # a few rows per region
    long = units.select(F.col(node).alias("node_id"), *[F.col(c).cast("double") for c in membership_cols]).unpivot(["node_id"], membership_cols, "cls", "u")
    types = weighted_types(type_probabilities(units, models, node, round_digits), long)
    sizes = {r["region"]: r["n"] for r in models.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
    return type_matrix(types, {c: sizes[c] for c in membership_cols}), models
