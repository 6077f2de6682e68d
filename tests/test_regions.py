import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import compare, mixture, present
from terrane.operators import regionalise as R


def lattice(spark, n=10, seed=0):
    rng = np.random.default_rng(seed)
    e = [(y * n + x, y * n + x + 1) for y in range(n) for x in range(n - 1)] + [(y * n + x, y * n + x + n) for y in range(n - 1) for x in range(n)]
    return spark.createDataFrame([(a, b, float(rng.random())) for a, b in e], "src long, dst long, weight double")


def test_trees_and_cuts():
    src, dst = np.array([1, 2, 3, 1, 2]), np.array([2, 3, 4, 4, 4])
    g = R.Graph(src, dst, np.array([1.0, 5, 3, 5, 2]))
    for t in range(40):
        tree = g.spanning_tree(np.random.default_rng(t))
        assert len(set(tree.tolist())) == 3 and g.labels(tree).max() == 1
        assert g.labels(g.cut(tree, 1)).max() == 1 and g.labels(g.cut(tree, 3)).max() == 3
    path = R.Graph(np.array([1, 2, 3, 4]), np.array([2, 3, 4, 5]), np.array([1.0, 5, 3, 5]))
    assert path.labels(path.cut(np.arange(4), 2)).tolist() == [1, 1, 2, 2, 2]


def test_trees_are_uniform():
    g = R.Graph(np.array([0, 1, 2, 0]), np.array([1, 2, 3, 3]), np.ones(4))
    rng = np.random.default_rng(5)
    seen = Counter(tuple(g.spanning_tree(rng)) for _ in range(4000))
    assert len(seen) == 4 and sum((v - 1000) ** 2 / 1000 for v in seen.values()) < 16.3


def test_skater_on_lattice(spark):
    e = lattice(spark)
    labels = R.tree_labels(e, 20, 12, seed=4)
    counts = labels.groupBy("tree_id").agg(F.countDistinct("label").alias("k"), F.count("*").alias("n")).collect()
    assert len(counts) == 12 and {(r["k"], r["n"]) for r in counts} == {(20, 100)}
    assert len(R.wide_labels(labels, 12).columns) == 13
    rows = R.skater_con(e, 5, 12, 20, seed=4).orderBy("node_id").collect()
    again = R.skater_con(e.repartition(7), 5, 12, 20, seed=4).orderBy("node_id").collect()
    assert rows == again and len(rows) == 100
    assert all(sum(r[1:]) == pytest.approx(1) for r in rows) and sum(1.0 in r[1:] for r in rows) >= 5
    assert {r["X1"] for r in R.skater_con(e, 1, 3, 4).collect()} == {1.0}
    with pytest.raises(ValueError):
        R.skater_con(e, 2, 3, 4, fuzziness=1.0)
    with pytest.raises(ValueError):
        R.tree_labels(e, 101, 2)
    with pytest.raises(ValueError):
        R.tree_labels(e.where("src <> 0 and dst <> 99").unionByName(spark.createDataFrame([(500, 501, 1.0)], e.schema)), 2, 2)


def test_pam_has_no_better_swap():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 4, (24, 9))
    d, w = R.mismatches(sig).astype(float), rng.integers(1, 4, 24).astype(float)
    m = R.pam(d, w, 3)
    cost = lambda s: w @ d[:, list(s)].min(axis=1)
    for i, c in itertools.product(range(3), range(24)):
        assert cost(m) <= cost([*m[:i], *m[i + 1 :], c]) + 1e-6
    assert R.pam(d, w, 1) == [int((w @ d).argmin())]


def test_membership_formula(spark):
    d = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.4), (2, 1, 0.0), (2, 2, 0.0), (3, 1, 0.5), (3, 2, 0.0)], "node_id long, medoid int, distance double")
    u = {(r["node_id"], r["medoid"]): r["u"] for r in R.fuzzy_membership(d).collect()}
    assert u[1, 1] == pytest.approx(0.8) and u[1, 2] == pytest.approx(0.2)
    assert (u[2, 1], u[2, 2], u[3, 1], u[3, 2]) == (1, 0, 0, 1)


def test_mixture_recovers_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 5, 10)])
    rows = spark.createDataFrame([(i, "X1", *map(float, v), 1.0) for i, v in enumerate(x)], "node_id long, region string, a double, b double, same double")
    models = mixture.fit_models(rows, {"X1": ["a", "b"]}, range(1, 5), ("EII", "VVV"))
    got = models.orderBy("component").collect()
    assert len(got) == 3 and sorted(round(r["mean"][0]) for r in got) == [0, 5, 10]
    p = mixture.type_probabilities(rows, models, round_digits=None)
    assert all(abs(r["s"] - 1) < 1e-9 for r in p.groupBy("node_id").agg(F.sum("p").alias("s")).collect())
    with pytest.raises(ValueError):
        mixture.fit_models(rows, {"X1": ["a"], "X2": ["a"]})


def test_river_types(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(rng.normal(5 * (i % 2))), float(rng.normal()), 3.0, 0.9 if i < 40 else 0.1, 0.1 if i < 40 else 0.9) for i in range(80)]
    u = spark.createDataFrame(data, "node_id long, a double, b double, k double, X1 double, X2 double")
    core = u.select("node_id", F.when(F.col("X1") > 0.5, "X1").otherwise("X2").alias("cls"))
    wide, models = mixture.river_types(u, core, ["X1", "X2"], [1, 2], families=("EII",))
    row = wide.where("node_id = 0").first().asDict()
    assert row["Region1RiverType1"] + row["Region1RiverType2"] == pytest.approx(0.9)
    assert {tuple(r["vars"]) for r in models.select("vars").collect()} == {("a", "b")}
    with pytest.raises(ValueError):
        mixture.river_types(u, core.where("cls = 'X1'"), ["X1", "X2"], [1])


@pytest.mark.parametrize("family", mixture.FAMILIES)
def test_families(family):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (50, 2)), rng.normal(8, 2, (50, 2))])
    loglik, pro, mean, sigma = mixture.fit_mixture(x, 2, family)
    assert sorted(np.round(mean[:, 0] / 8).tolist()) == [0, 1] and pro.sum() == pytest.approx(1)
    if family[0] == "E":
        assert np.allclose(sigma[0], sigma[1])
    if family[1:] == "II":
        assert np.allclose(sigma[0], np.eye(2) * sigma[0][0, 0])
    assert mixture.fit_mixture(x[:1], 2, family) is None


def test_bhattacharyya():
    one = np.eye(2)
    assert compare.bhattacharyya_dist([0, 0], one, [2, 0], one) == pytest.approx(0.5)
    assert compare.bhattacharyya_dist([0, 0], one * 1e-4, [0, 0], one * 1e-4) == pytest.approx(-3.4539, abs=1e-4)
    assert compare.bhattacharyya_dist([0, 0], one * 1e-4, [0, 0], one * 1e-4, None) == pytest.approx(0)
    assert compare.bhattacharyya_dist(0, 1, 2, 1) == pytest.approx(0.5)


def model(spark, *rows):
    full = [(r, c, 1.0, v, m, np.eye(len(v)).tolist(), "EII", 0.0) for r, c, v, m in rows]
    return spark.createDataFrame(full, mixture.MODEL)


def test_compare_shared_variables(spark):
    m = model(spark, ("A", 1, ["a", "b", "c"], [0.0, 0.0, 9.0]), ("B", 1, ["b", "c", "d"], [0.0, 9.0, 5.0]))
    assert compare.shared_variables(m) == ["b", "c"]
    got = {(r["a"], r["b"]): r["distance"] for r in compare.compare_river_types(m).collect()}
    assert got == {("M1_K1", "M2_K1"): pytest.approx(0), ("M2_K1", "M1_K1"): pytest.approx(0), ("M1_K1", "M1_K1"): 0, ("M2_K1", "M2_K1"): 0}
    none = model(spark, ("A", 1, ["a"], [0.0]), ("B", 1, ["b"], [0.0]))
    assert {r["distance"] for r in compare.compare_river_types(none).where("a <> b").collect()} == {None}
    assert compare.compare_river_types(none.where("region = 'A'")).count() == 1
    with pytest.raises(ValueError):
        compare.river_centroids(none)


def test_maps(spark):
    m = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.5, 0.5, 0.0), (3, None, 0.2, 0.8)], "node_id long, a double, b double, c double")
    p = m.select("node_id")
    table = lambda mode, **k: {r["node_id"]: r for r in present.fuzzy_area(p, m, mode, **k).collect()}
    assert [table("RGB")[i]["color"] for i in (1, 2, 3)] == ["#FF0000", "#808000", None]
    d = table("dominant")
    assert (d[2]["Dominant_Class"], d[2]["alpha"], d[1]["alpha"], d[3]["Max_Prob"]) == ("class1", 0.3, 1.0, None)
    assert table("dominant", auto_rename=False)[1]["Dominant_Class"] == "a"
    assert present.fuzzy_area(p, m, "small multiples").count() == 9
    assert table("ternary1")[2]["top"] == 0.5 and table("ternary2")[1]["tric_color"].startswith("#")
    for bad in (None, "pie"):
        with pytest.raises(ValueError):
            present.fuzzy_area(p, m, bad)
    with pytest.raises(ValueError):
        present.fuzzy_area(p.limit(1), m, "RGB")
    with pytest.raises(ValueError):
        present.fuzzy_area(p, m.drop("c"), "RGB")


def test_stream_scores(spark, tmp_path):
    from terrane.streaming.score import score_stream, write_scores

    m = model(spark, ("A", 1, ["a"], [0.0]), ("A", 2, ["a"], [4.0])).withColumn("pro", F.lit(0.5))
    rows = spark.createDataFrame([(1, 0.0), (2, 4.0), (3, None)], "node_id long, a double")
    rows.write.parquet(str(tmp_path / "in"))
    write_scores(score_stream(spark, str(tmp_path / "in"), rows.schema, m), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["node_id"], r["component"]): r["p"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 1] == 1.0 and got[2, 2] == 1.0 and got[3, 1] is None


def test_tiles(spark, tmp_path):
    import struct

    from terrane.sources.spatial import read_tiles, rim, tile_edges, tile_summary

    def wkb(x):
        ring = [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0)]
        return bytearray(b"\x01" + struct.pack("<III", 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in ring))

    for t in range(2):
        spark.createDataFrame([(3 * t + i, wkb(3 * t + i)) for i in range(3)], "k long, geometry binary").coalesce(1).write.parquet(str(tmp_path / f"tiles/t={t}"))
    tiles = read_tiles(spark, str(tmp_path / "tiles"), order="k").cache()
    assert sorted(r["node_id"] for r in tiles.collect()) == [1, 2, 3, 4, 5, 6]
    inside, between = tile_edges(tiles, "rook")
    assert inside.count() == 4 and [tuple(r) for r in between.collect()] == [(3, 4)]
    assert tile_summary(tiles).count() == 2 and rim(tiles).count() == 6


def test_registered_river_types_try_more_than_three_components(spark):
    from terrane.plans import queries

    got = queries.river_types_full(spark, "/root/testdata/sf0.001")
    assert max(int(c.split("RiverType")[1]) for c in got.columns if c != "node_id") > 3


def _near_member(rng, family, sigma, step):
    """Covariances of the same family close to `sigma`."""
    g, p = len(sigma), sigma.shape[1]
    volume = np.exp(np.linalg.slogdet(sigma)[1] / p)
    if family[2] == "V":
        values, axes = np.linalg.eigh(sigma)
    else:
        axes = np.repeat((np.eye(p) if family[2] == "I" else np.linalg.eigh(sigma[0])[1])[None], g, axis=0)
        values = np.einsum("kqp,kqr,krp->kp", axes, sigma, axes)
    shape = values / volume[:, None]
    change = lambda letter, size: np.zeros((g, size)) if letter == "I" else np.repeat(rng.normal(0, step, (1, size)), g, axis=0) if letter == "E" else rng.normal(0, step, (g, size))
    volume = volume * np.exp(change(family[0], 1)[:, 0])
    bent = change(family[1], p)
    shape = shape * np.exp(bent - bent.mean(axis=1, keepdims=True))
    skew = change(family[2], p * p).reshape(g, p, p)
    skew = skew - skew.transpose(0, 2, 1)
    turn = np.linalg.solve(np.eye(p) + skew / 2, np.eye(p) - skew / 2)  # Cayley: orthogonal
    axes = turn @ axes
    return volume[:, None, None] * np.einsum("kpq,kq,krq->kpr", axes, shape, axes)


@pytest.mark.parametrize("family", mixture.ALL_FAMILIES)
def test_m_step_is_best_in_its_family(family):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + 4 * k for k in range(3)])
    z = rng.dirichlet([0.3] * 3, len(x))
    size = z.sum(axis=0)
    mean = (z.T @ x) / size[:, None]
    w = np.stack([((z[:, k, None] * (x - mean[k])).T @ (x - mean[k])) for k in range(3)])
    cost = lambda s: float(size @ np.linalg.slogdet(s)[1] + np.einsum("kpq,kqp->", w, np.linalg.inv(s)))
    sigma = mixture.covariances(family, x, z, mean)
    assert np.allclose(_near_member(rng, family, sigma, 0), sigma, atol=1e-6)
    best = cost(sigma)
    tol = 1e-3 if family in ("EVE", "VVE") else 1e-7
    assert all(cost(_near_member(rng, family, sigma, step)) >= best - tol for step in (0.3, 0.05, 0.01) for _ in range(40))


def test_parameter_counts():
    assert {f: mixture.parameters(f, 2, 3) - 7 for f in mixture.ALL_FAMILIES} == {"EII": 1, "VII": 2, "EEI": 3, "VVI": 6, "EEE": 6, "VVV": 12, "VEI": 4, "EVI": 5, "VEE": 7, "EEV": 9, "VEV": 10, "EVV": 11, "EVE": 8, "VVE": 9}


def test_label_distance_in_blocks_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), t, int(v)) for i in range(40) for t, v in enumerate(rng.integers(-3, 3, 7)) if (i + t) % 9]
    rows += [rows[0], (3, 2, None)]  # a row twice counts twice, as in a join
    monkeypatch.setattr(R, "BLOCK", 8)
    df = R.label_distance(spark.createDataFrame(rows, "node_id long, tree_id int, label int"))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()  # no row for each label that a pair shares
    want = Counter((a[0], b[0]) for a, b in itertools.product(rows, rows) if a[0] < b[0] and a[1] == b[1] and a[2] == b[2] and a[2] is not None)
    assert {(r["a"], r["b"]): r["distance"] for r in df.collect()} == {k: 1 - n / 7 for k, n in want.items()}


def test_distributed_pam_equals_pam(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5)
    for seed, k in ((1, 4), (2, 3), (5, 2), (3, 1)):
        rng = np.random.default_rng(seed)
        sig = np.unique(rng.integers(1, 4, (45, 5)), axis=0)
        rng.shuffle(sig)
        w = rng.integers(1, 6, len(sig))
        want = R.pam(R.mismatches(sig), w.astype(float), k)
        kinds = spark.createDataFrame([(i, int(n), v.tolist()) for i, (n, v) in enumerate(zip(w, sig))], "rep long, n long, v array<tinyint>")
        first = int((w @ R.mismatches(sig)).argmin())
        assert R.distributed_pam(kinds, first, k) == [sig[m].tolist() for m in want]
    with pytest.raises(ValueError):
        R.distributed_pam(kinds, first, 1000)


def test_skater_and_first_medoid_make_no_distance_matrix(spark, monkeypatch):
    from terrane.plans import queries

    def refuse(*_):
        raise AssertionError("a matrix of all distances on the driver")

    want = R.skater_con(lattice(spark), 4, 6, 9, seed=2).orderBy("node_id").collect()
    monkeypatch.setattr(R, "mismatches", refuse)
    assert R.skater_con(lattice(spark), 4, 6, 9, seed=2).orderBy("node_id").collect() == want
    assert queries.pam_build_first_medoid(spark, "/root/testdata/sf0.001").count() == 1
