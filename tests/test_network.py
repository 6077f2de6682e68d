import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.geometry import centroid, relation, wkb_rings
from terrane.operators import contiguity as C
from terrane.operators import network as N
from terrane.operators.attributes import add_edge_weight, constant_columns, dropped_columns, heaviest_edges, nearest_donor
from terrane.operators.cores import core_regions
from terrane.operators.graph import connected_components
from terrane.sources.spatial import decode_wkb


def box(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def polygons(spark, *rings):
    return spark.createDataFrame(list(enumerate(rings, 1)), "node_id long, rings array<array<struct<x:double,y:double>>>")


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


@pytest.mark.parametrize(
    "b, queen, rook, touch, line",
    [
        (box(1, 0, 2, 1), True, True, True, True),
        (box(1, 1, 2, 2), True, False, True, False),
        (box(1, 0.25, 2, 0.75), False, False, True, True),
        (box(1 + 5e-7, 0, 2, 1), True, True, False, False),
        (box(1 + 5e-6, 0, 2, 1), False, False, False, False),
        (box(0.5, 0.5, 2, 2), False, False, False, False),
        (box(0, 0, 1, 1), True, True, False, False),
        (box(5, 5, 6, 6), False, False, False, False),
    ],
    ids=["side", "corner", "t-junction", "within snap", "beyond snap", "overlap", "equal", "far"],
)
def test_predicates(spark, b, queen, rook, touch, line):
    p = polygons(spark, box(0, 0, 1, 1), b)
    want = lambda yes: [(1, 2)] if yes else []
    assert pairs(C.snap_edges(p, "queen")) == want(queen)
    assert pairs(C.snap_edges(p, "rook")) == want(rook)
    assert pairs(C.touch_edges(p)) == want(touch)
    assert pairs(C.touch_edges(p, queen=False)) == want(line)


def test_relation_shared_length():
    def seg(b):
        p = [(q["x"], q["y"]) for q in b[0]]
        return np.array([(*u, *v) for u, v in zip(p, p[1:] + p[:1])])

    assert relation(seg(box(0, 0, 2, 2)), seg(box(2, 0.5, 3, 1.5))) == (False, 1, 1.0)
    assert relation(seg(box(0, 0, 4, 4)), seg(box(1, 1, 2, 2)))[0]


def test_contiguity_rejects_other_words(spark):
    with pytest.raises(ValueError):
        C.snap_edges(polygons(spark, box(0, 0, 1, 1)), "bishop")


def test_wkb_and_centroid(spark):
    ring = [(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]
    body = lambda e: struct.pack(f"{e}III", 3, 1, 5) + b"".join(struct.pack(f"{e}dd", *p) for p in ring)
    little, big = b"\x01" + body("<"), b"\x00" + body(">")
    multi = b"\x01" + struct.pack("<II", 6, 2) + little + big
    assert wkb_rings(little) == wkb_rings(big) == [[{"x": float(x), "y": float(y)} for x, y in ring[:-1]]]
    assert len(wkb_rings(multi)) == 2 and wkb_rings(None) is None
    df = decode_wkb(spark.createDataFrame([(1, bytearray(little)), (2, None)], "node_id long, geometry binary"))
    rows = df.select("node_id", centroid(F.col("rings")).alias("c")).orderBy("node_id").collect()
    assert tuple(rows[0]["c"]) == (2.0, 1.0)


def points(spark, xs):
    return spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(xs, 1)], "node_id long, x double, y double")


@pytest.mark.parametrize(
    "xs, edges, want",
    [
        ([0, 1, 2, 10, 11, 12], [(1, 2), (2, 3), (4, 5), (5, 6)], [(3, 4, 8.0)]),
        ([0, 1, 2, 3], [(1, 2), (3, 4)], [(2, 3, 1.0)]),
        ([0, 5, 5, 9], [(1, 2), (3, 4)], [(2, 3, 0.0)]),
        ([0, 3, 100], [], [(1, 2, 3.0), (2, 3, 97.0)]),
        ([0, 1], [(1, 2)], []),
    ],
)
def test_bridges(spark, xs, edges, want):
    e = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(tuple(r) for r in N.bridge_edges(points(spark, xs), e).collect()) == want


def test_bridges_equal_kruskal(spark):
    rng = np.random.default_rng(3)
    xy = rng.integers(0, 12, (14, 2)).astype(float)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "node_id long, x double, y double")
    e = [(0, 1), (2, 3), (3, 4), (7, 8)]
    up = list(range(14))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in e:
        up[find(b)] = find(a)
    want = []
    for d, a, b in sorted((float(np.hypot(*(xy[a] - xy[b]))), a, b) for a, b in itertools.combinations(range(14), 2)):
        if find(a) != find(b):
            up[find(b)] = find(a)
            want.append((a, b))
    assert pairs(N.bridge_edges(p, spark.createDataFrame(e, "src long, dst long"))) == sorted(want)


def test_components_on_random_graphs(spark):
    rng = np.random.default_rng(1)
    e = [tuple(map(int, x)) for x in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    up: dict[int, int] = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in e:
        if a != b:
            r, s = sorted((find(a), find(b)))
            up[s] = r
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_no_neighbours_and_islands(spark):
    p = polygons(spark, box(0, 0, 1, 1), box(3, 0, 4, 1), box(9, 0, 10, 1))
    net = N.polygon_to_network(p)
    assert pairs(net.contiguity_edges) == [] and pairs(net.edges) == [(1, 2), (2, 3)]
    assert N.dev_polygon_to_network(p, connect_islands=False).edges.count() == 0


def test_edge_weights(spark):
    rows = [(1, 0.0, 5.0, 7.0), (2, 1.0, 5.0, None), (3, 3.0, 5.0, 9.0)]
    n = spark.createDataFrame(rows, "node_id long, a double, constant double, b double")
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 3)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["weight"] for r in add_edge_weight(n, e, variables=["a", "constant", "b"]).collect()}
    sd = np.std([0, 1, 3], ddof=1)
    assert len(got) == 3
    assert got[1, 2] == pytest.approx(np.sqrt(3) * 1 / sd) and got[1, 3] == pytest.approx(np.sqrt(1.5 * ((3 / sd) ** 2 + 2)))
    with pytest.raises(ValueError):
        add_edge_weight(n, e, variables=["missing"])


def test_heaviest_edges_ties(spark):
    e = spark.createDataFrame([("t", 1, 2, 1.0), ("t", 2, 3, 5.0), ("t", 3, 4, 3.0), ("t", 4, 5, 5.0), ("t", 5, 6, None), ("t", 6, 7, float("nan"))], "g string, src long, dst long, weight double")
    assert [(r["src"], r["rank"]) for r in heaviest_edges(e, "g", 2).orderBy("rank").collect()] == [(2, 1), (4, 2)]


def test_nearest_donor_skips_missing(spark):
    u = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 1.0, 0.0, None), (3, 3.0, 0.0, 7.0), (4, -40.0, 0.0, 9.0)], "node_id long, x double, y double, v double")
    assert {r["node_id"]: (r["donor_id"], r["value"]) for r in nearest_donor(u, "v", 0.5).collect()} == {1: (3, 7.0), 2: (3, 7.0)}
    assert nearest_donor(u.withColumn("v", F.lit(None).cast("double")), "v", 1.0).count() == 0


def test_constant_and_geology(spark):
    cols = "area_sediment area_calcareous area_siliceous z half".split()
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 2.0, 2.0, None)], ", ".join(f"{c} double" for c in cols))
    assert constant_columns(df, cols) == ["area_sediment", "area_calcareous"]
    assert dropped_columns(df, cols) == ["area_sediment", "area_calcareous", "area_siliceous"]


def test_core_regions(spark):
    p = polygons(spark, box(0, 0, 1, 1), box(1, 1, 2, 2), box(5, 0, 6, 1), box(6, 0, 7, 1))
    m = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.9, None), (3, 0.4, 0.1), (4, 1.0, 0.2)], "node_id long, a double, b double")
    u = p.join(m, "node_id")
    rows = lambda **k: sorted(tuple(r) for r in core_regions(u, ["a", "b"], **k).collect())
    assert rows() == [("a", 1, 1), ("a", 2, 1), ("a", 4, 2)]
    assert rows(queen=False) == [("a", 1, 1), ("a", 2, 2), ("a", 4, 3)]
    assert rows(cutoff=1.0) == [("a", 4, 1)]
    for bad in ({"cutoff": 2.0}, {"membership_cols": ["zzz"]}):
        with pytest.raises(ValueError):
            core_regions(u, **({"membership_cols": ["a"]} | bad))
    with pytest.raises(ValueError):
        core_regions(m)


def test_wkb_with_heights_and_reference_system():
    import struct

    from terrane.functions.geometry import wkb_rings

    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    want = [[{"x": x, "y": y} for x, y in ring[:-1]]]

    def polygon(kind, extra, srid=None, order="<"):
        head = struct.pack(order + "BI", order == "<", kind) + (struct.pack(order + "I", srid) if srid else b"")
        return head + struct.pack(order + "II", 1, len(ring)) + b"".join(struct.pack(order + f"{2 + extra}d", x, y, *[9.0] * extra) for x, y in ring)

    plain = [(3, 0, None), (1003, 1, None), (2003, 1, None), (3003, 2, None), (0x80000003, 1, None), (0x40000003, 1, None), (0xC0000003, 2, None), (0x20000003, 0, 4326), (0xA0000003, 1, 4326)]
    for order in "<>":
        assert all(wkb_rings(polygon(k, e, s, order)) == want for k, e, s in plain)
        many = struct.pack(order + "BII", order == "<", 1006, 2) + polygon(1003, 1, None, order) * 2
        assert wkb_rings(many) == want * 2


def test_core_polygons(spark):
    from terrane.operators.cores import core_polygons

    units = spark.createDataFrame([(1, "[a]", 0.5), (2, "[b]", 0.7)], "node_id long, rings string, v double")
    cores = spark.createDataFrame([("X1", 2, 1)], "cls string, node_id long, core_region_id int")
    got = core_polygons(units, cores, ["X1", "X2"])
    assert got["X1"].columns == ["core_region_id", "node_id", "v", "rings"] and [tuple(r) for r in got["X1"].collect()] == [(1, 2, 0.7, "[b]")]
    assert got["X2"].columns == got["X1"].columns and got["X2"].count() == 0


def test_relations_of_many_pairs_equal_one_by_one():
    from terrane.functions.geometry import relations

    rng = np.random.default_rng(8)
    seg = lambda p: np.array([(*u, *w) for u, w in zip(p, [*p[1:], p[0]])], float)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    a = np.array([seg(square(*rng.integers(0, 3, 2), rng.integers(1, 3))) for _ in range(300)])
    turn = np.sort(rng.random((150, 4)), axis=1) * 2 * np.pi
    b = np.array([seg(square(*rng.integers(0, 3, 2), rng.integers(1, 3))) for _ in range(150)] + [seg(list(zip(1 + np.cos(t), 1 + np.sin(t)))) for t in turn])
    b[:9] = a[:9]
    want = [relation(x, y) for x, y in zip(a, b)]
    meet, dim, length = relations(a, b)
    assert len({w[:2] for w in want}) > 4 and list(zip(meet, dim)) == [w[:2] for w in want] and np.allclose(length, [w[2] for w in want])


def test_touch_with_rings_of_different_lengths(spark):
    bent = [[{"x": float(x), "y": float(y)} for x, y in ((1, 0), (2, 0), (2, 1), (1.5, 2), (1, 1), (1, 0))]]
    apart = box(0, 1, 1, 2) + box(2, 0.5, 3, 1)
    p = polygons(spark, box(0, 0, 1, 1), bent, apart, box(1, 1, 1.2, 3), [])
    assert pairs(C.touch_edges(p)) == [(1, 2), (1, 3), (1, 4), (2, 3), (3, 4)]


def test_snap_edges_send_no_vertices_to_the_driver(spark, tmp_path):
    polygons(spark, box(0, 0, 1, 1), box(1, 0, 2, 1)).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    for edges in (C.snap_edges(p, "rook"), C.snap_edges(p, "queen", min_shared_length=1.0)):
        assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()
        assert pairs(edges) == [(1, 2)]


def test_iterations_send_no_table_to_the_driver(spark, monkeypatch):
    from terrane.operators import graph
    from terrane.sources import workspace

    plans = []

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return workspace.materialise(df, *args, **options)

    for module in (graph, N):
        monkeypatch.setattr(module, "materialise", seen)
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.integers(0, 9, (12, 2)))], "node_id long, x double, y double")
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (6, 7)], "src long, dst long")
    assert N.bridge_edges(p, e).count() == 7
    joins = [x for x in plans if "Join" in x]
    assert len(joins) > 5 and not any("Broadcast" in x for x in joins)
