"""Registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import attributes as A
from terrane.operators import compare, contiguity, cores, mixture, network, present, regionalise
from terrane.plans.units import EDGES_SQL, UNITS_SQL, VARIABLES, attributes, cells, components_sql, read, units
from terrane.sources.workspace import materialise

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rook(spark, sf_dir, holes=False):
    return contiguity.snap_edges(units(spark, sf_dir, holes), "rook")


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


@query("SELECT c_custkey AS node_id, c_acctbal AS v1, round(v2, 3) AS v2, v3 FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS v2, count(*) AS v3 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def attr_semi_left_join(spark, sf_dir):
    return A.attach(cells(spark, sf_dir).select("node_id", "v1"), attributes(spark, sf_dir), "node_id", {"v2": 3})


@query(f"WITH {UNITS_SQL} SELECT 'v1' AS \"column\", count(*) - count(v1) AS n_missing FROM u UNION ALL SELECT 'v2', count(*) - count(v2) FROM u UNION ALL SELECT 'v3', count(*) - count(v3) FROM u")
def na_profile(spark, sf_dir):
    return A.na_profile(units(spark, sf_dir), VARIABLES)


@query(f"""WITH {UNITS_SQL}, m AS (SELECT a.node_id, b.node_id AS donor_id, b.v2, row_number() OVER (PARTITION BY a.node_id ORDER BY (a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2, b.node_id) AS k
  FROM u a CROSS JOIN u b WHERE a.v2 IS NULL AND b.v2 IS NOT NULL)
SELECT node_id, donor_id, round(v2, 6) AS value FROM m WHERE k = 1""")
def impute_nearest_donor(spark, sf_dir):
    return A.nearest_donor(units(spark, sf_dir), "v2", 1.0).select("node_id", "donor_id", *r6("value"))


@query(f"WITH {UNITS_SQL}, s AS (SELECT avg(v1) m1, stddev_samp(v1) s1, avg(v2) m2, stddev_samp(v2) s2, avg(v3) m3, stddev_samp(v3) s3 FROM u) SELECT node_id, round((v1 - m1) / s1, 6) AS v1, round((v2 - m2) / s2, 6) AS v2, round((v3 - m3) / s3, 6) AS v3 FROM u CROSS JOIN s")
def zscore_env(spark, sf_dir):
    return A.zscore(units(spark, sf_dir).select("node_id", *VARIABLES), VARIABLES).select("node_id", *r6(*VARIABLES))


@query(f"WITH {UNITS_SQL} {EDGES_SQL['queen'].format(t='u')}")
def contiguity_queen(spark, sf_dir):
    return contiguity.snap_edges(units(spark, sf_dir), "queen")


@query(f"WITH {UNITS_SQL} {EDGES_SQL['rook'].format(t='u')}")
def contiguity_rook(spark, sf_dir):
    return rook(spark, sf_dir)


@query(f"WITH {UNITS_SQL}, e AS ({EDGES_SQL['rook'].format(t='h')}), b AS (SELECT src AS node_id, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT node_id, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM h LEFT JOIN b USING (node_id) GROUP BY 1")
def neighbour_lists(spark, sf_dir):
    h = units(spark, sf_dir, True)
    lists = network.neighbour_lists(h, contiguity.snap_edges(h, "rook"))
    return lists.select("node_id", F.when(F.size("neighbours") > 0, F.array_join("neighbours", ",")).alias("neighbours"))


@query(f"WITH {UNITS_SQL} {EDGES_SQL['rook'].format(t='h')}")
def contiguity_min_shared_length(spark, sf_dir):
    return contiguity.snap_edges(units(spark, sf_dir, True), "queen", min_shared_length=1.0)


@query(f"WITH {UNITS_SQL} {EDGES_SQL['queen'].format(t='h')}")
def contiguity_touch(spark, sf_dir):
    return contiguity.touch_edges(units(spark, sf_dir, True))


@query(f"WITH RECURSIVE {UNITS_SQL}, e AS ({EDGES_SQL['rook'].format(t='h')}), {components_sql('h', 'e')} SELECT (SELECT count(*) FROM h) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT component) FROM comp) AS n_components")
def network_summary(spark, sf_dir):
    h = units(spark, sf_dir, True)
    return network.network_summary(h, contiguity.snap_edges(h, "rook"))


@query(f"WITH RECURSIVE {UNITS_SQL}, e AS ({EDGES_SQL['rook'].format(t='h')}), {components_sql('h', 'e')} SELECT node_id, component, dense_rank() OVER (ORDER BY component) AS component_no FROM comp")
def components_holes(spark, sf_dir):
    h = units(spark, sf_dir, True)
    c = materialise(network.components(h, contiguity.snap_edges(h, "rook")), "components")
    numbers = present.numbered(c.select("component").distinct(), ["component"], "component_no").withColumn("component_no", F.col("component_no").cast("int"))
    return c.join(numbers.hint("merge"), "component").select("node_id", "component", "component_no")


def component_distances(points: DataFrame) -> DataFrame:
    """`(a, b, d, src, dst)`: closest points of every two components; meant for graphs of few nodes outside the largest.

    The largest component's pairs come from a search by growing rings, the
    others', a row for every two by their nature, in pairs of blocks.
    """
    sizes = points.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    top = sizes.orderBy(F.desc("n"), "component").first()
    if top is None:
        return points.select(F.col("component").alias("a"), F.col("component").alias("b"), F.col("x").alias("d"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    largest, rest = points.where(F.col("component") == top["component"]), materialise(points.where(F.col("component") != top["component"]), "rest")
    side = max(top["x1"] - top["x0"], top["y1"] - top["y0"], 1e-9) / top["n"] ** 0.5
    near = network.nearest_other(largest, rest, side).withColumn("top", F.lit(top["component"]))
    far = near.select(F.least("component", "top").alias("a"), F.greatest("component", "top").alias("b"), F.sqrt("d2").alias("d"), F.col("lo").alias("src"), F.col("hi").alias("dst"))
    pairs = regionalise.block_pairs(rest.select("node_id", "x", "y", "component"), "component", rest.count(), regionalise.BLOCK)
    return far.unionByName(pairs.groupBy("i", "j").applyInArrow(network.closest_between, "a bigint, b bigint, d double, src bigint, dst bigint"))


@query(f"""WITH RECURSIVE {UNITS_SQL}, e AS ({EDGES_SQL['queen'].format(t='h')}), {components_sql('h', 'e')}, q AS (SELECT comp.*, gx, gy FROM comp JOIN h USING (node_id)),
r AS (SELECT p.component AS a, q.component AS b, (p.gx - q.gx) ** 2 + (p.gy - q.gy) ** 2 AS d2, least(p.node_id, q.node_id) AS src, greatest(p.node_id, q.node_id) AS dst FROM q p JOIN q ON p.component < q.component)
SELECT a, b, round(sqrt(d2), 6) AS d, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, src, dst) AS k FROM r) WHERE k = 1""")
def component_pair_distance(spark, sf_dir):
    h = units(spark, sf_dir, True)
    c = network.components(h, contiguity.snap_edges(h, "queen"))
    return component_distances(materialise(h.select("node_id", "x", "y").join(c.hint("merge"), "node_id"), "points")).select("a", "b", *r6("d"), "src", "dst")


@query()
def bridge_edges(spark, sf_dir):
    h = units(spark, sf_dir, True)
    return network.bridge_edges(h.select("node_id", "x", "y"), contiguity.snap_edges(h, "rook"))


@query(f"""WITH RECURSIVE {UNITS_SQL}, e AS ({EDGES_SQL['rook'].format(t='h')}), {components_sql('h', 'e')}
SELECT count(*) AS n_nodes, CAST(1 AS BIGINT) AS n_components, (SELECT count(*) FROM e) + count(DISTINCT component) - 1 AS n_edges FROM comp""")
def connected_network(spark, sf_dir):
    net = network.dev_polygon_to_network(units(spark, sf_dir, True))
    edges = materialise(net.edges, "edges")
    return network.network_summary(net.nodes, edges).select("n_nodes", "n_components", "n_edges")


def _weights_sql(tail: str) -> str:
    return f"""WITH {UNITS_SQL}, e AS ({EDGES_SQL['rook'].format(t='u')}), s AS (SELECT avg(v1) m1, stddev_samp(v1) s1, avg(v2) m2, stddev_samp(v2) s2, avg(v3) m3, stddev_samp(v3) s3 FROM u),
z AS (SELECT node_id, segment, (v1 - m1) / s1 AS z1, (v2 - m2) / s2 AS z2, (v3 - m3) / s3 AS z3 FROM u CROSS JOIN s),
d AS (SELECT src, dst, a.segment, (a.z1 - b.z1) ** 2 AS d1, (a.z2 - b.z2) ** 2 AS d2, (a.z3 - b.z3) ** 2 AS d3 FROM e JOIN z a ON a.node_id = src JOIN z b ON b.node_id = dst),
x AS (SELECT src, dst, segment, sqrt((coalesce(d1, 0) + coalesce(d2, 0) + coalesce(d3, 0)) * 3 / nullif((d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT, 0)) AS weight FROM d)
{tail}"""


def _weighted(spark, sf_dir):
    u = units(spark, sf_dir)
    return A.add_edge_weight(u, contiguity.snap_edges(u, "rook"), variables=VARIABLES)


@query(_weights_sql("SELECT src, dst, round(weight, 6) AS weight FROM x"))
def edge_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select("src", "dst", *r6("weight"))


@query(_weights_sql("SELECT segment, src, dst, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY weight DESC NULLS LAST, src, dst) AS rank FROM x) WHERE rank <= 5"))
def heaviest_edge_cut(spark, sf_dir):
    seg = cells(spark, sf_dir).select(F.col("node_id").alias("src"), "segment")
    return A.heaviest_edges(_weighted(spark, sf_dir).join(seg, "src"), "segment", 5).select("segment", "src", "dst", *r6("weight"), "rank")


LABELS_SQL = "l AS (SELECT vec_id AS node_id, t.i AS tree_id, CAST(floor(10 * embedding[t.i]) AS INT) AS label FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t)"


def _labels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.posexplode("embedding").alias("tree_id", "x"))
    return e.select("node_id", (F.col("tree_id") + 1).alias("tree_id"), F.floor(F.lit(10) * F.col("x")).cast("int").alias("label"))


@query(f"WITH {LABELS_SQL} SELECT a.node_id AS a, b.node_id AS b, round(1 - count(*) / 64.0::DOUBLE, 6) AS distance FROM l a JOIN l b ON a.tree_id = b.tree_id AND a.label = b.label AND a.node_id < b.node_id GROUP BY 1, 2")
def hamming_labels(spark, sf_dir):
    return regionalise.label_distance(_labels(spark, sf_dir)).select("a", "b", *r6("distance"))


@query(f"""WITH {LABELS_SQL}, s AS (SELECT a.node_id, count(*) AS same FROM l a JOIN l b ON a.tree_id = b.tree_id AND a.label = b.label GROUP BY 1)
SELECT node_id, 64 * (SELECT count(*) FROM embeddings) - same AS total FROM s ORDER BY total, node_id LIMIT 1""")
def pam_build_first_medoid(spark, sf_dir):
    """The one medoid that `pam` finds, and its total distance."""
    return regionalise.first_medoid(materialise(_labels(spark, sf_dir), "labels"))


@query(f"""WITH {LABELS_SQL}, d AS (SELECT a.node_id, CAST(b.node_id + 1 AS INT) AS medoid, count(*) FILTER (a.label <> b.label) / 64.0::DOUBLE AS d FROM l a JOIN l b ON a.tree_id = b.tree_id AND b.node_id < 3 GROUP BY 1, 2),
z AS (SELECT *, min(CASE WHEN d = 0 THEN medoid END) OVER (PARTITION BY node_id) AS zero FROM d)
SELECT node_id, medoid, round(CASE WHEN zero IS NOT NULL THEN (medoid = zero)::INT::DOUBLE ELSE d ** -2 / sum(CASE WHEN d > 0 THEN d ** -2 END) OVER (PARTITION BY node_id) END, 6) AS u FROM z""")
def fuzzy_membership(spark, sf_dir):
    rows = _labels(spark, sf_dir)
    medoids = rows.where("node_id < 3").select((F.col("node_id") + 1).cast("int").alias("medoid"), "tree_id", F.col("label").alias("other"))  # 3 medoids
    d = rows.join(F.broadcast(medoids), "tree_id").groupBy("node_id", "medoid").agg((F.count_if(F.col("label") != F.col("other")) / 64).alias("distance"))
    return regionalise.fuzzy_membership(d).select("node_id", "medoid", *r6("u"))


SHARES_SQL = "s AS (SELECT CAST(user_id AS BIGINT) AS node_id, event_type AS cls, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS u FROM events GROUP BY 1, 2, user_id), k AS (SELECT DISTINCT event_type AS cls FROM events), f AS (SELECT n.node_id, k.cls, coalesce(s.u, 0) AS u FROM (SELECT DISTINCT node_id FROM s) n CROSS JOIN k LEFT JOIN s ON s.node_id = n.node_id AND s.cls = k.cls)"


def _shares(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Share of each event type per user, wide; the types in order."""
    e = read(spark, sf_dir, "events")
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    cols = [(F.count_if(F.col("event_type") == t) / F.count(F.lit(1))).alias(t) for t in types]
    return e.groupBy(F.col("user_id").cast("long").alias("node_id")).agg(*cols), types


@query(f"WITH {SHARES_SQL} SELECT node_id, round(max(u), 6) AS \"Max_Prob\", min(cls) FILTER (u = m) AS \"Dominant_Class\" FROM (SELECT *, max(u) OVER (PARTITION BY node_id) AS m FROM f) GROUP BY 1")
def dominant_class(spark, sf_dir):
    wide, types = _shares(spark, sf_dir)
    return present.dominant(wide, types).select("node_id", *r6("Max_Prob"), "Dominant_Class")


@query(f"WITH {SHARES_SQL} SELECT node_id, cls AS \"Class\", round(u, 6) AS \"Probability\" FROM f")
def small_multiples(spark, sf_dir):
    wide, types = _shares(spark, sf_dir)
    return present.small_multiples(wide, types).select("node_id", "Class", *r6("Probability"))


THREE_SQL = "t AS (SELECT c_custkey AS node_id, c_nationkey % 7 / 6.0::DOUBLE AS a, c_custkey % 11 / 10.0::DOUBLE AS b, (c_custkey + c_nationkey) % 5 / 4.0::DOUBLE AS c FROM customer)"


def _three(spark, sf_dir):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("node_id"), (n % 7 / 6.0).alias("a"), (k % 11 / 10.0).alias("b"), ((k + n) % 5 / 4.0).alias("c"))


@query(f"WITH {THREE_SQL} SELECT node_id, printf('#%02X%02X%02X', CAST(floor(a * 255 + 0.5) AS INT), CAST(floor(b * 255 + 0.5) AS INT), CAST(floor(c * 255 + 0.5) AS INT)) AS color FROM t")
def rgb_color(spark, sf_dir):
    return present.rgb(_three(spark, sf_dir), ["a", "b", "c"]).select("node_id", "color")


@query(f"WITH {THREE_SQL} SELECT node_id, round(a / nullif(a + b + c, 0), 6) AS \"left\", round(b / nullif(a + b + c, 0), 6) AS top, round(c / nullif(a + b + c, 0), 6) AS \"right\" FROM t")
def ternary_coordinates(spark, sf_dir):
    return present.barycentric(_three(spark, sf_dir), ["a", "b", "c"]).select("node_id", *r6("left", "top", "right"))


@query(f"""WITH {THREE_SQL}, s AS (SELECT node_id, a / nullif(a + b + c, 0) AS l, b / nullif(a + b + c, 0) AS t, c / nullif(a + b + c, 0) AS r FROM t),
p AS (SELECT node_id, l - (t + r) / 2 AS x, (t - r) * 0.8660254037844386::DOUBLE AS y FROM s), f AS (SELECT *, sqrt(x * x + y * y) AS far FROM p),
h AS (SELECT node_id, x, [floor(greatest(0.0, least(1.0, 0.8::DOUBLE - 0.4::DOUBLE * (1 - far) / 2 + 0.2::DOUBLE * far * cos(atan2(y, x) - turn))) * 255 + 0.5)::INT FOR turn IN [0.0::DOUBLE, 2.0943951023931953::DOUBLE, 4.1887902047863905::DOUBLE]] AS v FROM f)
SELECT node_id, CASE WHEN x IS NOT NULL THEN printf('#%02X%02X%02X', v[1], v[2], v[3]) END AS tric_color FROM h""")
def ternary_colors(spark, sf_dir):
    return present.ternary_color(_three(spark, sf_dir), ["a", "b", "c"]).select("node_id", "tric_color")


@query(f"""WITH RECURSIVE {UNITS_SQL}, m AS (SELECT node_id, gx, gy, unnest(['X1', 'X2', 'X3']) AS cls, unnest([(node_id % 10) / 10.0::DOUBLE, CASE WHEN segment = 'BUILDING' THEN 0.8 WHEN segment = 'MACHINERY' THEN NULL ELSE 0.2 END, nation / 24.0::DOUBLE]) AS u FROM u),
n AS (SELECT cls, node_id, gx, gy FROM m WHERE u >= 0.5),
e AS (SELECT a.cls, a.node_id AS a, b.node_id AS b FROM n a JOIN n b ON a.cls = b.cls AND a.node_id <> b.node_id AND greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1),
reach AS (SELECT cls, node_id, node_id AS m FROM n UNION SELECT e.cls, e.b, r.m FROM reach r JOIN e ON e.cls = r.cls AND e.a = r.node_id WHERE r.m < e.b),
comp AS (SELECT cls, node_id, min(m) AS component FROM reach GROUP BY 1, 2)
SELECT cls, node_id, dense_rank() OVER (PARTITION BY cls ORDER BY component) AS core_region_id FROM comp""")
def core_regions(spark, sf_dir):
    u = units(spark, sf_dir)
    m = u.withColumns({"X1": F.col("node_id") % 10 / 10.0, "X2": F.when(F.col("segment") == "BUILDING", 0.8).when(F.col("segment") != "MACHINERY", 0.2), "X3": F.col("nation") / 24.0})
    return cores.core_regions(m, ["X1", "X2", "X3"], 0.5)


@query("""WITH l AS (SELECT l_returnflag AS region, l_quantity, l_linestatus, (l_returnflag = 'N')::INT AS still_open, CASE WHEN l_returnflag = 'R' THEN l_tax END AS tax_back FROM lineitem),
c AS (SELECT region, unnest(['l_quantity', 'l_linestatus', 'still_open', 'tax_back']) AS "column",
  unnest([count(DISTINCT l_quantity) + max((l_quantity IS NULL)::INT), count(DISTINCT l_linestatus) + max((l_linestatus IS NULL)::INT), count(DISTINCT still_open) + max((still_open IS NULL)::INT), count(DISTINCT tax_back) + max((tax_back IS NULL)::INT)]) AS n FROM l GROUP BY region)
SELECT region, "column" FROM c WHERE n = 1""")
def constant_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumns({"still_open": (F.col("l_returnflag") == "N").cast("int"), "tax_back": F.when(F.col("l_returnflag") == "R", F.col("l_tax"))})
    return A.constant_columns_by(rows.withColumnRenamed("l_returnflag", "region"), "region", ["l_quantity", "l_linestatus", "still_open", "tax_back"])


MOMENTS_SQL = "x AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), g AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa, covar_samp(a, b) AS sab, var_samp(b) AS sbb FROM x GROUP BY 1)"


def _points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))


def _moments(spark, sf_dir):
    x = _points(spark, sf_dir)
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("saa"), F.covar_samp("a", "b").alias("sab"), F.var_samp("b").alias("sbb"))


@query(f"WITH {MOMENTS_SQL} SELECT label, n, round(ma, 6) AS ma, round(mb, 6) AS mb, round(saa, 6) AS saa, round(sab, 6) AS sab, round(sbb, 6) AS sbb FROM g")
def gmm_moments(spark, sf_dir):
    return _moments(spark, sf_dir).select("label", "n", *r6("ma", "mb", "saa", "sab", "sbb"))


def _models(spark, sf_dir, region="'all'"):
    m = _moments(spark, sf_dir)
    total = m.agg(F.sum("n").alias("t"))
    return m.join(F.broadcast(total)).select(
        F.expr(region).alias("region"), (F.col("label") + 1).cast("int").alias("component"), (F.col("n") / F.col("t")).alias("pro"), F.array(F.lit("a"), F.lit("b")).alias("vars"),
        F.array("ma", "mb").alias("mean"), F.array(F.array("saa", "sab"), F.array("sab", "sbb")).alias("sigma"), F.lit("VVV").alias("covariance_model"), F.lit(0.0).alias("bic"),
    )


@query(f"""WITH {MOMENTS_SQL}, l AS (SELECT vec_id, g.label + 1 AS component, ln(n) - 0.5 * ln(saa * sbb - sab * sab) - 0.5 * (sbb * (a - ma) ** 2 - 2 * sab * (a - ma) * (b - mb) + saa * (b - mb) ** 2) / (saa * sbb - sab * sab) AS l FROM x CROSS JOIN g),
m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM l)
SELECT vec_id AS node_id, CAST(component AS INT) AS component, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM m""")
def gmm_posterior(spark, sf_dir):
    p = mixture.type_probabilities(_points(spark, sf_dir), _models(spark, sf_dir), "vec_id", round_digits=6)
    return p.select("node_id", "component", "p")


@query(f"""WITH {MOMENTS_SQL}, p AS (SELECT p.label AS a, q.label AS b, p.ma - q.ma AS da, p.mb - q.mb AS db, (p.saa + q.saa) / 2 AS s1, (p.sab + q.sab) / 2 AS s2, (p.sbb + q.sbb) / 2 AS s3, (p.saa * p.sbb - p.sab ** 2) * (q.saa * q.sbb - q.sab ** 2) AS dd FROM g p JOIN g q ON p.label < q.label)
SELECT a, b, round((s3 * da ** 2 - 2 * s2 * da * db + s1 * db ** 2) / (s1 * s3 - s2 ** 2) / 8 + 0.5 * ln((s1 * s3 - s2 ** 2) / sqrt(greatest(dd, 1e-10))), 6) AS distance FROM p""")
def bhattacharyya_pairs(spark, sf_dir):
    types = _models(spark, sf_dir).select((F.col("component") - 1).alias("id"), "vars", "mean", "sigma")
    return compare.pair_distances(types).select("a", "b", *r6("distance"))


@query(f"""WITH {MOMENTS_SQL}, p AS (SELECT 'M1_K' || (p.label + 1) AS a, 'M1_K' || (q.label + 1) AS b, p.ma - q.ma AS da, p.mb - q.mb AS db, (p.saa + q.saa) / 2 AS s1, (p.sab + q.sab) / 2 AS s2, (p.sbb + q.sbb) / 2 AS s3, (p.saa * p.sbb - p.sab ** 2) * (q.saa * q.sbb - q.sab ** 2) AS dd, p.label = q.label AS own FROM g p CROSS JOIN g q)
SELECT a, b, CASE WHEN own THEN 0 ELSE round((s3 * da ** 2 - 2 * s2 * da * db + s1 * db ** 2) / (s1 * s3 - s2 ** 2) / 8 + 0.5 * ln((s1 * s3 - s2 ** 2) / sqrt(greatest(dd, 1e-10))), 6) END AS distance FROM p""")
def compare_river_types(spark, sf_dir):
    return compare.compare_river_types(_models(spark, sf_dir)).select("a", "b", *r6("distance"))


@query(f"""WITH {MOMENTS_SQL}, s AS (SELECT avg(ma) AS a0, stddev_samp(ma) AS a1, avg(mb) AS b0, stddev_samp(mb) AS b1, corr(ma, mb) AS r FROM g), z AS (SELECT label, r, (ma - a0) / a1 AS za, (mb - b0) / b1 AS zb FROM g CROSS JOIN s)
SELECT round(CASE WHEN r >= 0 THEN za + zb ELSE za - zb END / sqrt(2), 6) AS "PC1", round(CASE WHEN r >= 0 THEN za - zb ELSE za + zb END / sqrt(2), 6) AS "PC2", 'all_Type' || (label + 1) AS "TypeID", 'all' AS "Region" FROM z""")
def centroid_pca(spark, sf_dir):
    return compare.river_centroids(_models(spark, sf_dir)).select(*r6("PC1", "PC2"), "TypeID", "Region")


@query(f"""WITH {MOMENTS_SQL} SELECT vec_id AS node_id, region, component, round(p * u, 6) AS p FROM (SELECT vec_id, CAST(label % 2 + 1 AS INT) AS component, abs(a) AS p FROM x) CROSS JOIN LATERAL (VALUES ('X1', vec_id % 4 / 4.0::DOUBLE), ('X2', 1 - vec_id % 4 / 4.0::DOUBLE)) m(region, u)""")
def type_weighting(spark, sf_dir):
    x = _points(spark, sf_dir)
    regions = F.explode(F.array(F.lit("X1"), F.lit("X2")))
    p = x.select(F.col("vec_id").alias("node_id"), regions.alias("region"), (F.col("label") % 2 + 1).cast("int").alias("component"), F.abs("a").alias("p"))
    u = F.col("vec_id") % 4 / 4.0
    m = x.select(F.col("vec_id").alias("node_id"), u.alias("X1"), (1 - u).alias("X2")).unpivot(["node_id"], ["X1", "X2"], "cls", "u")
    return mixture.weighted_types(p, m).select("node_id", "region", "component", *r6("p"))


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS row_no, c_custkey AS node_id FROM customer")
def row_numbers(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey").alias("node_id"))
    return present.numbered(c, ["c_mktsegment", "node_id"], "row_no").select("row_no", "node_id")


def _regions(spark, sf_dir, trees=100, k=3):
    """Units, connected, with fuzzy memberships: the whole chain on units with holes."""
    u = units(spark, sf_dir, True)
    filled = materialise(A.impute_nearest(u, ["v2", "v3"], 1.0).drop("gx", "gy"), "units")
    net = network.polygon_to_network(filled)
    weighted = A.add_edge_weight(filled, net.edges, variables=VARIABLES)
    return filled, regionalise.skater_con(weighted, k, trees, seed=7)


@query()
def skater_fuzzy_regions(spark, sf_dir):
    return _regions(spark, sf_dir)[1]


@query()
def river_types_full(spark, sf_dir):
    filled, memberships = _regions(spark, sf_dir)
    m = materialise(memberships, "memberships")
    both = filled.join(m, "node_id")
    core = cores.core_regions(both, ["X1", "X2", "X3"], 0.4)
    data = both.select("node_id", *VARIABLES, "X1", "X2", "X3")
    return mixture.river_types(data, core, ["X1", "X2", "X3"])[0]


def flagship(spark, sf_dir):
    """The heaviest rook edges of each segment."""
    return heaviest_edge_cut(spark, sf_dir)
