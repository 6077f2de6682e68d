"""Fuzzy regions from an ensemble of random spanning trees.

Uniform random spanning trees (Wilson's loop-erased walks), each cut at its
heaviest edges, give every node a label per tree; nodes are compared by the
share of trees that label them differently, grouped around medoids, and get
memberships from their distances to the medoids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.sources.workspace import materialise


class Graph:
    """An undirected graph in flat arrays, edges sorted by (src, dst)."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.lexsort((dst, src))
        self.nodes = np.unique(np.concatenate([src, dst]))
        self.a, self.b = np.searchsorted(self.nodes, src[order]), np.searchsorted(self.nodes, dst[order])
        self.weight = weight[order]
        ends, edge = np.concatenate([self.a, self.b]), np.tile(np.arange(len(self.a)), 2)
        other = np.concatenate([self.b, self.a])
        by = np.argsort(ends, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(self.nodes)))])
        self.to, self.edge = other[by], edge[by]

    def labels(self, edges: np.ndarray) -> np.ndarray:
        """Components over some edges, numbered from 1 in the order of their first node."""
        up = list(range(len(self.nodes)))
        for x, y in zip(self.a[edges].tolist(), self.b[edges].tolist()):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            up[max(x, y)] = min(x, y)
        for i, u in enumerate(up):  # parents come before children
            up[i] = up[u]
        return np.unique(np.array(up), return_inverse=True)[1] + 1

    def spanning_tree(self, rng: np.random.Generator) -> np.ndarray:
        """Edge numbers of a uniform spanning tree."""
        n = len(self.nodes)
        if isinstance(self.start, np.ndarray):  # lists are faster to walk; a broadcast graph has arrays
            self.start, self.to, self.edge = self.start.tolist(), self.to.tolist(), self.edge.tolist()
        done, exit_ = [False] * n, [-1] * n
        done[int(rng.integers(n))] = True
        draws, at, out = rng.random(8192).tolist(), 0, []
        for first in range(n):
            x = first
            while not done[x]:
                if at == len(draws):
                    draws, at = rng.random(8192).tolist(), 0
                low = self.start[x]
                exit_[x] = low + int(draws[at] * (self.start[x + 1] - low))
                at += 1
                x = self.to[exit_[x]]
            x = first
            while not done[x]:
                done[x] = True
                out.append(self.edge[exit_[x]])
                x = self.to[exit_[x]]
        return np.sort(np.array(out, np.int64))

    def cut(self, tree: np.ndarray, regions: int) -> np.ndarray:
        """The tree's edges without its `regions - 1` heaviest; ties go by edge order, missing weights are never cut first."""
        w = np.where(np.isnan(self.weight[tree]), -np.inf, self.weight[tree])
        return np.delete(tree, np.lexsort((tree, -w))[: regions - 1])


def tree_labels(edges: DataFrame, regions: int, trees: int, seed: int = 0) -> DataFrame:
    """`(tree_id, node_id, label)`: labels 1..regions of every node in each of `trees` cut trees.

    One task per tree; each reads the whole graph, which must be connected and
    fit one task's memory.  Same seed, same labels, whatever the partitioning.
    """
    rows = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight")).toArrow()
    graph = Graph(rows.column("src").to_numpy(), rows.column("dst").to_numpy(), rows.column("weight").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    n = len(graph.nodes)
    if not n or graph.labels(np.arange(len(graph.a))).max() > 1:
        raise ValueError("the graph must be connected and have an edge; bridge its components first")
    if not 1 <= regions <= n:
        raise ValueError(f"regions must lie between 1 and the number of nodes, {n}")
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(graph)

    def run(batches):
        g = shared.value
        for batch in batches:
            for t in batch.column("id").to_pylist():
                tree = g.spanning_tree(np.random.Generator(np.random.PCG64([seed, t])))
                label = g.labels(g.cut(tree, regions))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), t, np.int32)), pa.array(g.nodes.astype(np.int64)), pa.array(label.astype(np.int32))], ["tree_id", "node_id", "label"])

    return spark.range(trees, numPartitions=min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "tree_id int, node_id bigint, label int")


def wide_labels(labels: DataFrame, trees: int) -> DataFrame:
    """`(node_id, regionalization_1..regionalization_t)`; trees are numbered from 0 in `labels`."""
    cols = [F.max(F.when(F.col("tree_id") == t, F.col("label"))).alias(f"regionalization_{t + 1}") for t in range(trees)]
    return labels.groupBy("node_id").agg(*cols)


#: Rows of a block; all pairs are made block by block, so a task holds two blocks and the pairs between them.
BLOCK = 1024


def block_pairs(rows: DataFrame, key: str, n: int, block: int) -> DataFrame:
    """`rows` in blocks by hash of `key`, each row once for every pair of blocks (`i` <= `j`) with its own `block`; dealt out by pair."""
    blocks = max(1, -(-n // block))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    out = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("other", other)
    out = out.select(*rows.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return out.repartition(min(blocks * (blocks + 1) // 2, max(blocks, 8 * rows.sparkSession.sparkContext.defaultParallelism)), "i", "j")


def _one_hot(start: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """How often each row has each code; rows are slices of `codes`."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    return np.bincount(row * width + codes, minlength=(len(start) - 1) * width).reshape(-1, width).astype(np.float32)


def _shared_labels(table: pa.Table, trees: int) -> pa.Table:
    """All pairs between two blocks, or in one, that share a label, with their distance."""
    table = table.combine_chunks()
    own = np.array([table.column("i")[0].as_py(), table.column("j")[0].as_py()])
    at = table.column("block").to_numpy()
    sides = []
    for b in own:
        t = table.filter(pa.array(at == b)).combine_chunks()
        lists = t.column("codes").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64()))
        sides.append((t.column("node_id").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()))
    (a, na, ca), (b, nb, cb) = sides
    both = np.intersect1d(ca, cb)
    shared = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(both), 2048):  # so many columns at a time
        part = both[low : low + 2048]
        hot = []
        for n, c in ((na, ca), (nb, cb)):
            k = np.minimum(np.searchsorted(part, c), len(part) - 1)
            there = part[k] == c
            row = np.repeat(np.arange(len(n)), n)[there]
            hot.append(_one_hot(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]), k[there], len(part)))
        shared += hot[0] @ hot[1].T
    met = shared > 0
    if own[0] == own[1]:
        met &= a[:, None] < b[None, :]
    x, y = np.nonzero(met)
    p, q = a[x], b[y]
    return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q), "distance": 1 - shared[x, y].astype(np.float64) / trees})


def label_distance(labels: DataFrame) -> DataFrame:
    """`(a, b, distance)`, a < b: share of trees that label two nodes differently; pairs that never share a label are left out (distance 1).

    All pairs by their nature: made in pairs of blocks of nodes, counts of
    shared labels as a product of one-hot matrices, so that no row is made for
    each label that a pair shares.  Trees and labels are 32-bit integers.
    """
    n = labels.agg(F.countDistinct("tree_id").alias("trees"), F.countDistinct("node_id").alias("nodes")).first()
    code = F.shiftleft(F.col("tree_id").cast("long"), 32).bitwiseOR(F.col("label").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    nodes = labels.where("node_id is not null and tree_id is not null and label is not null").groupBy(F.col("node_id").cast("long").alias("node_id")).agg(F.collect_list(code).alias("codes"))
    trees = n["trees"]
    pairs = block_pairs(nodes, "node_id", n["nodes"], BLOCK)
    return pairs.groupBy("i", "j").applyInArrow(lambda t: _shared_labels(t, trees), "a bigint, b bigint, distance double")


def total_distances(labels: DataFrame) -> DataFrame:
    """`(node_id, total)`: in how many (tree, node) cases another node has another label; matches are counted per (tree, label), so no pairs are made."""
    sizes = labels.groupBy("tree_id", "label").count()
    n = labels.select(F.countDistinct("node_id").alias("n"))
    total = labels.join(sizes, ["tree_id", "label"]).groupBy("node_id").agg(F.sum("count").alias("same"), F.count(F.lit(1)).alias("trees"))
    return total.join(F.broadcast(n)).select("node_id", (F.col("trees") * F.col("n") - F.col("same")).alias("total"))  # n is one row


def first_medoid(labels: DataFrame) -> DataFrame:
    """`(node_id, total)` of the one medoid: the node of least total distance, least id on ties.  Linear, see `total_distances`."""
    return total_distances(labels).orderBy("total", "node_id").limit(1)


def mismatches(sig: np.ndarray) -> np.ndarray:
    """Numbers of columns in which each two rows differ."""
    out = np.zeros((len(sig), len(sig)), np.uint16)
    for col in sig.T:
        out += col[:, None] != col[None, :]
    return out


def pam(dist: np.ndarray, weight: np.ndarray, k: int, rounds: int = 200) -> list[int]:
    """Medoids of a symmetric distance matrix by BUILD and SWAP (Kaufman and Rousseeuw), ties to the lowest index; swaps are judged as in FastPAM."""
    n = len(dist)
    if not 1 <= k <= n:
        raise ValueError(f"{k} medoids of {n} different rows")
    d = dist.astype(np.float32)
    near = None
    medoids: list[int] = []
    for _ in range(k):
        gain = -(weight @ d) if near is None else np.array([weight @ np.maximum(near - d[c], 0) for c in range(n)])
        gain[medoids] = -np.inf
        medoids.append(int(gain.argmax()))
        near = d[:, medoids].min(axis=1)
    for _ in range(rounds):
        own = d[:, medoids]
        order = np.argsort(own, axis=1, kind="stable")
        first = order[:, 0]
        d1 = own[np.arange(n), first]
        d2 = own[np.arange(n), order[:, 1]] if k > 1 else np.full(n, np.inf, np.float32)
        removal = np.bincount(first, weight * (np.where(np.isinf(d2), 0, d2) - d1), k) if k > 1 else np.zeros(1)
        best = (-1e-9, -1, -1)
        for c in sorted(set(range(n)) - set(medoids)):
            x = d[c]
            if k == 1:
                change = np.array([float(weight @ (x - d1))])
            else:
                shared = weight @ np.minimum(x - d1, 0)
                per = np.bincount(first, weight * (np.minimum(x, d2) - np.minimum(x, d1) - (d2 - d1)), k)
                change = shared + removal + per
            m = int(change.argmin())
            if change[m] < best[0] - 1e-9:
                best = (float(change[m]), m, c)
        if best[1] < 0:
            break
        medoids[best[1]] = best[2]
    return medoids


def _costs(table: pa.Table, chosen: np.ndarray, keys: list[str]) -> pa.Table:
    """For every row of two blocks as a candidate, sums over the rows of the other block, by their first of the `chosen` medoids: weight times the least distance to chosen and candidate (a0..), and without that first medoid (b0..)."""
    table = table.combine_chunks()
    own = [table.column("i")[0].as_py(), table.column("j")[0].as_py()]
    at, k = table.column("block").to_numpy(), len(chosen)
    kind = np.uint8 if chosen.shape[1] < 256 else np.uint16 if chosen.shape[1] < 65536 else np.uint32
    sides = []
    for b in own:
        t = table.filter(pa.array(at == b)).combine_chunks()
        sig = t.column("v").chunk(0).flatten().to_numpy().reshape(-1, chosen.shape[1]) if t.num_rows else np.zeros((0, chosen.shape[1]), np.int8)
        d = np.stack([(sig != m).sum(axis=1) for m in chosen], axis=1)
        first, near = d.argmin(axis=1), np.sort(d, axis=1)
        w = np.zeros((len(sig), k))
        w[np.arange(len(sig)), first] = t.column("n").to_numpy()
        second = near[:, 1] if k > 1 else np.full(len(sig), chosen.shape[1])
        exact = np.float32 if chosen.shape[1] * w.sum() < 2**24 else np.float64  # sums of whole numbers
        sides.append((t.column("rep").to_numpy(), np.ascontiguousarray(sig.T), near[:, 0].astype(kind), second.astype(kind), w.astype(exact)))
    (ra, ca, *pa_), (rb, cb, *pb) = sides

    def sums(d, d1, d2, w):
        return np.concatenate([np.minimum(d, d1).astype(w.dtype) @ w, np.minimum(d, d2).astype(w.dtype) @ w], axis=1, dtype=np.float64)

    left, right = np.zeros((len(ra), 2 * k)), np.zeros((len(rb), 2 * k))
    for low in range(0, len(ra), 64):
        rows = slice(low, low + 64)
        d = np.zeros((len(ra[rows]), len(rb)), kind)
        for x, y in zip(ca[:, rows], cb):
            d += x[:, None] != y[None, :]
        left[rows] = sums(d, *pb)
        if own[0] != own[1]:
            right += sums(d.T, *(x[rows] for x in pa_))
    rep, got = (ra, left) if own[0] == own[1] else (np.concatenate([ra, rb]), np.concatenate([left, right]))
    return pa.table({"rep": rep, **{c: got[:, x] for x, c in enumerate(keys)}})


def distributed_pam(kinds: DataFrame, first: int, k: int, rounds: int = 200) -> list[list[int]]:
    """Label vectors of the medoids that `pam` finds, ties to the least `rep`; no distance is kept.

    `kinds` has `rep`, `n` (nodes) and the vector `v`, and is read once a round;
    `first` is the `rep` of least total distance.  Each round computes all
    distances again in pairs of blocks, so its time grows with the square of
    the different vectors, a task's memory with two blocks, and the driver
    gets one row.
    """
    count = kinds.count()
    if not 1 <= k <= count:
        raise ValueError(f"{k} medoids of {count} different rows")
    vector = lambda rep: kinds.where(F.col("rep") == rep).first()["v"]
    reps, chosen = [first], [vector(first)]
    pairs = block_pairs(kinds, "rep", count, max(2 * BLOCK, -(-count // 64)))

    def best(swap: bool):
        m, now = len(chosen), np.array(chosen)
        keys = [f"{c}{x}" for c in "ab" for x in range(m)]
        got = pairs.groupBy("i", "j").applyInArrow(lambda t: _costs(t, now, keys), "rep bigint, " + ", ".join(f"{c} double" for c in keys))
        sums = got.groupBy("rep").agg(*[F.sum(c).alias(c) for c in keys]).where(~F.col("rep").isin(reps))
        total = lambda gone: sum((F.col(f"b{x}" if x == gone else f"a{x}") for x in range(m)), F.lit(0.0))
        costs = F.array(*[F.struct(total(x).alias("cost"), F.col("rep"), F.lit(x).alias("m")) for x in (range(m) if swap else [-1])])
        return sums.select(F.array_min(costs).alias("x")).select("x.*").orderBy("cost", "rep", "m").first()

    cost = None
    while len(reps) < k:
        add = best(False)
        cost = add["cost"]
        reps.append(add["rep"])
        chosen.append(vector(add["rep"]))
    for _ in range(rounds if 1 < k < count else 0):  # the one best row needs no swap
        swap = best(True)
        if swap["cost"] >= cost:
            break
        cost, reps[swap["m"]] = swap["cost"], swap["rep"]
        chosen[swap["m"]] = vector(swap["rep"])
    return chosen


def fuzzy_membership(distances: DataFrame, node: str = "node_id", medoid: str = "medoid", distance: str = "distance", m: float = 2.0) -> DataFrame:
    """`(node, medoid, u)` from distances to the medoids (numbered from 1).

    u = d^(-2/(m-1)) / sum; a node at distance 0 belongs wholly to the first
    such medoid.
    """
    if m <= 1:
        raise ValueError("the fuzziness must be above 1")
    w = Window.partitionBy(node)
    zero = F.min(F.when(F.col(distance) == 0, F.col(medoid))).over(w)
    power = F.when(F.col(distance) > 0, F.pow(F.col(distance), F.lit(-2.0 / (m - 1))))
    out = distances.withColumns({"__zero": zero, "__p": power}).withColumn("__s", F.sum("__p").over(w))
    u = F.when(F.col("__zero").isNotNull(), (F.col(medoid) == F.col("__zero")).cast("double")).otherwise(F.col("__p") / F.col("__s"))
    return out.select(node, medoid, u.alias("u"))


def wide(memberships: DataFrame, k: int, node: str = "node_id", medoid: str = "medoid") -> DataFrame:
    """`(node, X1..Xk)`."""
    cols: list[Column] = [F.max(F.when(F.col(medoid) == i, F.col("u"))).alias(f"X{i}") for i in range(1, k + 1)]
    return memberships.groupBy(node).agg(*cols)


def skater_con(edges: DataFrame, final_regions: int, trees: int, skater_regions: int = 50, fuzziness: float = 2.0, seed: int = 0) -> DataFrame:
    """`(node_id, X1..Xk)`: fuzzy memberships of every node in `final_regions` regions.

    Medoids are sought among the different label vectors (weighted by their
    number of nodes) by `distributed_pam`, whose time grows with the square of
    the number of different vectors; distances to the medoids and memberships
    are DataFrame work.
    """
    if fuzziness <= 1:
        raise ValueError("the fuzziness must be above 1")
    labels = materialise(tree_labels(edges, skater_regions, trees, seed), "labels")
    vector = F.transform(F.array_sort(F.collect_list(F.struct("tree_id", "label"))), lambda x: x["label"])
    nodes = materialise(labels.groupBy("node_id").agg(vector.alias("v")), "vectors")
    short = "tinyint" if skater_regions < 128 else "int"
    kinds = materialise(nodes.groupBy("v").agg(F.min("node_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("v", F.col("v").cast(f"array<{short}>")), "kinds")
    medoids = distributed_pam(kinds, first_medoid(labels).first()["node_id"], final_regions)
    rows = [(i + 1, list(m)) for i, m in enumerate(medoids)]
    chosen = edges.sparkSession.createDataFrame(rows, "medoid int, mv array<int>")
    differ = F.aggregate(F.zip_with("v", "mv", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    far = nodes.join(F.broadcast(chosen)).select("node_id", "medoid", (differ / float(trees)).alias("distance"))  # final_regions rows
    return wide(fuzzy_membership(far, m=fuzziness), final_regions)
