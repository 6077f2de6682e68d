"""N-gram Jaccard join by a MinHash LSH forest (operator 2).

Links are pairs of documents whose sets of `N`-word shingles have a Jaccard
similarity of at least `threshold`.

* Documents with the same set are one class of copies; all that follows works
  on one numbered node for each different set.
* Forest: `TREES` prefix tries over signatures of `DEPTH` MinHash values.
  Signatures that share their first `SHALLOW` values are sorted; the common
  prefix of neighbours in that order gives the branches of each trie at every
  depth, with their sizes.
* Adaptive prefixes: a document starts with whole signatures in all trees.  At
  depths d_t it meets a partner of similarity s with probability
  1 - prod(1 - s^d_t).  While that is below `target` at the threshold, it gives
  up one value of its prefix in the tree where the shorter prefix adds the
  fewest members; a tree where it is alone costs nothing and is first.  So
  crowded branches stay deep, sparse ones get short, and every document reaches
  the target.  It then meets all members of its branches, whatever depth
  these chose themselves.
* Members of such a branch are joined if their whole signatures say that they
  are similar (estimate at least 0.8 of the threshold, over four standard
  deviations below it): a search from member to member that compares each only
  with those not yet reached, so a branch of thousands of variants costs a few
  passes.
* Verification: inside every group so joined, the exact intersection of all
  pairs is computed from whole texts in blocks of at most `BLOCK` documents and
  about `BLOCK_SHINGLES` shingles (products of incidence matrices), which gives
  each document's number of links and the links' components.  Pairs are never
  emitted, only counts and one row per document and block that names its
  component.

Scale: branches above `NODE` members and groups above a block are split into
blocks by a hash, and every pair of blocks is a task of its own, so no task
gathers an unbounded group; texts are shuffled once, and only those in groups
go on.  Cost is quadratic only in the number of different, mutually similar
texts, as every link counts.

Defined cases: a text of fewer than `N` words is one shingle; texts without
words (null, empty) are copies of one another; repeated rows each count as a
document; a doc_id with several texts gives a row for each, with the class and
links of that text; a row without doc_id is not compared (class_id null, no
links) and stays in the pipeline's stage.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.graph import connected_components
from terrane.sources.workspace import materialise

N = 5
THRESHOLD = 0.8
TREES, DEPTH, SHALLOW, TARGET = 24, 8, 5, 0.999
NODE, BLOCK = 4096, 512
BLOCK_SHINGLES = 8_000_000
KNOWN = 500_000
_ODD = np.random.default_rng(1234).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def choose_depths(sizes: dict[int, list[int]], threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, shallow: int = SHALLOW, target: float = TARGET) -> dict[int, int]:
    """Depth by tree for one document; `sizes`: its branch's members at depths `shallow`..`depth`, in the trees where it is not alone.

    All depths stay at `shallow` if the target is out of reach.
    """
    gain = {d: math.log1p(-(threshold ** (d - 1))) - math.log1p(-(threshold**d)) for d in range(shallow + 1, depth + 1)}
    # a tree where the document is alone is as short as can be, at no cost
    left = math.log1p(-target) - sum(math.log1p(-(threshold ** (depth if t in sizes else shallow))) for t in range(trees))
    at = dict.fromkeys(sizes, depth)
    cost = lambda t: (sizes[t][at[t] - 1 - shallow] - sizes[t][at[t] - shallow], t)
    heap = [cost(t) for t in sizes] if depth > shallow else []
    heapq.heapify(heap)
    while left < 0 and heap:
        _, t = heapq.heappop(heap)
        left -= gain[at[t]]
        at[t] -= 1
        if at[t] > shallow:
            heapq.heappush(heap, cost(t))
    return at


class Shingler:
    """Sets of hashed word n-grams."""

    def __init__(self, n: int = N):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted different 64-bit hashes of a text's shingles."""
        words = (text or "").encode(errors="replace").split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(self.known))
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(words))
        s = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            s += (h[j : len(h) - k + 1 + j] ^ (h[j : len(h) - k + 1 + j] >> np.uint64(29))) * _ODD[j]
        s ^= s >> np.uint64(31)
        s *= _ODD[40]
        s ^= s >> np.uint64(33)
        return np.unique(s + np.uint64(k != self.n) * _ODD[41 + k])


class MinHasher:
    def __init__(self, size: int):
        rng = np.random.default_rng(99)
        self.a = rng.integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(shingles), 4096):
            low = np.minimum(low, ((shingles[None, i : i + 4096] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
        return low


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")))


def _sets(docs: DataFrame, n: int, hashes: int) -> DataFrame:
    """`doc_id, text_key, sid, size, sig` of every row: a digest of its text, its set's digest, size and MinHash values."""

    def run(batches):
        shingle, minhash = Shingler(n), MinHasher(hashes)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingle(t) for t in part.column("text").to_pylist()]
                sid = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sid, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([minhash(s).tobytes() for s in sets], pa.binary())], ["doc_id", "text_key", "sid", "size", "sig"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key string, sid binary, size bigint, sig binary")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches, one table each."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if rest and any(rest[-1].column(k)[rest[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(cuts, cuts[1:]):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _blocks(df: DataFrame, group: str, blocks: str, member: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: adds `i, j, own` (i <= j; own its block); `blocks` is the group's number of blocks."""
    n = F.col(blocks).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), member), n).cast("int")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"), own.alias("own")))
    out = df.withColumn("__pair", F.explode(pair)).select(*df.columns, "__pair.*").drop(blocks)
    return out.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def reach(sig: np.ndarray, cut: int) -> np.ndarray:
    """Components (as the least index) of rows that agree in at least `cut` columns."""
    label = np.full(len(sig), -1)
    left = np.arange(len(sig))
    while len(left):
        root, fresh = left[0], left[:1]
        left = left[1:]
        label[root] = root
        while len(fresh) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(fresh), 64):
                todo = np.flatnonzero(~near)
                for c in range(0, len(todo), 2048):
                    at = todo[c : c + 2048]
                    near[at] = ((sig[fresh[i : i + 64], None, :] == sig[None, left[at], :]).sum(axis=2, dtype=np.int32) >= cut).any(axis=0)
            fresh, left = left[near], left[~near]
            label[fresh] = root
    return label


def _tries(sets: DataFrame, trees: int, depth: int, shallow: int) -> DataFrame:
    """`tree, root, node, b<d>..., n<d>...`: members that share their first `shallow` values in a tree, their branches below that root and the branches' sizes."""
    roots = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", t * depth * 4 + 1, shallow * 4)).alias("root")) for t in range(trees)])
    rows = sets.where("size > 0").select("node", F.explode(roots).alias("r")).select("node", "r.*").repartition("root")
    shared = rows.groupBy("root").agg(F.count(F.lit(1)).alias(f"n{shallow}")).where(f"n{shallow} > 1")
    rows = rows.join(shared.hint("shuffle_hash"), "root").join(sets.select("node", "sig"), "node")
    rows = rows.select("tree", "root", "node", f"n{shallow}", F.expr(f"substring(sig, tree * {depth * 4} + 1, {depth * 4})").alias("sig"))
    trie = Window.partitionBy("root").orderBy("sig", "node")
    before = F.lag("sig").over(trie)
    deeper = range(shallow + 1, depth + 1)
    # a new branch begins where the common prefix with the one before is shorter than d
    rows = rows.withColumns({f"s{d}": F.coalesce(F.substring("sig", 1, 4 * d) != F.substring(before, 1, 4 * d), F.lit(True)).cast("int") for d in deeper})
    rows = rows.withColumns({f"b{d}": F.sum(f"s{d}").over(trie.rowsBetween(Window.unboundedPreceding, 0)) for d in deeper} | {f"b{shallow}": F.lit(1).cast("long")})
    rows = rows.withColumns({f"n{d}": F.count(F.lit(1)).over(Window.partitionBy("root", f"b{d}")) for d in deeper})
    every = range(shallow, depth + 1)
    return materialise(rows.select("tree", "root", "node", *[f"b{d}" for d in every], *[f"n{d}" for d in every]), "tries", release=True)


def _depths(tries: DataFrame, threshold: float, trees: int, depth: int, shallow: int, target: float) -> DataFrame:
    """`node, tree, depth`: the length of each member's prefix in each tree where it is not alone."""
    every = range(shallow, depth + 1)

    def run(batches):
        for t in runs(batches, ["node"]):
            sizes = dict(zip(t.column("tree").to_pylist(), zip(*(t.column(f"n{d}").to_pylist() for d in every))))
            at = choose_depths(sizes, threshold, trees, depth, shallow, target)
            yield pa.RecordBatch.from_arrays([pa.array([t.column("node")[0].as_py()] * len(at), pa.int64()), pa.array(list(at), pa.int32()), pa.array(list(at.values()), pa.int32())], ["node", "tree", "depth"])

    rows = tries.select("node", "tree", *[f"n{d}" for d in every]).repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(run, "node bigint, tree int, depth int")


def _branches(sets: DataFrame, threshold: float, trees: int, depth: int, shallow: int, target: float) -> DataFrame:
    """`branch, count, node`: the members of every branch that some member's prefix ends in."""
    tries = _tries(sets, trees, depth, shallow)
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"n{d}").alias("count"), F.xxhash64(F.lit(d), "root", f"b{d}").alias("branch")) for d in range(shallow, depth + 1)]))
    rows = tries.select("node", "tree", at.alias("p")).select("node", "tree", "p.*").where("count > 1")
    met = rows.join(_depths(tries, threshold, trees, depth, shallow, target), ["node", "tree", "depth"]).select("branch").distinct()
    return materialise(rows.join(met, "branch").select("branch", "count", "node"), "branches", release=True)


def _groups(sets: DataFrame, threshold: float, trees: int, depth: int, shallow: int, target: float, cut: float) -> DataFrame:
    """`node, component` over nodes that are similar by their signatures."""
    members = _branches(sets, threshold, trees, depth, shallow, target).join(sets.select("node", "sig"), "node")
    need = int(np.ceil(cut * trees * depth))

    def run(batches):
        for t in runs(batches, ["branch", "i", "j"]):
            node, at = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            sig = np.frombuffer(b"".join(t.column("sig").take(at).to_pylist()), np.uint32).reshape(len(node), -1)
            label = reach(sig, need)
            own = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["src", "dst"])

    rows = members.select("branch", F.ceil(F.col("count") / NODE).alias("blocks"), "node", "sig")
    return connected_components(_blocks(rows, "branch", "blocks", "node").mapInArrow(run, "src bigint, dst bigint"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    ids, owner = inverse[shared], owner[shared]
    _, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32 if len(flat) < 1 << 24 else np.float64)
    step = max(256, (1 << 23) // len(sets))
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        a, b = np.searchsorted(ids, [low, low + step])
        m = np.zeros((len(sets), min(step, int(ids[-1]) + 1 - low)), out.dtype)
        m[owner[a:b], ids[a:b] - low] = 1
        out += m @ m.T
    return out


def _verify(rows: DataFrame, docs: DataFrame, groups: DataFrame, n: int, threshold: float) -> DataFrame:
    """`node, peer, sets, copies`: links of each node by block pair, and the least node of its component there."""

    def run(batches):
        shingle = Shingler(n)
        for t in runs(batches, ["component", "i", "j"]):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)  # the texts of a node have the same set
            if len(node) < 2:
                continue
            copies, own = (t.column(c).to_numpy()[first] for c in ("n_copies", "own"))
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            got = [shingle(x) for x in t.column("text").take(first).to_pylist()]
            size = np.array([len(s) for s in got], np.float64)
            both = intersections(got)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            linked &= ~np.eye(len(node), dtype=bool)
            if i != j:
                linked &= own[:, None] != own[None, :]
            label = np.arange(len(node))
            while True:  # least label among neighbours; few passes, as components are near-cliques
                low = np.minimum(label, np.where(linked, label[None, :], len(node)).min(axis=1))
                if (low == label).all():
                    break
                label = low
            some = np.flatnonzero(linked.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(node[label[some]]), pa.array(linked[some].sum(axis=1).astype(np.int64)), pa.array((linked[some] @ copies).astype(np.int64))], ["node", "peer", "sets", "copies"]
            )

    # one row, of least doc_id and text, stands for its node's set
    chosen = rows.where("doc_id is not null").join(groups.select("sid", "node"), "sid").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"))
    chosen = chosen.select("node", F.col("at.doc_id").alias("__id"), F.col("at.text_key").alias("__key")).join(groups, "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), text_key(F.col("text")).alias("__key"), "text").join(chosen.hint("shuffle_hash"), ["__id", "__key"])
    ready = _blocks(texts.select("component", "blocks", "node", "n_copies", "text"), "component", "blocks", "node")
    return materialise(ready.mapInArrow(run, "node bigint, peer bigint, sets bigint, copies bigint"), "links", release=True)


def _classes(docs: DataFrame, threshold: float, n: int, trees: int, depth: int, shallow: int, target: float) -> DataFrame:
    """`doc_id, text_key, class, class_id, n_links, n_texts, n_copies` of every row; `class` is its component's number, null without a doc_id."""
    rows = materialise(_sets(docs, n, trees * depth), "sets")
    sets = rows.where("doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.min("size").alias("size"), F.min("sig").alias("sig"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "distinct", release=True)
    groups = _groups(sets, threshold, trees, depth, shallow, target, 0.8 * threshold)
    groups = groups.join(sets.select("node", "sid", "n_copies", "size"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    groups = materialise(groups.join(groups.groupBy("component").agg(blocks), "component").drop("size"), "groups")
    links = _verify(rows, docs, groups, n, threshold)
    counts = links.groupBy("node").agg(F.sum("sets").alias("n_texts"), F.sum("copies").alias("linked"))
    parts = connected_components(links, "node", "peer").join(sets.select("node", "rep"), "node")
    parts = parts.join(parts.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("node", "component", "class_id")
    known = sets.select("sid", "node", "rep", "n_copies").join(counts, "node", "left").join(parts, "node", "left")
    named, zero = F.col("doc_id").isNotNull(), F.lit(0).cast("long")
    return rows.select("doc_id", "text_key", "sid").join(known, "sid", "left").select(
        "doc_id",
        "text_key",
        F.when(named, F.coalesce("component", "node")).alias("class"),
        F.when(named, F.coalesce("class_id", "rep")).alias("class_id"),
        F.when(named, F.coalesce("linked", zero) + F.col("n_copies") - 1).otherwise(zero).alias("n_links"),
        F.when(named, F.coalesce("n_texts", zero)).otherwise(zero).alias("n_texts"),
        F.when(named, F.col("n_copies")).otherwise(zero + 1).alias("n_copies"),
    )


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, trees: int = TREES, depth: int = DEPTH, shallow: int = SHALLOW, target: float = TARGET) -> DataFrame:
    """`doc_id, class_id, n_links, n_texts, n_copies` of every document.

    class_id: the least doc_id of its component of links; n_links: other
    documents at similarity `threshold` or more, copies included; n_texts:
    different sets among them, other than its own; n_copies: documents with
    its own set, itself included.
    """
    return _classes(docs, threshold, n, trees, depth, shallow, target).drop("text_key", "class")


def ngram_stage(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the least doc_id (then of the least digest of its text), with the input's columns."""
    rows = materialise(_classes(docs, threshold, N, TREES, DEPTH, SHALLOW, TARGET), "classes", release=True)
    stay = rows.where("doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("at"))
    stay = stay.select(F.col("at.doc_id").alias("__id"), F.col("at.text_key").alias("__key"))
    kept = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": text_key(F.col("text"))}).join(stay, ["__id", "__key"])
    # equal texts under one doc_id are one document
    same = Window.partitionBy("__id", "__key").orderBy(*[c for c in docs.columns if c != "text" and not docs.schema[c].dataType.typeName() in ("map", "variant")])
    kept = kept.withColumn("__copy", F.row_number().over(same)).where("__copy = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
