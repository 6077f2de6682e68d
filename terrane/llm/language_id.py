"""Language identification by prediction by partial matching (operator 8).

One byte context tree per language: counts of every byte after each context of
up to `ORDER` bytes, over word borders as well; a text begins after `ORDER`
spaces and ends with one.  With frozen counts a byte costs -log2 of its
probability, method C: n / (N + D) if it was seen after the context (N
occurrences, D different bytes), else an escape D / (N + D) and the same one
byte shorter, and after the empty context 1/256.  A text's code length is the
sum over all its bytes, and the language of the shortest code is predicted;
`score` is its share of 2^-length over the languages.

A word and the space after it cost the same everywhere but for the first
`ORDER` bytes, which see the bytes before the word.  So a worker scores the
rest of each different word once and looks it up later, and each different
pair of head and bytes before it once a batch (numpy, all languages together).
The table of known words is emptied when it holds `KNOWN` costs.

Training reads about `TRAIN_ROWS` labelled rows of each language, a documented
bound; there may be any number of languages, and each gets its tree.  Grams are
counted in Spark; only the counts, one row for each language and different
gram, reach the driver, which broadcasts the trees.  Every text is scored whole.

Defined cases: null text, or one without a letter, gives `und` and score 0; so
does everything if there is no training row.  A null doc_id is not held out,
and not trained on.  Ties go to the first language in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.sampling import bounded_sample

ORDER = 4
TRAIN_ROWS = 400
KNOWN = 4_000_000


def _buffer(texts: list[bytes]) -> np.ndarray:
    """The texts with `ORDER` spaces before and one after each."""
    return np.frombuffer(b"".join(b" " * ORDER + t + b" " for t in texts), np.uint8)


def _grams(window: np.ndarray, order: int) -> list[np.ndarray]:
    """For rows of `order` bytes and the byte after them: the gram of each order, the byte to code lowest."""
    grams, g = [], np.zeros(len(window), np.uint64)
    for k in range(order + 1):
        g = g | (window[:, order - k].astype(np.uint64) << np.uint64(8 * k))
        grams.append(g)
    return grams


def count_grams(text: bytes, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """The different grams of each order in a text, and how often each occurs."""
    window = np.lib.stride_tricks.sliding_window_view(_buffer([text]), order + 1)
    return [np.unique(g, return_counts=True) for g in _grams(window, order)]


class ContextTrees:
    """Frozen counts of some languages, merged: per order, the cost of each seen gram and each seen context's escape, by language.

    `counts`: for each language and order, sorted grams and their numbers.
    """

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER):
        self.names, self.order = sorted(counts), order
        trees = [counts[n] for n in self.names]
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(order + 1):
            seen = np.unique(np.concatenate([t[k][0] for t in trees])) if trees else np.zeros(0, np.uint64)
            ctx = np.unique(seen >> np.uint64(8))
            cost, esc = np.zeros((len(seen), len(trees))), np.zeros((len(ctx), len(trees)))
            if k:
                lower = self.costs[k - 1][np.searchsorted(self.grams[k - 1], seen & np.uint64((1 << 8 * k) - 1))]
            else:
                lower = np.full_like(cost, 8)
            at = np.searchsorted(ctx, seen >> np.uint64(8))
            for j, t in enumerate(trees):
                g, n = t[k]
                own, inverse, kinds = np.unique(g >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(inverse, n, len(own)) + kinds
                esc[np.searchsorted(ctx, own), j] = -np.log2(kinds / total)
                cost[:, j] = esc[at, j] + lower[:, j]
                cost[np.searchsorted(seen, g), j] = -np.log2(n / total[inverse])
            self.grams.append(seen), self.costs.append(cost), self.contexts.append(ctx), self.escapes.append(esc)

    @classmethod
    def of(cls, texts: dict[str, list[str]], order: int = ORDER) -> ContextTrees:
        """From texts in memory."""

        def merged(parts):
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(at, np.concatenate([p[1] for p in parts]), len(g))

        return cls({n: [merged(k) for k in zip(*(count_grams(t.encode(errors="replace"), order) for t in ts))] for n, ts in texts.items()}, order)

    def byte_costs(self, window: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each row after the bytes before it, per language."""
        grams = _grams(window, self.order)
        bits = np.zeros((len(window), len(self.names)))
        left = np.arange(len(window))
        for k in range(self.order, -1, -1):
            g = grams[k][left]
            at = np.minimum(np.searchsorted(self.grams[k], g), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == g
            bits[left[hit]] += self.costs[k][at[hit]]
            left, g = left[~hit], g[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], g), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == g
            bits[left[known]] += self.escapes[k][at[known]]
        bits[left] += 8
        return bits


class Scorer:
    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.most = max(1000, KNOWN // max(1, len(trees.names)))
        self.forget()

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.costs = np.zeros((1024, len(self.trees.names)))

    def learn(self, words: list[bytes]):
        """Cost of each word and its space from the byte on that has `ORDER` bytes of the word before it."""
        order, first = self.trees.order, len(self.known)
        while first + len(words) > len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        long = [i for i, w in enumerate(words) if len(w) >= order]
        if long:
            buf = np.frombuffer(b"".join(words[i] + b" " for i in long), np.uint8)
            size = np.array([len(words[i]) + 1 for i in long])
            view = np.lib.stride_tricks.sliding_window_view(buf, order + 1)
            begin = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(long)), size - order)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size - order) - (size - order), size - order) + np.repeat(begin, size - order)
            self.costs[first + np.array(long)] = np.add.reduceat(self.trees.byte_costs(view[at]), np.cumsum(size - order) - (size - order), axis=0)
        self.known.update(zip(words, range(first, first + len(words))))

    def heads(self, buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cost of the first bytes of each word (with its space `size` bytes from `begin`), at most `ORDER`, after the bytes before it."""
        order = self.trees.order
        padded = np.concatenate([buf, np.zeros(order, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 2 * order)
        key = view[begin - order].copy()
        key[:, order:][np.arange(order)[None, :] >= size[:, None]] = 0  # past the space
        packed, inverse = np.unique(key.view(np.uint64).ravel(), return_inverse=True)  # 2 * ORDER bytes are one number
        some = packed.view(np.uint8).reshape(len(packed), 2 * order)
        ends = (some[:, order:] == 32).argmax(axis=1)
        length = np.where((some[:, order:] == 32).any(axis=1), ends + 1, order)
        cost = np.zeros((len(packed), len(self.trees.names)))
        for j in range(order):
            now = np.flatnonzero(length > j)
            cost[now] += self.trees.byte_costs(some[now, j : j + order + 1])
        return cost[inverse]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text, per language."""
        coded = [t.encode(errors="replace") for t in texts]
        words = [t.split(b" ") for t in coded]
        if len(self.known) > self.most:
            self.forget()
        new = set().union(*words).difference(self.known)
        if new:
            self.learn(list(new))
        flat = [w for ws in words for w in ws]
        size = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        times = np.array([len(ws) for ws in words])
        first = np.cumsum(times) - times
        pad = np.zeros(len(flat), np.int64)
        pad[first] = self.trees.order
        begin = np.cumsum(size + pad) - size
        bits = self.costs[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))] + self.heads(_buffer(coded), begin, size)
        return np.add.reduceat(bits, first, axis=0)


def predict(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names = scorer.trees.names
    todo = [i for i, t in enumerate(texts) if names and t is not None and any(map(str.isalpha, t))]
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if todo:
        bits = scorer.lengths([texts[i] for i in todo])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
        for i, b, s in zip(todo, best, share):
            langs[i], scores[i] = names[b], float(s)
    return langs, scores


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> ContextTrees:
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(~_held_out())

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for k, (g, n) in enumerate(count_grams(text.encode(errors="replace"))):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array([k] * len(g), pa.int32()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "k", "gram", "n"])

    sample = bounded_sample(usable.select("doc_id", "lang", "text"), "lang", "doc_id", rows).select("lang", "text")
    counts = sample.mapInArrow(run, "lang string, k int, gram bigint, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    found: dict[str, list] = {}
    for (lang, k), part in counts.sort_values("gram").groupby(["lang", "k"]):
        found.setdefault(lang, [None] * (ORDER + 1))[k] = part["gram"].to_numpy().astype(np.uint64), part["n"].to_numpy().astype(np.float64)
    return ContextTrees(found)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows))

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                langs, scores = predict(scorer, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
