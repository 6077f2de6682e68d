"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 5).

Ratings: 0 for bad and toxic, 1 for one of the two, 2 for neither (grade =
quality + not toxic).  The model is P(grade <= j) = sigmoid(theta_j - w.x) with
one weight vector w shared by all grades and ordered thresholds theta; theta
is kept ordered by fitting its first value and the logarithms of its steps.
The fit is maximum likelihood with an L2 penalty, by Adam over the full batch.
A word's number takes part if its rows' grades differ from all rows' by at
least `SCREEN` standard deviations for some grade, which keeps rare words from
being learned by heart; the others keep weight 0.

x holds hashed text features: each different word (lower case, punctuation
stripped) once, and the shares of words by shape (trailing symbols, capitals,
equal to the word before, table bars, digits).  Whole texts are read.

`expected` is the expected grade, `tail` is P(grade >= 2); a document is
selected if tail >= `cutoff`.

The fit uses a bounded sample: about `SAMPLE` labelled rows of each grade, with
weights that restore the grades' true proportions.  Only that sample's feature
numbers reach the driver, and the model is `1 << BITS` floats.  The sampled ids
(three grades of about `SAMPLE` rows, whatever the input) are broadcast, so
that texts are not shuffled.

Defined cases: a null or word-less text has no words and gets tail 0, expected
0, not selected; labels with a null are not used and several labels of one
document count as its worst; with fewer than two grades among the labels the
model is constant and every text with a word is selected.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.sampling import bounded_sample

BITS = 18
SAMPLE = 4000
CUTOFF = 0.5
KNOWN = 500_000
SCREEN = 4.0
SHAPES = 8
_STRIP = b".,;:!?()[]{}\"'`#*$%&|<>=+-_/\\~^@"
_SYMBOL = re.compile(rb"[#*$%&<>=@^~]")


def _describe(word: bytes) -> tuple[int, int]:
    """A word's feature number (-1 for none) and its shape."""
    text = word.decode(errors="replace")
    core = word.strip(_STRIP).decode(errors="replace").lower().encode()
    shape = 1 if word == b"|" else 2 if _SYMBOL.search(word) else 3 if len(text) > 1 and text.isupper() else 4 if b"!" in word else 5 if word.isdigit() else 0
    return (SHAPES + zlib.crc32(core) % ((1 << BITS) - SHAPES) if core else -1), shape


class Features:
    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of a text."""
        words = (text or "").encode(errors="replace").split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        if len(self.known) > KNOWN:
            self.known.clear()
        new = set(words).difference(self.known)
        self.known.update((w, _describe(w)) for w in new)
        both = np.array(list(map(self.known.__getitem__, words)), np.int64)
        shape = np.bincount(both[:, 1], minlength=SHAPES)[:SHAPES].astype(np.float32)
        shape[0] = 0
        shape[6] = sum(map(bytes.__eq__, words, words[1:]))
        own = np.unique(both[:, 0])
        own = own[own >= 0]
        at = np.flatnonzero(shape)
        return np.concatenate([own, at]), np.concatenate([np.ones(len(own), np.float32), 8 * np.sqrt(shape[at] / len(words))]).astype(np.float32)


class OrdinalModel:
    """P(grade <= j) = sigmoid(theta_j - w.x)."""

    def __init__(self, w: np.ndarray, theta: np.ndarray, grades: list[int]):
        self.w, self.theta, self.grades = w, theta, grades

    @staticmethod
    def _chances(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """P(grade = each) by row."""
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1), axis=1)

    @staticmethod
    def _telling(at: np.ndarray, y: np.ndarray, grades: int, share: np.ndarray) -> np.ndarray:
        """Whether each feature number takes part in the fit."""
        rows = np.bincount(at, minlength=1 << BITS)
        out = np.zeros(1 << BITS, bool)
        for j in range(grades):
            due = rows * share[j]
            out |= np.abs(np.bincount(at[y == j], minlength=1 << BITS) - due) >= SCREEN * np.sqrt(np.maximum(due * (1 - share[j]), 0.25))
        out &= rows >= 3
        out[:SHAPES] = True
        return out

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, steps: int = 150, rate: float = 0.05):
        grades = sorted(set(grade.tolist()))
        w = np.zeros(1 << BITS)
        if len(grades) < 2:
            return cls(w.astype(np.float32), np.zeros(0), grades)
        y = np.searchsorted(grades, grade)
        at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        part = cls._telling(at, y[row], len(grades), np.bincount(y) / len(y))[at]
        at, value, row = at[part], value[part], row[part]
        weight = weight / weight.sum()
        share = np.cumsum(np.bincount(y, weight))[:-1].clip(1e-6, 1 - 1e-6)
        theta = np.log(share / (1 - share))
        free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, free)]
        for step in range(1, steps + 1):
            theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            z = np.bincount(row, value * w[at], len(rows))
            p = np.maximum(cls._chances(z, theta)[np.arange(len(y)), y], 1e-12)
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            density = lambda t: (s := 1 / (1 + np.exp(-np.clip(t - z, -40, 40)))) * (1 - s)
            up, low = density(edge[y + 1]), density(edge[y])
            dz = weight * (up - low) / p
            dt = np.array([(weight * ((y == j) * up - (y == j + 1) * low) / -p).sum() for j in range(len(theta))])
            tail = np.cumsum(dt[::-1])[::-1]
            grads = (np.bincount(at, value * dz[row], len(w)) + penalty * w, np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])]))
            for x, g, (m, v) in zip((w, free), grads, state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        return cls(w.astype(np.float32), theta, grades)

    def score(self, at: np.ndarray, value: np.ndarray) -> tuple[float, float]:
        """Expected grade and P(grade >= 2)."""
        if not len(at):
            return 0.0, 0.0
        if len(self.grades) < 2:
            return float(self.grades[0] if self.grades else 2), 1.0
        p = self._chances(np.array([float(self.w[at] @ value)]), self.theta)[0]
        return float(p @ self.grades), float(p[np.array(self.grades) >= 2].sum())


def _rated(labels: DataFrame) -> DataFrame:
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rated.groupBy("doc_id").agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    rated = _rated(labels)
    totals = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    chosen = bounded_sample(rated, "grade", "doc_id", sample)

    def run(batches):
        features = Features()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([a for a, _ in got], pa.list_(pa.int64())), pa.array([v for _, v in got], pa.list_(pa.float32()))], ["grade", "at", "value"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(run, "grade int, at array<bigint>, value array<float>")
    got = rows.toArrow()
    grade = got.column("grade").to_numpy()
    feats = [(a.astype(np.int64), v.astype(np.float32)) for a, v in zip(got.column("at").to_numpy(), got.column("value").to_numpy())]
    taken = {g: max(1, int((grade == g).sum())) for g in totals}
    weight = np.array([totals[g] / taken[g] for g in grade.tolist()], np.float64)
    return OrdinalModel.fit(feats, grade, weight)


def ordinal_quality(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """`doc_id, expected, tail, kept` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        features = Features()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [model.value.score(*features(t)) for t in part.column("text").to_pylist()]
                expected, tail = [e for e, _ in got], [t for _, t in got]
                kept = [t >= cutoff for t in tail]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", "expected", "tail", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected double, tail double, kept boolean")
