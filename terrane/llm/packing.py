"""Mixture-controlled packing by deficit round-robin over source queues (operator 4).

Every source is a queue of tokens.  In each round a source is credited a
quantum, `window` tokens times its target proportion; it serves whole tokens
and carries the rest of its credit, the deficit, into the next round.  The
tokens that source s has served after r rounds are therefore
A_s(r) = min(T_s, floor(r * quantum_s)), a closed form: a document's tokens
[a, b) of its queue fall into known rounds, and a round's place in the global
stream is the sum of A_s(r) over the sources.  So deficits carry over windows
and over partitions without any task waiting for another.  The stream is cut
into sequences of `length`; the last, short one is cut into powers of two, so
there is no padding at all.

Targets default to the sources' own shares of all tokens, which every window
can hold to the end; with other weights a source ends when its queue is empty
and windows hold the targets of the rest.

With `ordered`, the rows' files and places in them give an order (a curriculum's
positions, say), and the stream is packed in time slices: runs of `SLICE`
rows of a file, files by name.  A slice's targets are its own sources' shares,
so that windows follow targets that change along the order; a slice serves all
its tokens, so no credit is left over at its end, and sequences go on over it.
Without it there is one slice.

A queue's order is (input partition, row in it), or the rows' order.
Tokenizing gives every row its place among its task's rows of the same slice
and source; totals of tasks give the task's place.  Token ids are written once to the shared folder (two
bytes each) and read back; they are never shuffled.  Words are cut at ASCII
white space, which no token of this vocabulary spans, so each different word is
encoded once per worker (above `KNOWN` words, those met less than twice are
forgotten).

Scale: the driver holds one number, the total; the table of offsets has one row
per (slice, task, source) with the slice's totals by source, and is broadcast
only below the session's limit.  A piece costs time in proportion to the number
of sources in its slice.

Defined cases: a null or empty text is the one id `end`; a null source is a
queue of its own, the last; repeated rows are packed each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import source_key
from terrane.sources.workspace import materialise

LENGTH = 4096
WINDOW = 16 * LENGTH
SLICE = 20_000
END = 2
KNOWN = 900_000
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts, by a tokenizer none of whose tokens spans ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0
        self.at, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def trim(self):
        """Forget the words that were met less than twice since the last time."""
        stay = [w for w, i in self.known.items() if self.hits[i] > 1]
        which = np.fromiter(map(self.known.__getitem__, stay), np.int64, len(stay))
        size, at, ids = self.size[which], self.at[which], self.ids
        self.forget()
        self._add(stay, size, ids[_spans(at, size)])

    def _add(self, words: list[bytes], size: np.ndarray, flat: np.ndarray):
        n = len(self.known)
        while n + len(words) > len(self.at):
            self.at, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.hits))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + len(words))))

    def learn(self, words: list[bytes]):
        """Encode new words, joined by spaces, and tell by the tokens' places whose they are."""
        for i in range(0, len(words), 2000):
            some = [w.decode() for w in words[i : i + 2000]]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            flat = np.array(got.ids, np.int64)
            if len(flat) and flat.max() > 0xFFFF:
                raise ValueError("token ids above 65535 do not fit two bytes")
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])[:-1]
            owner = np.searchsorted(starts, np.fromiter((o[0] for o in got.offsets), np.int64, len(flat)), "right") - 1
            self._add(words[i : i + 2000], np.bincount(owner, minlength=len(some)), flat)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        split = [(t or "").encode().split() for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.known) > KNOWN:
            self.trim()
        which = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(which < 0).tolist()
        if new:
            self.learn(sorted({words[i] for i in new}))
            which[new] = [self.known[words[i]] for i in new]
        self.hits[: len(self.known)] += np.bincount(which, minlength=len(self.known))
        size = self.size[which]
        flat = self.ids[_spans(self.at[which], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, split)])]
        return [np.append(flat[a:b], np.uint16(END)) for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans [at, at + size), one after another."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Schedule:
    """Served tokens by round, for queues of `totals` tokens with `quanta` tokens of credit a round."""

    def __init__(self, totals: list[int], quanta: list[float]):
        self.totals, self.quanta = np.array(totals, np.int64), np.array(quanta, np.float64)
        self.rounds = int(max((np.ceil(t / q) for t, q in zip(totals, quanta)), default=0))

    def served(self, s, r: np.ndarray) -> np.ndarray:
        """A_s(r); everything after the last round."""
        credit = np.floor(np.minimum(r * self.quanta[s], 2.0**62)).astype(np.int64)
        return np.where(r > self.rounds, self.totals[s], np.minimum(credit, self.totals[s]))

    def round_of(self, s: int, x: np.ndarray) -> np.ndarray:
        """The round in which queue `s` serves its token number `x`."""
        r = np.maximum(np.ceil((x + 1) / self.quanta[s]) - 1, 0)
        for _ in range(3):
            r = r - (self.served(s, r) > x)
            r = r + (self.served(s, r + 1) <= x)
        return np.minimum(r, self.rounds)

    def pieces(self, s: int, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start in the document, length, place in the stream) of the tokens [a, b) of queue `s`."""
        first, last = (int(r) for r in self.round_of(s, np.array([a, b - 1], np.float64)))
        r = np.arange(first, last + 1, dtype=np.float64)
        low, high = self.served(s, r), self.served(s, r + 1)
        start, stop = np.maximum(low, a), np.minimum(high, b)
        place = np.zeros(len(r), np.int64)
        every = np.arange(len(self.totals))
        for i in range(0, len(r), 256):
            some = r[i : i + 256]
            place[i : i + 256] = self.served(every[None, :], some[:, None]).sum(axis=1) + (self.served(every[None, :s], some[:, None] + 1) - self.served(every[None, :s], some[:, None])).sum(axis=1)
        return [(x - a, y - x, p + x - w) for x, y, p, w in zip(start.tolist(), stop.tolist(), place.tolist(), low.tolist()) if y > x]


def sequence_cuts(total: int, length: int) -> list[int]:
    """Where the stream's last sequences start: the short rest as falling powers of two."""
    at, cuts = total - total % length, []
    while at < total:
        cuts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return [*cuts, total]


def _tokenize(docs: DataFrame, path: str, ordered: bool) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        encoder, before, first, part_id = WordEncoder.of(path), {}, {}, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                ids = encoder(part.column("text").to_pylist())
                row = part.column("row").to_pylist() if ordered else [part_id] * len(ids)
                where, parts, at = [], [], []
                # of a slice's and a source's rows in this task, the first one's place names the part
                for f, k, r, x in zip(part.column("file").to_pylist(), part.column("key").to_pylist(), row, ids):
                    where.append(r // SLICE if ordered else 0)
                    of = (f, where[-1], k)
                    parts.append(first.setdefault(of, r))
                    at.append(before.get(of, 0))
                    before[of] = at[-1] + len(x)
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("file"), pa.array(where, pa.int64()), part.column("key"), pa.array(parts, pa.int64()), pa.array(at, pa.int64()), n, pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "file", "slice", "key", "part", "at", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = ("_metadata.file_name", "_metadata.row_index") if ordered else (F.lit(""), F.lit(0).cast("long"))
    rows = docs.select("doc_id", source_key(F.col("source")).alias("key"), "text", *[(F.col(c) if ordered else c).alias(x) for c, x in zip(place, ("file", "row"))])
    return rows.mapInArrow(run, f"doc_id {kind}, file string, slice bigint, key string, part bigint, at bigint, n bigint, ids binary")


def _offsets(tokens: DataFrame) -> DataFrame:
    """`file, slice, key, part, before, base, queues`: tokens before the part in its queue, tokens before the slice in the stream, and the slice's queues in order."""
    sums = materialise(tokens.groupBy("file", "slice", "key", "part").agg(F.sum("n").alias("n")), "sums")
    queue = Window.partitionBy("file", "slice", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = sums.select("file", "slice", "key", "part", (F.sum("n").over(queue) - F.col("n")).alias("before"))
    of = F.struct((F.col("key") == "").alias("none"), F.col("key"), F.col("n"))
    slices = sums.groupBy("file", "slice", "key").agg(F.sum("n").alias("n")).groupBy("file", "slice").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(of)).alias("queues"))
    stream = Window.orderBy("file", "slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.select("file", "slice", (F.sum("n").over(stream) - F.col("n")).alias("base"), F.transform("queues", lambda q: F.struct(q["key"].alias("key"), q["n"].alias("n"))).alias("queues"))
    return materialise(parts.join(slices, ["file", "slice"]), "offsets")


def _schedule(queues: list[dict], weights: dict[str | None, float] | None, window: int) -> tuple[Schedule, dict[str, int]]:
    """A slice's schedule, and the number of each source in it."""
    keys, totals = [q["key"] for q in queues], [q["n"] for q in queues]
    if weights is None:
        share = [t / sum(totals) for t in totals]
    else:
        named = [float(weights.get(k[1:] if k else None, 0.0)) for k in keys]
        least = min((x for x in named if x > 0), default=1.0)
        named = [x if x > 0 else least for x in named]
        share = [x / sum(named) for x in named]
    return Schedule(totals, [window * x for x in share]), {k: i for i, k in enumerate(keys)}


def pack(docs: DataFrame, path: str, weights: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW, ordered: bool = False) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`.

    `weights` maps sources to target proportions (default: their own shares;
    sources that are not named get 0, and are served at the pace of the least).
    `ordered` packs in time slices along the rows' order; `docs` must then be
    Parquet files as read.
    """
    tokens = materialise(_tokenize(docs, path, ordered), "tokens")
    offsets = _offsets(tokens)
    total = offsets.select("file", "slice", "base", F.expr("aggregate(queues, 0L, (s, q) -> s + q.n)").alias("n")).agg(F.max(F.col("base") + F.col("n")).alias("n")).first()["n"] or 0
    cuts = sequence_cuts(total, length)
    whole = cuts[0]

    def run(batches):
        ends = np.array(cuts)
        now, plan, number = None, None, {}
        for batch in batches:
            rows = []
            queues = batch.column("queues")
            for r, (doc, slice_, key, base, at, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "name", "key", "base", "at", "n", "ids")))):
                if slice_ != now:
                    now, (plan, number) = slice_, _schedule(queues[r].as_py(), weights, window)
                wide = np.frombuffer(ids, np.uint16).astype("<u4")
                for start, size, place in plan.pieces(number[key], at, at + n):
                    place += base
                    while size:
                        if place < whole:
                            sequence, offset, room = place // length, place % length, length - place % length
                        else:
                            i = int(np.searchsorted(ends, place, "right")) - 1
                            sequence, offset, room = whole // length + i, place - cuts[i], cuts[i + 1] - place
                        own = min(size, room)
                        rows.append((doc, start, own, zlib.crc32(wide[start : start + own].tobytes()), n, sequence, offset))
                        start, size, place = start + own, size - own, place + own
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)] if rows else [pa.array([], f.type) for f in out], schema=out)

    out = pa.schema([("doc_id", _arrow(docs)), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = F.concat_ws("/", "file", "slice").alias("name")
    ready = tokens.join(offsets, ["file", "slice", "key", "part"]).select("doc_id", name, "key", "base", (F.col("before") + F.col("at")).alias("at"), "n", "ids", "queues")
    return ready.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _arrow(docs: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
