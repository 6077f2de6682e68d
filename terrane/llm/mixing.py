"""Mixing sources to target weights, along a time-varying curriculum (operator 7).

Every source has a weight and a rate that changes over training time t in
[0, 1]: rate(t) = r0 + (2 - 2 r0) t, whose integral is 1, so that the source
still gives its whole target.  A source's documents stand in a fixed order (by
a hash of doc_id and text); a document's words lie at [a, a + size) in it, once per
epoch.  The cumulative demand of a source at time t is target * G(t) with
G(t) = r0 t + (1 - r0) t^2; inverting it at the words' place gives the training
position of each copy, and documents are range-sorted by position.

Targets: weights share the sum of all sizes; a source stops at `max_epochs`
times its size and the excess goes to the others by weight.  This is the water
level L with sum(min(cap, weight * L)) = total, found by one running sum over
sources in the order of cap / weight.

Scale: prefix sums run in two levels, inside (source, bucket) and over bucket
totals, so no task holds a source, and their number grows with the table.  The table of bucket sums has `buckets` rows
per source; Spark broadcasts it only if its files are below the session's
threshold, else it is joined by shuffle.

Defined cases: null or word-less text has size 0 and is never taken; a null
source is a source of its own, after all others; an empty table gives an empty
table; repeated rows each count; a total of 0 takes nothing.  Other columns of
the input are kept by `curriculum_stage` and ignored by `curriculum_mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import BLANK, WORD, n_words, source_key
from terrane.sources.workspace import materialise

WEIGHTS = (5.0, 2.0, 1.0)
#: Rates at t = 0 of the sources with these weights: the first falls, the last rises.
RATES = (1.5, 1.0, 0.5)
BUCKET_ROWS = 100_000


def mix_targets(sizes: DataFrame, weights=WEIGHTS, rates=RATES, max_epochs: int = 3) -> DataFrame:
    """`(__key, source, source_size)` -> the same with `target`, `rate` (one row per source)."""
    n = len(weights)
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    s = sizes.withColumn("__r", rank)
    s = s.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.col("__r") + 1))
    s = s.withColumn("rate", F.element_at(F.array(*map(F.lit, rates)), F.col("__r") + 1))
    s = s.withColumn("__cap", (F.col("source_size") * max_epochs).cast("double"))
    by = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("__caps", F.sum("__cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("__rest", F.sum("__w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("__all", F.sum("source_size").over(every).cast("double"))
    # the level if exactly the sources before this one are capped; from the first that fits on, levels fall
    level = (F.col("__all") - F.coalesce("__caps", F.lit(0.0))) / F.col("__rest")
    s = s.withColumn("__level", F.when(level * F.col("__w") <= F.col("__cap"), level))
    s = s.withColumn("__level", F.max("__level").over(every))
    return s.withColumn("target", F.least("__cap", F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))).select("__key", "source", "source_size", "target", "rate")


def mix_plan(sized: DataFrame, weights=WEIGHTS, rates=RATES, max_epochs: int = 3) -> DataFrame:
    """One row per (source, bucket) of `sized` (`__key, source, __b, __size`): words before it in its source, and the source's totals."""
    sums = materialise(sized.groupBy("__key", "source", "__b").agg(F.sum("__size").alias("__sum")), "sums")
    of = Window.partitionBy("__key")
    before = F.sum("__sum").over(of.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    totals = mix_targets(sums.groupBy("__key", "source").agg(F.sum("__sum").alias("source_size")), weights, rates, max_epochs)
    plan = sums.withColumn("__offset", before).select("__key", "__b", "__offset")
    return materialise(plan.join(totals.drop("source"), "__key"), "plan")


def _buckets(docs: DataFrame) -> int:
    """Buckets for a source's prefix sums: about `BUCKET_ROWS` rows in each, however large the table."""
    return max(256, docs.count() // BUCKET_ROWS)


def _sized(docs: DataFrame, buckets: int) -> DataFrame:
    out = docs.withColumn("__key", source_key(F.col("source"))).withColumn("__h", F.xxhash64(F.lit(7), "doc_id", "text"))
    return out.withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int"))


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, taken, positions and `__parts`, the words of each copy."""
    w = Window.partitionBy("__key", "__b").orderBy("__h", "doc_id", "__size")
    inside = F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    out = sized.withColumn("__inside", inside).join(plan, ["__key", "__b"])
    out = out.withColumn("__a", F.col("__inside") + F.col("__offset")).withColumn("__goal", F.round("target").cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.ceil(F.col("__goal") / F.col("source_size"))).otherwise(0).cast("int")
    part = lambda c: F.greatest(F.lit(0), F.least("__size", F.col("__goal") - c * F.col("source_size") - F.col("__a")))
    parts = F.when(epochs > 0, F.transform(F.sequence(F.lit(0), F.greatest(epochs - 1, F.lit(0))), part))
    out = out.withColumn("__parts", F.filter(F.coalesce(parts, F.array().cast("array<bigint>")), lambda x: x > 0))
    out = out.withColumn("taken", F.aggregate("__parts", F.lit(0).cast("long"), lambda s, x: s + x))
    r = F.col("rate")
    share = lambda c: F.least(F.lit(1.0), (F.col("__a") + c * F.col("source_size")) / F.col("__goal"))
    at = lambda y: F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (r + F.sqrt(r * r + 4 * (1 - r) * y)))
    return out.withColumn("positions", F.transform("__parts", lambda x, c: at(share(c))))


def curriculum_mix(docs: DataFrame, weights=WEIGHTS, rates=RATES, max_epochs: int = 3, buckets: int | None = None) -> DataFrame:
    """`(doc_id, size, source_size, target, taken, position, positions)` of every document, sorted by position.

    `position` is the training time of the first copy, null for a document that
    the mix does not take; `positions` has one entry per copy.
    """
    sized = _sized(docs, buckets or _buckets(docs)).select("doc_id", "__key", "source", "__h", "__b", n_words(F.col("text")).alias("__size"))
    sized = materialise(sized, "sizes")
    out = _taken(sized, mix_plan(sized, weights, rates, max_epochs))
    out = out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions", "__h")
    return out.orderBy(F.col("position").asc_nulls_last(), "__h", "doc_id").drop("__h")


def curriculum_stage(docs: DataFrame, weights=WEIGHTS, rates=RATES, max_epochs: int = 3, buckets: int | None = None) -> DataFrame:
    """The mixed corpus: the input's columns, one row per copy taken, in training order.

    A copy of which the mix takes only some words is cut at the end of its last
    word taken, with its white space as it was; where `n_chars` is a column it is set anew for such a copy.
    """
    cols = docs.columns
    sized = _sized(docs, buckets or _buckets(docs)).withColumn("__size", n_words(F.col("text")))
    plan = mix_plan(sized.select("__key", "source", "__b", "__size"), weights, rates, max_epochs)
    clash = [c for c in ("source_size", "target", "rate", "taken", "positions") if c in cols]
    kept = sized.withColumnsRenamed({c: f"__in_{c}" for c in clash})
    out = _taken(kept, plan).select(*[f"__in_{c}" if c in clash else c for c in cols], "__size", "__h", F.explode(F.arrays_zip("__parts", "positions")).alias("__copy"))
    out = out.orderBy("__copy.positions", "__h", "doc_id").withColumnsRenamed({f"__in_{c}": c for c in clash})
    cut = F.col("__copy.__parts") < F.col("__size")
    spaced = F.regexp_extract_all("text", F.lit(f"([{BLANK}]*{WORD})"), F.lit(1))  # each word with the blanks before it
    text = F.when(cut, F.array_join(F.slice(spaced, F.lit(1), F.col("__copy.__parts").cast("int")), "")).otherwise(F.col("text"))
    out = out.withColumn("__text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__text")).select(*cols)
