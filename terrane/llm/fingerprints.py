"""Document fingerprints by consistent weighted sampling (operator 9).

Terms are pairs of neighbouring words (the word itself in a one-word text),
weighted by their number in the text.  For each of `SAMPLES` samples k and term
t of weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of (t, k):
q = floor(ln w / r + b), ln a = ln c - r (q - b + 1); the term of least a, with
its q, is the sample (Ioffe 2010).  Two texts' samples agree with probability
sum(min) / sum(max) of their weights, the generalised Jaccard similarity, and
the likeness of two fingerprints is the share of samples that agree.

All of it is built-in expressions.  Gamma variates come from tables of
`LEVELS` quantiles, so that a sample costs a hash, two lookups and a few
products; a sample is one long (ln a above, hash of term and q below), so the
least a is a plain minimum, kept by a hash aggregate inside whole-stage code.

Scale: texts are shuffled once, by doc_id, and only the needed head of the next
document a second time (a quarter of the bytes).  The next doc_id comes from a
range partitioning of the ids alone: a window inside each range and one row per
range for its border.  Aggregation keys extend doc_id, so terms are exploded
and reduced inside the partition that already holds the text.

Defined cases: null text counts as empty; a text without words has the
fingerprint `-`, which is like only itself; a table with one doc_id follows
itself; repeated rows of one doc_id follow the same next document, and as next
document the least of them is taken; a row without doc_id has no next document:
its tail is cut, near_next is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.expr import let
from terrane.llm.common import words
from terrane.sources.workspace import materialise

SAMPLES = 32
LEVELS = 8192


def _gamma_quantiles(n: int) -> list[float]:
    """Mid-quantiles of Gamma(2, 1): solutions of 1 - exp(-x) (1 + x) = p, by Newton's method."""
    out, x = [], 1e-3
    for i in range(n):
        p = (i + 0.5) / n
        for _ in range(60):
            step = (1 - math.exp(-x) * (1 + x) - p) / (x * math.exp(-x))
            x = max(x - step, x / 2)
            if abs(step) < 1e-12:
                break
        out.append(x)
    return out


def _tables(spark: SparkSession, n: int) -> tuple[Column, Column]:
    """Quantiles of r and of ln c as scalar subqueries over a one-row table, so that plans stay small."""
    gamma = _gamma_quantiles(n)
    constant = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")
    one = spark.range(1, numPartitions=1).select(constant(gamma).alias("r"), constant([math.log(x) for x in gamma]).alias("log_c"))
    one = materialise(one, "gamma")
    return one.select("r").scalar(), one.select("log_c").scalar()


def terms(text: Column) -> Column:
    """array<struct<t: bigint, w: int>>: a text's terms and how often each occurs."""
    pair = lambda h: F.when(
        F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))
    ).otherwise(h)
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s: let(
        first(s), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("t"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("w")))
    )
    once = lambda s: F.transform(s, lambda x: F.struct(x.alias("t"), F.lit(1).alias("w")))
    counted = lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), once(s)).when(F.size(s) > 0, runs(s))
    return let(F.transform(words(text), lambda x: F.xxhash64(x)), lambda h: let(F.sort_array(pair(h)), counted))


def samples(t: Column, log_w: Column, r_of: Column, log_c_of: Column, n: int = SAMPLES, levels: int = LEVELS) -> list[Column]:
    """The packed samples of one term: the least over a text's terms is its signature."""
    out = []
    for k in range(n):
        z = F.xxhash64(t, F.lit(k))
        bits = lambda shift, mask: F.shiftrightunsigned(z, shift).bitwiseAND(F.lit(mask))  # noqa: B023, E731
        r = F.get(r_of, bits(0, levels - 1).cast("int"))
        log_c = F.get(log_c_of, bits(13, levels - 1).cast("int"))
        b = bits(26, (1 << 24) - 1) / float(1 << 24)
        q = F.floor(log_w / r + b)
        log_a = log_c - r * (q - b + 1)
        rank = F.shiftleft(((log_a + 64.0) * float(1 << 33)).cast("long"), 23)
        out.append(rank.bitwiseOR(F.shiftrightunsigned(z, 41).bitwiseXOR(q).bitwiseAND(F.lit((1 << 23) - 1))))
    return out


def _next_ids(lengths: DataFrame) -> DataFrame:
    """`(doc_id, n, next_id)` for `(doc_id, n)` with each doc_id once, in ascending order and round."""
    ranged = materialise(lengths.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    borders = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    by = Window.orderBy("part")
    after = F.coalesce(F.lead("first").over(by), F.min("first").over(Window.partitionBy()))
    borders = materialise(borders.select("part", after.alias("after")), "borders")
    lead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("lead", lead).join(borders, "part").select("doc_id", "n", F.coalesce("lead", "after").alias("next_id"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """`doc_id, text, edited, next_id`: each text and it with its last quarter replaced by the next document's start."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = d.where("doc_id is not null")
    follow = materialise(_next_ids(named.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))), "follow")
    wanted = follow.select(F.col("doc_id").alias("for_id"), F.floor(F.col("n") / 4).cast("int").alias("q"), F.col("next_id"))
    heads = named.join(wanted, named["doc_id"] == wanted["next_id"]).select("for_id", "next_id", F.expr("substring(text, 1, q)").alias("head"))
    heads = heads.groupBy("for_id", "next_id").agg(F.min("head").alias("head"))
    both = named.join(heads, named["doc_id"] == heads["for_id"], "left").select("doc_id", "text", "head", "next_id")
    none = F.lit(None)
    both = both.unionByName(d.where("doc_id is null").select("doc_id", "text", none.cast("string").alias("head"), none.cast(d.schema["doc_id"].dataType).alias("next_id")))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.coalesce(F.substring(F.col("head"), F.lit(1), quarter), F.lit("")))
    return both.select("doc_id", "text", edited.alias("edited"), "next_id")


def _likeness(a: Column, b: Column, n: int) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / float(n)
    return F.coalesce(same, F.lit(0.0))


def fingerprint(texts: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """Adds `sig` (array<int>, nulls for a text without words) to rows that `keys` identify; `text` is dropped."""
    rows = texts.select(*keys, F.explode_outer(terms(F.col("text"))).alias("__t"))
    rows = rows.select(*keys, F.col("__t.t").alias("__x"), F.log(F.col("__t.w").cast("double")).alias("__w"))
    low = rows.groupBy(*keys).agg(*[F.min(s).alias(f"__s{k}") for k, s in enumerate(samples(F.col("__x"), F.col("__w"), *_tables(texts.sparkSession, LEVELS), n))])
    return low.select(*keys, F.array(*[F.col(f"__s{k}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for k in range(n)]).alias("sig"))


def fingerprint_text(sig: Column) -> Column:
    """Eight hexadecimal digits a sample; `-` for a text without words."""
    return F.when(F.get(sig, F.lit(0)).isNull(), F.lit("-")).otherwise(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""))


def document_fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` of every document."""
    pairs = edited_texts(docs).withColumn("uid", F.monotonically_increasing_id())
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["doc_id", "uid", "next_id", "n_chars", "edited_sha256"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    both = fingerprint(pairs.select(*keys, sides.alias("s")).select(*keys, "s.*"), [*keys, "side"], n)
    sig = lambda side: F.max(F.when(F.col("side") == side, F.col("sig")))
    done = materialise(both.groupBy(*keys).agg(sig(0).alias("sig"), sig(1).alias("edited_sig")), "signatures")
    after = done.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("sig").alias("next_sig"))
    out = done.join(after, "next_id", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("sig")).alias("fingerprint"), fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        _likeness(F.col("sig"), F.col("edited_sig"), n).alias("near_edited"), _likeness(F.col("sig"), F.col("next_sig"), n).alias("near_next"),
    )
