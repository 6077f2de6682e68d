"""Quality rules with risk-controlled thresholds (operator 1).

Base counts come from the words of the whole text.  A fixed base test rejects
texts that are too short or repeat themselves.  On top, each rule is a score
with a cutoff, and a text at or above a cutoff is rejected.  Cutoffs are
selected per stratum (language) from labelled rows:

* labelled rows are split in two by a hash of doc_id.  On the tuning half a
  cutoff is a candidate if it rejects at most half of the allowed share of good
  rows and at least one bad row;
* on the holdout half the candidates of a (stratum, rule) are tested from the
  most lenient on.  The test is exact: P(Binomial(n, alpha_r) <= k) for k
  rejected of n good rows, which is the level at which the upper
  Clopper-Pearson bound on the false rejection rate is below alpha_r.  Testing
  stops at the first failure (fixed sequence), which needs no correction over
  cutoffs; over strata and rules the level is divided by their number
  (Bonferroni).  The strictest cutoff that passed is used.

With probability 1 - delta no stratum loses more than `alpha` of its good
texts to the rules (alpha is shared equally by the rules).  A stratum with too
few good rows to pass any test gets no cutoff.

Scale: one pass makes the narrow score table; labels are joined to that, never
to texts; histograms are partially aggregated; the cutoff table has one row per
stratum and Spark broadcasts it only if its file is below the session's limit.

Defined cases: a null or word-less text has zero counts and base_failed; a null
language is a stratum of its own; a label whose quality is null is not used;
several labels of one document count as its worst; no labels, or no documents,
give no cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.expr import let
from terrane.llm.common import BLANK, WORD, words
from terrane.sources.workspace import materialise

#: Rules: score name -> cutoffs on trial, rising.
GRID = tuple(round(0.01 * 1.3**i, 5) for i in range(18))
RULES = ("symbol_share", "repeat_share", "dup_line_share", "capital_share", "mark_share")
ALPHA, DELTA = 0.05, 0.05
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column, n: int = 5) -> Column:
    """Words covered by `n`-word windows that occur at least twice in the array `w`."""
    last = lambda h: F.size(h) - n  # noqa: E731  index of the last window
    window = lambda h: F.transform(F.sequence(F.lit(0), last(h)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))

    def covered(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        same = lambda s, j: F.coalesce(F.get(s, j)["k"] == F.get(s, j + 1)["k"], F.lit(False))
        twice = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, j) | ((j > 0) & same(s, j - 1))), lambda x: x["i"])))
        gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
        return let(twice, lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda s, x: s + x))

    count = let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.when(
            F.size(h) > n,
            let(window(h), lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(0)),
        ).otherwise(0),
    )
    return count.cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rules' scores."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = lambda x: F.greatest(x, F.lit(1)).cast("double")
    out = docs.withColumn("__words", words(t))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")),
            "__lines": F.size(F.split(t, "\n")),
            "__capitals": F.regexp_count(t, F.lit(r"\p{Lu}{2,}")),
            "__marks": F.regexp_count(t, F.lit(r"[!?]")),
        }
    ).drop("__words")
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumns(
        {
            "symbol_share": F.col("n_symbols") / some(F.col("word_chars")),
            "repeat_share": F.col("n_repeat_words") / some(F.col("n_words")),
            "dup_line_share": F.col("n_dup_lines") / some(F.col("__lines")),
            "capital_share": F.col("__capitals") / some(F.col("n_words")),
            "mark_share": F.col("__marks") / some(F.col("n_words")),
        }
    ).drop("__lines", "__capitals", "__marks")


def stratum(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit(""))


def _lgamma(x: Column) -> Column:
    """ln Gamma(x), x >= 1, by Stirling's series at x + 8."""
    z = x + 8.0
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed downwards from k until terms are below double precision."""
    top = _lgamma(n + 1.0) - _lgamma(k + 1.0) - _lgamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k.cast("int"), F.ceil(40 * F.sqrt(n * p) + 100).cast("int"))
    ratio = lambda i: (k - i + 1.0) / (n - k + i) * ((1 - p) / p)  # noqa: E731  of term k-i to term k-i+1
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * ratio(i)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    some = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(some, zero, step, lambda acc: acc["s"])
    return F.when(k >= n, 1.0).when(k > n * p, 1.0).otherwise(F.exp(top) * total)


def select_cutoffs(scores: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid=GRID) -> DataFrame:
    """`(__stratum, <rule>...)`: the selected cutoffs, null where no cutoff passed; one row per stratum with any."""
    worst = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = scores.where("not base_failed").select("doc_id", "__stratum", *RULES).join(worst, "doc_id")
    known = known.withColumn("__half", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)))
    # the number of cutoffs that reject the row
    passed = lambda r: F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: F.col(r) >= g))
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), passed(r).alias("level")) for r in RULES]))
    counts = known.select("__stratum", "__half", "good", pairs.alias("p")).groupBy("__stratum", "__half", "good", "p.rule", "p.level").count()
    is_ = lambda half, good: F.sum(F.when((F.col("__half") == half) & (F.col("good") == good), F.col("count")).otherwise(0))
    hist = counts.groupBy("__stratum", "rule", "level").agg(is_(0, 1).alias("tg"), is_(0, 0).alias("tb"), is_(1, 1).alias("hg"))
    # cutoff i (1-based) rejects rows of level >= i
    cut = F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("i")
    sums = hist.select("__stratum", "rule", "level", "tg", "tb", "hg", cut).groupBy("__stratum", "rule", "i").agg(
        F.sum("tg").alias("n_tune"), F.sum("hg").alias("n"), *[F.sum(F.when(F.col("level") >= F.col("i"), F.col(c)).otherwise(0)).alias(f"k_{c}") for c in ("tg", "tb", "hg")]
    )
    a = alpha / len(RULES)
    strata = F.size(F.collect_set("__stratum").over(Window.partitionBy()))
    sums = sums.withColumn("tests", strata * len(RULES)).withColumn("p", binomial_tail(F.col("k_hg").cast("double"), F.col("n").cast("double"), a))
    fit = sums.where((F.col("k_tg") <= 0.5 * a * F.col("n_tune")) & (F.col("k_tb") > 0))
    lenient = Window.partitionBy("__stratum", "rule").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    fit = fit.withColumn("ok", F.min((F.col("p") <= delta / F.col("tests")).cast("int")).over(lenient))
    best = fit.where("ok = 1").groupBy("__stratum", "rule").agg(F.min("i").alias("i"))
    value = F.element_at(F.array(*map(F.lit, grid)), F.col("i"))
    return best.groupBy("__stratum").agg(*[F.min(F.when(F.col("rule") == r, value)).alias(f"__cut_{r}") for r in RULES])


def _verdict(scores: DataFrame, cutoffs: DataFrame) -> DataFrame:
    out = scores.join(cutoffs, "__stratum", "left")
    reject = F.lit(False)
    for r in RULES:
        reject = reject | F.coalesce(F.col(r) >= F.col(f"__cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~reject).drop("__stratum", *[f"__cut_{r}" for r in RULES])


def _scores(docs: DataFrame) -> DataFrame:
    return base_counts(docs.select("doc_id", "text", "lang")).withColumn("__stratum", stratum(F.col("lang"))).drop("text", "lang")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """`doc_id`, the base counts, base_failed, kept and the rules' scores of every document."""
    scores = materialise(_scores(docs), "scores")
    cutoffs = materialise(select_cutoffs(scores, labels, alpha, delta), "cutoffs")
    return _verdict(scores, cutoffs).select("doc_id", *BASE, "base_failed", "kept", *RULES)


def quality_stage(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that `quality_rules` keeps, with the input's columns.

    Texts are scored once and written beside their scores, whose columns alone
    are read for the cutoffs; no text is shuffled.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", stratum(F.col("lang")).alias("__stratum"))
    scored = materialise(base_counts(rows).drop("text"), "scored")
    cutoffs = materialise(select_cutoffs(scored.drop("__row"), labels, alpha, delta), "cutoffs")
    return _verdict(scored, cutoffs).where("kept").select("__row.*")
