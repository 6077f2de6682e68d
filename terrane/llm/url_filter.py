"""URL filters: listed rules first, then gradient-boosted trees on lexical features (operator 6).

A rule `host/path` fits its host and all subdomains if the url's path starts
with the rule's path; the longest rule that fits decides (the longer host on a
tie).  Urls that no rule fits get the verdict of gradient-boosted trees trained
on urls that a rule has labelled.  Features: lengths of url, host and path,
path depth, digit ratio, entropy of characters, numbers of parameters, host
labels, hyphens and fragments, scheme, and suffix statistics: the smoothed
share of blocked urls among the labelled ones with the same last host label,
and with the same first path segment.  A labelled url gets the shares among the
labelled ones of the other of two folds, so that its own label is not in them.

The fit takes a bounded sample, about `SAMPLE` labelled urls per verdict;
suffix statistics count all labelled urls.

Scale: all features are built-in expressions; pages are read with their url
column only and never shuffled.  The statistics are partially aggregated
tables, broadcast only if their files are below the session's limit.

Defined cases: null urls, and urls without `://`, have empty host and path;
rules need the url's path to start with theirs, so an empty path fits none;
without labelled urls of both verdicts, an unlisted url gets the one verdict
seen, or `allow`.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.expr import let
from terrane.llm.sampling import bounded_sample
from terrane.sources.workspace import materialise

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SAMPLE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("len_url", "len_host", "len_path", "depth", "digit_share", "entropy", "n_params", "n_labels", "n_hyphens", "has_fragment", "is_https", "len_suffix", "suffix_block", "first_block")
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _URL, 2), UPPER, LOWER), F.regexp_extract(u, _URL, 3)


def listed(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1].index("/"))):
        h, p = r.split("/", 1)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(t: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    share = lambda c: (F.char_length(t) - F.char_length(F.replace(t, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda s, c: s - let(share(c), lambda p: p * F.log2(p)))


def url_features(pages: DataFrame) -> DataFrame:
    u = F.coalesce(F.col("url"), F.lit(""))
    host, path = parts(F.col("url"))
    out = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    return out.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "first": F.regexp_extract("path", r"^/([^/]*)", 1),
            "len_url": F.char_length(u).cast("double"),
            "len_host": F.char_length("host").cast("double"),
            "len_path": F.char_length("path").cast("double"),
            "depth": count(F.col("path"), "/[^/]"),
            "digit_share": count(u, "[0-9]") / F.greatest(F.char_length(u), F.lit(1)),
            "entropy": _entropy(u),
            "n_params": F.when(F.contains(u, F.lit("?")), count(F.regexp_extract(u, r"\?([^#]*)", 1), "[^&]+")).otherwise(0.0),
            "n_labels": count(F.col("host"), "[^.]+"),
            "n_hyphens": count(F.col("host"), "-"),
            "has_fragment": F.contains(u, F.lit("#")).cast("double"),
            "is_https": F.startswith(u, F.lit("https:")).cast("double"),
        }
    ).withColumn("len_suffix", F.char_length("suffix").cast("double"))


def _rates(labelled: DataFrame, by: str, prior: float = 0.5, weight: float = 4.0) -> DataFrame:
    """`by`, and the smoothed share of blocked urls: of all labelled ones, of fold 1 (for rows of fold 0) and of fold 0."""
    share = lambda fits: (F.count_if(fits & (F.col("listed") == "block")) + prior * weight) / (F.count_if(fits) + weight)
    every = {"all": F.lit(True), "0": F.col("__fold") == 1, "1": F.col("__fold") == 0}
    return materialise(labelled.groupBy(by).agg(*[share(fits).alias(f"{by}_{k}") for k, fits in every.items()]), f"{by}_rates")


def url_filter(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """`page_id, host, path, rule, verdict, block_score` of every page."""
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = url_features(pages).withColumns({"rule": rule, "listed": verdict, "__fold": F.pmod(F.xxhash64(F.lit(41), "url"), F.lit(2))})
    labelled = rows.where("listed is not null")
    for by in ("suffix", "first"):
        rate = F.when(F.col("listed").isNull(), F.col(f"{by}_all")).when(F.col("__fold") == 0, F.col(f"{by}_0")).otherwise(F.col(f"{by}_1"))
        rows = rows.join(_rates(labelled, by), by, "left").withColumn(f"{by}_block", F.coalesce(rate, F.lit(0.5)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(rows)
    train = bounded_sample(rows.where("listed is not null"), "listed", "url", sample)
    train = materialise(train.select("__x", (F.col("listed") == "block").cast("double").alias("__y")), "train")
    seen = [r[0] for r in train.select("__y").distinct().collect()]
    if len(seen) == 2:
        gbt = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=12, maxDepth=4, stepSize=0.3, seed=17, cacheNodeIds=False, predictionCol="__p")
        rows = gbt.fit(train).transform(rows)
        learned = F.when(F.col("__p") == 1.0, "block").otherwise("allow")
        score = F.element_at(vector_to_array(F.col("probability")), 2)
    else:
        learned, score = F.lit("block" if seen == [1.0] else "allow"), F.lit(None).cast("double")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", learned).alias("verdict"), score.alias("block_score"))
