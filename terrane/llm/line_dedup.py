"""Fuzzy line deduplication by MinHash (operator 3), with built-in functions only.

Lines (split at \\n; those without a word are left alone) that are equal are one
line.  Two different lines are duplicates if the Jaccard similarity of their
sets of `SHINGLE`-character shingles (lower case, the end padded by blanks) is
at least `threshold`.  Of each connected group of duplicates, over all
documents, the one occurrence with the least (doc_id, place) stays.

* Signatures: `HASHES` minima over all shingles of every line, short or long.
* Banding: the 16 minima are the points of the affine plane of order 4, and the
  bands are its 20 lines of four points; two bands share one minimum at most.
  A pair of similarity 0.8 meets in some band with probability 0.995, one of
  0.85 with 0.999.
* Verification is exact, over all shingles of both lines, and comes in rounds
  with union-find between them, so that joined components drop out.  First
  every member of a band group meets the group's pivot, the line that shares
  the most bands with others in groups of three or more (of a line and its
  thousands of variants, mostly the line itself).  That settles the groups of
  two.  Then, in each of `ROUNDS` rounds, members of groups larger than `SMALL`
  meet their neighbours of another component in the order of their further bands.
* What is left are members outside their group's largest component.  They meet
  the rest of the group in one join, whose condition leaves out a pair only
  where a bound proves it below the threshold: by the sizes of its sets, or by
  the parities of its shingles in `BITS` buckets (buckets of unlike parity are
  at most as many as the shingles that one line has and the other has not).
  So every pair that a band proposes is joined, compared or ruled out by proof;
  pairs inside a component are never made.
* Union-find: `connected_components`, rounds of minima and joins.

Scale: equal lines are combined before the first shuffle, so a hot line is one
row.  Texts are shuffled for the distinct lines, for the pairs compared and once
for the documents with their decisions, each time after the former shuffle's
files are released.  Lines with candidates are found by a broadcast bit a line,
or by a shuffle beyond `BITMAPS`; their texts are kept and their shingles made
where a pair is compared.  Band rows are the key, with its number, and the id.  Every round's
pairs grow with the members of groups; only the last join's work grows with the
lines outside their group's largest component times the group, at some 50 ns a
pair, and what it returns are pairs close to the threshold.

Defined cases: null text stays null; a document none of whose lines with words
stays is empty (and dropped by the pipeline's stage); of equal rows (same doc_id
and text) one keeps its lines and the others lose all lines with words; a null
doc_id comes first in the order; other columns pass through `line_dedup_stage`.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.expr import let
from terrane.llm.common import BLANK
from terrane.operators.graph import connected_components
from terrane.sources.workspace import drop, materialise

SHINGLE = 8
HASHES = 16
THRESHOLD = 0.8
ROUNDS = 1
BITS = 1024
#: Shingles hashed in one row of the explosion of a line.
STEP = 4
#: Groups up to this size leave out the rounds: all their pairs of different components go into the last join.
SMALL = 64
#: Bitmaps of 32,768 lines that are broadcast at most (64 MB); more ids are joined by a shuffle.
BITMAPS = 16384
HAS_WORD = f"[^{BLANK}]"


def _plane() -> list[list[int]]:
    """The 20 lines of the affine plane of order 4: points 4 x + y, lines x = c and y = m x + c over the field of four elements."""
    double = lambda a: (a << 1) ^ (7 if a & 2 else 0)  # noqa: E731  modulo z^2 + z + 1
    times = lambda a, b: (b if a & 1 else 0) ^ (double(b) if a & 2 else 0)
    upright = [[4 * x + y for y in range(4)] for x in range(4)]
    return upright + [[4 * x + (times(m, x) ^ c) for x in range(4)] for m in range(4) for c in range(4)]


BANDS = _plane()


def coded_line(line: Column) -> Column:
    """The padded line, four bytes a character, so that a shingle is a slice at a known place."""
    return F.encode(F.concat(F.lower(line), F.lit(" " * (SHINGLE - 1))), "UTF-32")


def _places(coded: Column) -> Column:
    return (F.length(coded) / 4 - (SHINGLE - 1)).cast("int")


def _shingle_at(coded: Column, i: Column) -> Column:
    """Hash of the shingle at the 0-based place `i`."""
    return F.xxhash64(F.substring(coded, i * 4 + 1, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """Hashes of all different shingles of a line."""
    # over bytes, not characters, as every step of a lambda is interpreted
    last = lambda b: F.length(b) - (4 * SHINGLE - 1)
    return let(coded_line(line), lambda b: F.array_distinct(F.transform(F.sequence(F.lit(1), last(b), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE))))))


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def _id_key() -> Column:
    """A hash of the doc_id; beside the row key, which depends on the text too, it tells rows apart."""
    return F.xxhash64(F.lit(7), "doc_id")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """`id, at, line`: every different line with a word, and its first occurrence at (doc_id, row key, place); ids are unique numbers."""
    rows = docs.select("doc_id", _row_key(docs).alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(HAS_WORD)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(5), "line")})
    first = F.min(F.struct("doc_id", "row", "pos")).alias("at")
    rows = rows.groupBy("h1", "h2").agg(first, F.min("line").alias("line"))
    return materialise(rows.select(F.monotonically_increasing_id().alias("id"), "at", "line"), "lines", release=True)


def _minhash(h: Column, g: Column, k: int) -> Column:
    """The k-th hash of a shingle: one of two 64-bit hashes turned by whole bytes and salted, so that other bits lead in each."""
    x, turn = (h, g)[k // 8], 8 * (k % 8)
    x = F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)) if turn else x
    return x.bitwiseXOR(F.lit(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "big", signed=True)))


def signatures(lines: DataFrame) -> DataFrame:
    """`id, m0, m1, ...`: the minima of `HASHES` hashes over all shingles of each line."""
    coded = lines.select("id", coded_line(F.col("line")).alias("b")).withColumn("n", _places(F.col("b")))
    rows = coded.select("id", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP))).alias("i"))
    # past the end, the last shingle again
    rows = rows.select("id", *[_shingle_at(F.col("b"), F.least(F.col("i") + j, F.col("n") - 1)).alias(f"h{j}") for j in range(STEP)])
    rows = rows.select("*", *[F.xxhash64(f"h{j}").alias(f"g{j}") for j in range(STEP)])
    low = lambda k: F.least(*[_minhash(F.col(f"h{j}"), F.col(f"g{j}"), k) for j in range(STEP)])
    return rows.groupBy("id").agg(*[F.min(low(k)).alias(f"m{k}") for k in range(HASHES)])


def _candidates(lines: DataFrame) -> DataFrame:
    """`band, id, n`: the members of every band group of at least two lines; n is the group's size, and the band's lowest bits its number."""
    key = lambda b, own: F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in own]).bitwiseAND(F.lit(~31)).bitwiseOR(F.lit(b))
    bands = signatures(lines).select("id", F.explode(F.array(*[key(b, own) for b, own in enumerate(BANDS)])).alias("band")).repartition("band")
    # least and greatest id, so that both sides read one and the same shuffle of (id, band)
    groups = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "n")
    return materialise(bands.join(groups.hint("shuffle_hash"), "band").select("band", "id", "n"), "candidates", release=True)


def _number(band: Column) -> Column:
    return band.bitwiseAND(F.lit(31)).cast("int")


def _split(table: DataFrame, ids: DataFrame, there: bool) -> DataFrame:
    """The rows of `table` whose id is (`there`) or is not among `ids`, which go as bitmaps, one bit a line, so that wide rows need no shuffle."""
    bits = ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    bits = materialise(bits, "bits", observe={"n": F.count(F.lit(1))})
    if bits.observed["n"] > BITMAPS:
        return table.join(ids.distinct(), "id", "left_semi" if there else "left_anti")
    at = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(0)) == F.lit(int(there))
    return table.withColumn("bucket", F.bitmap_bucket_number("id")).join(F.broadcast(bits), "bucket", "left").where(found).select(*table.columns)


def _marks(texts: DataFrame) -> DataFrame:
    """`id, size, x0, x1, ...`: the size of a line's set and the parities of its shingles in `BITS` buckets."""
    rows = texts.select("id", F.explode(shingles(F.col("line"))).alias("s"))
    rows = rows.select("id", F.pmod("s", F.lit(BITS // 64)).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("s", 58).cast("int")).alias("x"))
    words = rows.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("x").alias("x"))
    marks = words.groupBy("id").agg(F.sum("n").alias("size"), *[F.bit_xor(F.when(F.col("word") == k, F.col("x")).otherwise(F.lit(0).cast("long"))).alias(f"x{k}") for k in range(BITS // 64)])
    return materialise(marks, "marks", release=True)


def _may_be_near(threshold: float) -> Column:
    """Whether neither the sizes nor the parities of two lines, columns `.._a` and `.._b`, rule out the threshold."""
    unlike = reduce(add, [F.bit_count(F.col(f"x{k}_a").bitwiseXOR(F.col(f"x{k}_b"))) for k in range(BITS // 64)])
    sizes = F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - 1e-6
    return sizes & (unlike <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("size_a") + F.col("size_b")) + 1e-6)


def _side(marks: DataFrame, side: str) -> DataFrame:
    return marks.select(*[F.col(c).alias(f"{c}_{side}") for c in marks.columns])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose lines' Jaccard similarity reaches `threshold`."""
    pairs = materialise(pairs, "pairs")
    a, b = (texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", *[shingles(F.col(f"line_{x}")).alias(f"set_{x}") for x in "ab"])
    both = both.withColumn("n", F.size(F.array_intersect("set_a", "set_b")))
    # written before it is filtered, or the filter would make the sets again
    both = both.select("a", "b", (F.col("n") >= F.lit(threshold) * (F.size("set_a") + F.size("set_b") - F.col("n"))).alias("near"))
    compared = materialise(both, "verified", release=True, observe={"n": F.count_if("near")})
    drop(pairs)
    near = compared.where("near").select("a", "b")
    near._written_at, near.observed = compared._written_at, compared.observed
    return near


def _possible(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) that no bound rules out."""
    both = pairs.join(_side(marks, "a").withColumnRenamed("id_a", "a"), "a").join(_side(marks, "b").withColumnRenamed("id_b", "b"), "b")
    return both.where(_may_be_near(threshold)).select("a", "b")


def _pivot_pairs(cand: DataFrame) -> DataFrame:
    """`a, b`: both members of a band group of two; of a larger one, every member and the group's pivot."""
    twos = cand.where("n = 2").groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    more = cand.where("n > 2")
    central = more.groupBy("id").agg(F.sum(F.col("n") - 1).alias("c"))
    pivots = more.join(central, "id").groupBy("band").agg(F.max(F.struct("c", "id"))["id"].alias("p"))
    pairs = more.join(pivots, "band").where("id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    return twos.unionByName(pairs).distinct()


def _open(cand: DataFrame, parts: DataFrame) -> DataFrame:
    """`band, id, n, part, loose`: the members of groups of three or more that hold several components; loose if not in the group's largest."""
    # the only pair of a group of two is its pivot's, which has been compared
    known = cand.where("n > 2").join(parts.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("part"))
    largest = known.groupBy("band", "part").count().groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("count", "part"))["part"].alias("main"))
    rows = known.join(largest.where("parts > 1"), "band").select("band", "id", "n", "part", (F.col("part") != F.col("main")).alias("loose"))
    return materialise(rows, "open", observe={"n": F.count(F.lit(1)), "large": F.count_if(F.col("n") > SMALL)})


def _neighbours(members: DataFrame, keys: DataFrame, turn: int) -> DataFrame:
    """`a, b`: members of a group, next or next but one to each other in the order of their other bands, and of different components."""
    n = len(BANDS)
    # the member's keys of two further bands; null where it shares the band with no one
    further = [F.get("keys", F.pmod(_number(F.col("band")) + k, F.lit(n))) for k in (1 + 2 * turn, 2 + 2 * turn)]
    rows = members.join(keys, "id").select("band", *[k.alias(f"k{i}") for i, k in enumerate(further)], "id", "part")
    order = ["band", "k0", "k1", "id"]
    rows = rows.repartitionByRange(*order).withColumn("__task", F.spark_partition_id())
    over = Window.partitionBy("__task").orderBy(*order)
    before = [F.lag(F.struct("band", "id", "part"), k).over(over).alias(f"p{k}") for k in (1, 2)]
    rows = rows.select("band", "id", "part", *before).select("band", "id", "part", F.explode(F.array("p1", "p2")).alias("p"))
    rows = rows.where("p is not null and p.band = band and p.part <> part")
    return rows.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _rest(members: DataFrame, keys: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """`a, b`: the pairs of different components in a group that no bound rules out, each once."""
    rows = materialise(members.drop("n").join(keys, "id").join(marks, "id"), "members")
    a, b = _side(rows, "a").where("loose_a"), _side(rows, "b")
    first = F.array_position(F.zip_with("keys_a", "keys_b", lambda x, y: F.coalesce(x == y, F.lit(False))), True) - 1
    fits = (F.col("part_a") != F.col("part_b")) & (~F.col("loose_b") | (F.col("id_a") < F.col("id_b"))) & _may_be_near(threshold)
    pairs = a.join(b, (F.col("band_a") == F.col("band_b")) & fits & (first == _number(F.col("band_a"))))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def duplicate_lines(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`node, component` over the ids of lines that have fuzzy duplicates."""
    return _linked(_candidates(lines), lines, threshold)[0]


def _keys(cand: DataFrame, ids: DataFrame) -> DataFrame:
    """`id, keys`: the bands of each of `ids` by number; null where it shares the band with no one."""
    rows = cand.join(ids, "id", "left_semi")
    return materialise(rows.groupBy("id").agg(F.array(*[F.max(F.when(_number(F.col("band")) == b, F.col("band"))) for b in range(len(BANDS))]).alias("keys")), "keys")


def _linked(cand: DataFrame, lines: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The components, as `duplicate_lines` has them, and the rows of `lines` with candidates."""
    texts = materialise(_split(lines, cand.select("id"), True), "texts", release=True)
    links = _verified(_pivot_pairs(cand), texts, threshold)
    parts = connected_components(links, "a", "b")
    members = _open(cand, parts)
    if members.observed["n"]:
        # later members are among these
        ids = materialise(members.select("id").distinct(), "ids")
        marks, keys = _marks(texts.join(ids, "id", "left_semi")), _keys(cand, ids)
        for turn in range(ROUNDS + 1):
            if turn < ROUNDS and not members.observed["large"]:
                continue
            large = members.where(F.col("n") > SMALL)
            pairs = _possible(_neighbours(large, keys, turn), marks, threshold) if turn < ROUNDS else _rest(members, keys, marks, threshold)
            more = _verified(pairs, texts, threshold)
            if more.observed["n"]:
                known = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
                parts = connected_components(known.unionByName(more), "a", "b")
                if turn < ROUNDS:
                    drop(members)
                    members = _open(cand, parts)
                    if not members.observed["n"]:
                        break
            drop(more)
        drop(ids, marks, keys)
    drop(members)
    drop(cand, links)
    return parts, texts


def _decisions(docs: DataFrame, threshold: float) -> DataFrame:
    """`__row, __id, __stay`: the places of the lines that stay, for every document that keeps one."""
    lines = distinct_lines(docs)
    parts, texts = _linked(_candidates(lines), lines, threshold)
    members = texts.select("id", "at").join(parts.withColumnRenamed("node", "id"), "id")
    least = members.groupBy("component").agg(F.min("at").alias("least"))
    gone = materialise(members.join(least, "component").where("at <> least").select("id"), "gone", release=True)
    drop(texts)
    stay = _split(lines.select("id", "at"), gone, False).select("at.*")
    return stay.groupBy(F.col("row").alias("__row"), _id_key().alias("__id")).agg(F.collect_list("pos").alias("__stay"))


def _rebuilt(docs: DataFrame, threshold: float) -> DataFrame:
    """The input with `__new`, the text that stays, and `__lines`, `__kept`, its numbers of lines with a word."""
    # both keys are never null, so that the join and the numbers of copies share one shuffle of the texts
    rows = docs.withColumns({"__row": _row_key(docs), "__id": _id_key()}).join(_decisions(docs, threshold), ["__row", "__id"], "left")
    copy = F.row_number().over(Window.partitionBy("__row", "__id").orderBy("__row", "__id"))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("__stay", F.when(copy == 1, F.coalesce("__stay", none)).otherwise(none)).drop("__row", "__id")
    blank = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: ~F.get(x, i).rlike(HAS_WORD))
    made = let(
        F.split("text", "\n"),
        lambda x: let(
            blank(x),
            lambda y: F.struct(
                F.array_join(F.transform(F.array_sort(F.concat(F.col("__stay"), y)), lambda i: F.get(x, i)), "\n").alias("text"),
                (F.size(x) - F.size(y)).alias("lines"),
            ),
        ),
    )
    rows = rows.withColumn("__made", F.when(F.col("text").isNotNull(), made))
    return rows.withColumns({"__new": F.col("__made.text"), "__lines": F.coalesce("__made.lines", F.lit(0)), "__kept": F.size("__stay")}).drop("__made", "__stay")


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, n_lines, n_kept, n_chars, text_sha256` of every document: its lines with a word, those that stay, and the text that stays."""
    out = _rebuilt(docs.select("doc_id", "text"), threshold)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__kept").alias("n_kept"), F.char_length("__new").alias("n_chars"), F.sha2("__new", 256).alias("text_sha256"))


def line_dedup_stage(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the lines that stay, without those that lost all their lines with a word; `n_chars`, where it is a column, is set anew."""
    out = _rebuilt(docs, threshold).where("__lines = 0 or __kept > 0").withColumn("text", F.col("__new"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
