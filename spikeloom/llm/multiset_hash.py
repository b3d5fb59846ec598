"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text is a multiset of paragraphs: the parts between line ends, which are cut further behind sentence
ends. Each paragraph is hashed to a wide vector and the vectors are summed, each lane modulo 2**32: so the order of
paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (``combine``). The vector has three parts:

* one lane that counts paragraphs,
* ``EQUAL`` lanes of 32 hash bits, which tell multisets apart,
* 64 lanes of one hash bit each. Twice their sum less the count is a sum of random signs, so the squared
  distance of two fingerprints, over 64, estimates how many paragraphs differ. ``likeness`` is
  (a + b - d) / (a + b + d) for counts a, b and that estimate d: 1 for equal fingerprints, about the Jaccard
  similarity else, never below 0.

Two bit lanes share one long, 32 bits apart; sums stay below 2**31 paragraphs for a text.

Edge cases: null and empty texts have the zero fingerprint, and two of them are alike (1). Parts without any
character between separators count as no paragraph. Repeated rows and very long texts are treated as any
other. ``successors`` orders rows by id (nulls first) and breaks ties of an id by ``tie``, for which the query takes the text's hash; rows
that agree in both follow each other in any order. Extra columns keep their values. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spikeloom.llm.common import cut

#: Ends a paragraph: line ends, and white space behind a full stop, question or exclamation mark.
SEPARATOR = r"\n+|(?<=[.!?])\x20+"
EQUAL = 4
PAIRS = 32
LANES = 1 + EQUAL + 2 * PAIRS
LOW = 0xFFFFFFFF
PAIR = 0x0000000100000001
MODULUS = 1 << 32


def packed(text: Column) -> Column:
    """The sums as array<bigint>: count, EQUAL lanes, then PAIRS longs of two bit lanes each."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR, -1), lambda p: F.length(p) > 0)
    hashes = F.transform(parts, lambda p: F.struct(F.xxhash64(p).alias("bits"), F.xxhash64(p, F.lit(1)).alias("a"), F.xxhash64(p, F.lit(2)).alias("b")))
    zero = F.array_repeat(F.lit(0).cast("bigint"), 1 + EQUAL + PAIRS)

    def vector(h):
        equal = [h["a"].bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h["a"], 32), h["b"].bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h["b"], 32)]
        return F.array(F.lit(1).cast("bigint"), *equal, *(F.shiftrightunsigned(h["bits"], i).bitwiseAND(F.lit(PAIR)) for i in range(PAIRS)))

    return F.aggregate(hashes, zero, lambda acc, h: F.zip_with(acc, vector(h), lambda x, y: x + y))


def lanes(sums: Column) -> Column:
    """The LANES sums modulo 2**32."""
    head = F.transform(F.slice(sums, 1, 1 + EQUAL), lambda x: F.pmod(x, F.lit(MODULUS)))
    bits = F.slice(sums, 2 + EQUAL, PAIRS)
    return F.concat(head, F.transform(bits, lambda x: x.bitwiseAND(F.lit(LOW))), F.transform(bits, lambda x: F.shiftrightunsigned(x, 32)))


def fingerprint(text: Column) -> Column:
    """array<bigint> of LANES sums modulo 2**32."""
    return lanes(packed(text))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets, or with sign -1 of what is left without ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 if the fingerprints are equal."""
    n, m = a[0].cast("double"), b[0].cast("double")

    def signed(f):  # sums of +-1
        return F.transform(F.slice(f, 2 + EQUAL, 2 * PAIRS), lambda x: 2.0 * x - f[0])

    apart = F.aggregate(F.zip_with(signed(a), signed(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / (2 * PAIRS)
    d = F.least(F.greatest(apart, F.abs(n - m)), n + m)
    return F.when(a == b, 1.0).when(n + m == 0, 1.0).otherwise((n + m - d) / (n + m + d))


def as_text(f: Column) -> Column:
    """Lower-case hex, eight digits a lane."""
    return F.array_join(F.transform(f, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def ranges(docs: DataFrame, key: Column, width: int, knots: int = 64) -> Column:
    """A bigint that doesn't fall as ``key`` (bigint) rises and is shared by about ``width`` rows, wherever the keys lie.

    Approximate quantiles of the keys (``knots`` numbers) cut them into stretches of equal numbers of rows, and each stretch is cut evenly.
    """
    found = docs.where(key.isNotNull()).agg(F.count(F.lit(1)), F.approx_percentile(key, F.lit([i / knots for i in range(knots + 1)]), F.lit(1000)), F.min(key), F.max(key)).first()
    if not found[0]:
        return F.lit(0).cast("bigint")
    at = sorted({found[2], *found[1], found[3] + 1})
    parts = max(1, -(-found[0] // (width * knots)))
    stretch = F.size(F.filter(F.array(*(F.lit(a).cast("bigint") for a in at[1:-1])), lambda a: a <= key)).cast("bigint")
    low, high = (F.get(F.array(*(F.lit(a).cast("decimal(20,0)") for a in x)), stretch.cast("int")) for x in (at[:-1], at[1:]))
    inside = F.floor((key.cast("decimal(20,0)") - low).cast("double") / (high - low).cast("double") * F.lit(float(parts))).cast("bigint")
    return stretch * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))


def successors(docs: DataFrame, columns: list[str], id_col: str = "doc_id", tie: str | None = None, width: int = 256, broadcast_ranges: int = 1_000_000) -> DataFrame:
    """``docs`` with ``next``: the struct of ``columns`` of the row with the next larger id, after the last the first.

    Rows meet in ranges of about ``width`` rows, whether ids are dense, sparse or clustered (``ranges``); rows without an id are dealt to
    ranges by ``tie``. The first row of each range is also the successor of the last row of the range before, which a table of a few bytes for
    every range finds. Up to ``broadcast_ranges`` of them are broadcast, more are shuffled. Other columns keep their values but for one named next.
    """
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("bigint").alias("_id"), (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("_tie"))
    ids, ties = own.where("_id IS NOT NULL"), own.where("_id IS NULL")
    by_tie = ranges(ties, F.col("_tie"), width)
    before = F.lit(1 << 62)  # ranges of rows without an id come first
    rows = own.withColumn("_range", F.when(F.col("_id").isNull(), by_tie - before).otherwise(ranges(ids, F.col("_id"), width)))
    rows = rows.withColumn("_place", F.struct(F.col("_id").isNotNull().alias("some"), F.coalesce("_id", F.lit(0)).alias("id"), F.col("_tie").alias("tie")))
    firsts = cut(rows.groupBy("_range").agg(F.min("_place").alias("_place")))
    # the range before each range: blocks of ranges keep every window small
    blocks = firsts.withColumn("_block", F.floor(F.col("_range") / F.lit(4096)))
    ends = blocks.groupBy("_block").agg(F.max("_range").alias("tail"))
    wrap = ends.agg(F.max("tail").alias("wrap"))  # one row
    chain = ends.select("_block", F.lag("tail").over(W.orderBy("_block")).alias("before"))  # a row for about a million documents
    linked = blocks.join(chain, "_block").crossJoin(F.broadcast(wrap))
    linked = linked.select("_range", "_place", F.coalesce(F.lag("_range").over(W.partitionBy("_block").orderBy("_range")), "before", "wrap").alias("_before"))
    carried = F.struct(*(F.col("_row").getField(c).alias(c) for c in columns))
    small = firsts.count() <= broadcast_ranges
    edge = rows.join(F.broadcast(linked) if small else linked, ["_range", "_place"]).groupBy("_before").agg(F.any_value(carried).alias("_first")).withColumnRenamed("_before", "_range")
    out = rows.withColumn("_next", F.lead(carried).over(W.partitionBy("_range").orderBy("_place")))
    out = out.join(edge, "_range", "left").withColumn("next", F.coalesce("_next", "_first"))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c != "next"), "next")
