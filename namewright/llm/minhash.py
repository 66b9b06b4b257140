"""One-permutation MinHash fingerprints, by DataFrame expressions only.

The hashes of a text's word shingles are computed once; the top bits choose a bin and each bin keeps
its least hash.  An empty bin takes the value of the first bin with one on a probing sequence of its
own (optimal densification: all empty bins choose independently and alike in every text).  The low
`BITS` bits of each bin are packed as hex, and likenesses are corrected for chance agreement.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namewright.llm.common import stored

SHINGLE = 5
BINS = 128
BITS = 8
VALUE_BITS = 48
#: Rows of a range in the order of ids, as long as ranges are no more than MOST_RANGES; sampled rows a range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 2048, 1 << 16, 4


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed_hashes(text: Column) -> Column:
    """(bin << 48 | hash) of every shingle of at most SHINGLE words; lower case, white space apart."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        last = F.size(w) - SHINGLE
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(many)

    return F.transform(_let(words, shingles), lambda h: F.shiftrightunsigned(h, 64 - VALUE_BITS - BINS.bit_length() + 1))


def bins(text: Column) -> Column:
    """The least value of each of the BINS bins, null where a bin is empty."""
    empty = (1 << VALUE_BITS) - 1
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), VALUE_BITS).bitwiseOR(F.lit(empty).cast("long")))

    def least(a: Column) -> Column:
        first = F.filter(a, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, VALUE_BITS) != F.shiftrightunsigned(F.get(a, i - 1), VALUE_BITS)))
        return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(empty).cast("long")) != empty, x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")))

    return _let(F.sort_array(F.concat(_packed_hashes(text), marks)), least)


@functools.cache
def _probes() -> str:
    """Start and step of each bin's probing sequence, as a literal: the hashes are made once, not once a text."""
    start = lambda i: F.pmod(F.xxhash64(i, F.lit("start")), F.lit(BINS)).cast("int")
    step = lambda i: (F.pmod(F.xxhash64(i, F.lit("step")), F.lit(BINS // 2)) * 2 + 1).cast("int")
    plan = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(start(i).alias("a"), step(i).alias("s")))
    return SparkSession.active().range(1).select(F.to_json(plan)).first()[0]


def densified(found: Column) -> Column:
    """BINS values without nulls, or an empty array for a text without shingles.

    Bin i probes (start_i + n * step_i) mod BINS for n = 0, 1, ...; steps are odd, so every bin is
    reached.  coalesce stops at the first that holds a value.
    """
    plan = F.from_json(F.lit(_probes()), "array<struct<a: int, s: int>>")

    def fill(b: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            probes = [F.get(b, (p["a"] + p["s"] * n) % BINS) for n in range(BINS)]
            return F.coalesce(F.get(b, i), *probes)

        return F.when(F.exists(b, lambda x: x.isNotNull()), F.transform(plan, one)).otherwise(F.array().cast("array<int>"))

    return _let(found, fill)


def values(text: Column) -> Column:
    return densified(bins(F.coalesce(text, F.lit(""))))


def packed(filled: Column) -> Column:
    """Hex of the packed low-order bits; empty for a text without shingles."""
    return F.array_join(F.transform(filled, lambda v: F.lower(F.lpad(F.hex(v), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two value arrays: agreement corrected for chance, in [0, 1].  Two
    texts without shingles are alike; one without is unlike any other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    fixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(fixed)


def _range_of(rank: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are at most rank, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps([{"named": b.named, "id": b.id, "tie": b.tie} for b in bounds])), f"array<struct<named: boolean, id: {kind}, tie: bigint>>")

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        below = F.get(held, middle) <= rank
        done = at["low"] >= at["high"]
        return F.struct(F.when(done | ~below, at["low"]).otherwise(middle + 1).alias("low"), F.when(done | below, at["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve)["low"]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, rank, bucket, ghost) dealt by ranges of the order of ids, so that in each
    bucket the row after one is that of the next smaller id, and after the last the first.

    Bounds of ranges are rows of a sample (of at most SAMPLED * MOST_RANGES of them; they decide what
    stands together, never a result), so ranges are alike whatever the ids are.  The first row of each
    range is also sent, as a ghost, to the range before it.  Ties are taken in the order of the text's
    hash, null ids come last; both are split over ranges too, but for rows that are the same in id and text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = "bigint" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    own = F.col(id_col).cast(kind)
    order = F.struct(own.isNotNull().alias("named"), own.alias("id"), F.xxhash64(text).alias("tie"))
    total = docs.count()
    ranges = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    sample = docs.select(order.alias("rank")).sample(min(1.0, SAMPLED * ranges / total), seed=1).select("rank.*").collect() if ranges > 1 else []
    ranked = sorted(set(sample), key=lambda r: (r.named, r.id if r.named else 0 if kind == "bigint" else "", r.tie))
    bounds = [ranked[i] for i in sorted({len(ranked) * k // ranges for k in range(1, ranges)})] if ranked else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), order.alias("rank")).withColumn("bucket", _range_of(F.col("rank"), bounds, kind))
    # One thin row for each range, MOST_RANGES at most: few enough for one task and to broadcast.
    firsts = rows.groupBy("bucket").agg(F.max("rank").alias("first"))
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("bucket").over(Window.orderBy(F.desc("bucket")))
    firsts = stored(firsts.select("bucket", "first", F.coalesce(before, F.last("bucket").over(whole)).alias("target")), "minhash-ranges")
    held = rows.join(F.broadcast(firsts), "bucket")
    here, there = F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("ghost"))
    sent = F.when(F.col("rank").eqNullSafe(F.col("first")), F.array(here, there)).otherwise(F.array(here))
    return held.select("doc_id", "text", "rank", F.explode(sent).alias("to")).select("doc_id", "text", "rank", "to.bucket", "to.ghost")


def _in_order() -> object:
    return Window.partitionBy("bucket").orderBy("ghost", F.desc("rank"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its characters replaced by the first as many of the next
    text.  Null is the empty text; texts without words have an empty fingerprint; ids may be strings (then
    in their order); equal rows that tie for a range's first are sent on together and the first of them is
    taken; an empty table gives none; other columns are not looked at.
    """
    dealt = with_next(docs, id_col, text_col).withColumn("next_text", F.lead("text").over(_in_order()))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    made = dealt.withColumns({"n_chars": n.cast("long"), "edited": edited, "own": values(F.col("text"))})
    made = made.withColumn("next_own", F.lead("own").over(_in_order())).where(~F.col("ghost"))
    made = made.withColumn("changed", values(F.col("edited")))
    return made.select(
        F.col("doc_id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
