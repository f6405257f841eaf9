"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text is a multiset of paragraphs (line breaks and sentence ends part them; empty ones don't count).
Each paragraph is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo a power of two. So the order of paragraphs doesn't matter, a paragraph is
inserted by adding its vector and deleted by subtracting it, and two texts with equal multisets have
equal fingerprints. The lanes are

* ``n``: the number of paragraphs,
* ``words``: 8 lanes modulo 2**62 of hash words, 496 bits in all; they decide equality,
* ``signs``: 62 counts of hash bits, two 31-bit fields to each of 31 longs: a field holds more
  paragraphs than a text can have. Bit b of a paragraph stands for +1 or -1, so 2 * count - n is a
  random projection of the multiset and squared differences of projections estimate the squared
  distance of two multisets (standard deviation of the likeness: about 0.15 in the middle). The words
  can't help there: their sums wrap, so that they tell equal from unequal and nothing else.

Likeness of two fingerprints is 1 - |A - B|^2 / (|A|^2 + |B|^2) with these estimates, cut to 0..1; it
is 1 for equal fingerprints, and below 1 for unequal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.llm._tables import cut, table

PARAGRAPH_BREAK = r"\n+|(?<=[.!?]) +"
WORDS, FIELDS, FIELD_BITS = 8, 2, 31
_WORD = _LONG = (1 << 62) - 1
_FIELD = (1 << FIELD_BITS) - 1
RANGES, DRAWN = 3, 20  # ranges of ids to a partition, and rows that a range's end is drawn from
_LOW = sum(1 << (FIELD_BITS * k) for k in range(FIELDS))


def paragraph_hashes(text: Column, paragraph_break: str = PARAGRAPH_BREAK) -> Column:
    """An array with two independent 64-bit hashes of each paragraph; null text: empty."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), paragraph_break), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit("second"), p).alias("b")))


def _total(hashes: Column, lane, modulus: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: (acc + lane(h)).bitwiseAND(F.lit(modulus)))


def fingerprint(hashes: Column) -> Column:
    """struct(n, words array<bigint>, signs array<bigint>) of paragraph hashes."""
    words = []
    for i in range(WORDS):
        word = lambda h, i=i: F.xxhash64(h["a"], h["b"], F.lit(i)).bitwiseAND(F.lit(_WORD))
        words.append(_total(hashes, word, _WORD))
    signs = [_total(hashes, lambda h, j=j: F.shiftrightunsigned(h["a"], j).bitwiseAND(F.lit(_LOW)), _LONG) for j in range(FIELD_BITS)]
    return F.struct(F.size(hashes).cast("bigint").alias("n"), F.array(*words).alias("words"), F.array(*signs).alias("signs"))


def combine(left: Column, right: Column, subtract: bool = False) -> Column:
    """Fingerprint of the multiset sum, or of what is left after deleting right's paragraphs from left's."""
    sign = F.lit(-1 if subtract else 1)
    lanes = lambda name, m: F.zip_with(left[name], right[name], lambda x, y: (x + sign * y).bitwiseAND(F.lit(m)))
    return F.struct((left["n"] + sign * right["n"]).alias("n"), lanes("words", _WORD).alias("words"), lanes("signs", _LONG).alias("signs"))


def encode(fp: Column) -> Column:
    """Hex string: 16 digits for n, for each word and for each long of sign counts."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(
        digits(fp["n"], 16), F.array_join(F.transform(fp["words"], lambda x: digits(x, 16)), ""), F.array_join(F.transform(fp["signs"], lambda x: digits(x, 16)), ""),
    )


def _square(x: Column, y: Column | None, n: Column) -> Column:
    """Sum over lanes of the squared difference of projections; n: difference of paragraph counts."""
    def fields(a: Column, b: Column | None) -> Column:
        total = None
        for k in range(FIELDS):
            cut = lambda v: F.shiftrightunsigned(v, FIELD_BITS * k).bitwiseAND(F.lit(_FIELD))  # noqa: E731, B023
            d = (2 * (cut(a) - cut(b) if b is not None else cut(a)) - n).cast("double")
            total = d * d if total is None else total + d * d
        return total

    lanes = F.transform(x, lambda a: fields(a, None)) if y is None else F.zip_with(x, y, fields)
    return F.aggregate(lanes, F.lit(0.0), lambda acc, v: acc + v)


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; 1 exactly if they are equal."""
    apart = _square(left["signs"], right["signs"], left["n"] - right["n"])
    norms = _square(left["signs"], None, left["n"]) + _square(right["signs"], None, right["n"])
    same = (left["n"] == right["n"]) & (left["words"] == right["words"])
    estimate = F.when(norms > 0, 1 - apart / norms).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999), estimate)))


def with_next(df: DataFrame, key: str, carry: list[str], buckets: int, tie: list[str] | None = None) -> DataFrame:
    """df with ``next_<c>`` for each column c of carry, from the next row by descending key (after the last: the first).

    Keys may be of any type that can be ordered. Rows with equal keys are ordered by a hash of the columns ``tie`` (else
    carry); rows without a key come last. If no row has a key, the last row has nulls. Rows are cut into ``buckets``
    ranges of (key, hash), so rows of one key are spread like any others. A cut is a row's own place, drawn from a
    sample that a hash decides (``DRAWN`` rows a range; it decides nothing but the ranges' sizes); that row, and the
    first of all, also go to the range where they follow the last row, so one shuffle does and no task has more than a range.
    """
    names = ["_has", "_key", "_hash"]  # of later rows all are less
    tied = F.bitwise_not(F.xxhash64(*[F.col(c) for c in tie or carry]))
    placed = df.withColumns({"_has": F.col(key).isNotNull(), "_key": F.col(key), "_hash": tied})
    places = cut(placed.select(*names))
    whole = places.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_has"), F.struct(*names))).alias("top")).first()
    share = min(1.0, DRAWN * buckets / max(1, whole["n"]))  # only so many rows are sent to the driver
    drawn = places.where(F.shiftrightunsigned(F.xxhash64(*names, F.lit("drawn")), 11) <= F.lit(int(share * (1 << 53)))).collect()
    ordered = sorted({tuple(r) for r in drawn}, key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
    bounds = sorted({i * len(ordered) // buckets for i in range(1, buckets)} - {0}) if ordered else []
    top, kind = whole["top"], df.schema[key].dataType
    place = lambda r: F.struct(F.lit(r[0]).alias("_has"), F.lit(r[1]).cast(kind).alias("_key"), F.lit(r[2]).cast("bigint").alias("_hash"))
    own_place, here, extra = F.struct(*names), F.col("_here"), F.struct(F.lit(-1).alias("bucket"), F.lit(0).alias("kind"))
    placed = placed.withColumn("_here", F.lit(0))
    if bounds:
        ends = F.array(*(place(ordered[i - 1]) for i in bounds))
        placed = placed.withColumn("_here", F.size(F.filter(ends, lambda b: b < own_place)))  # a column: it is asked for three times
        follows = F.coalesce(F.get(ends, here).eqNullSafe(own_place), F.lit(False))
        extra = F.when(follows, F.struct((here + 1).alias("bucket"), F.lit(1).alias("kind"))).otherwise(extra)
    if top is not None:
        extra = F.when(own_place.eqNullSafe(place(top)), F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("kind"))).otherwise(extra)
    own = F.struct(here.alias("bucket"), F.lit(0).alias("kind"))
    spread = placed.withColumn("_to", F.explode(F.filter(F.array(own, extra), lambda x: x["bucket"] >= 0)))
    spread = spread.withColumns({"_bucket": F.col("_to.bucket"), "_kind": F.col("_to.kind")})
    w = Window.partitionBy("_bucket").orderBy(F.col("_kind") == 2, *(F.col(c).desc_nulls_last() for c in names))
    out = spread.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
    return out.where(F.col("_kind") == 0).drop("_to", "_bucket", "_kind", "_here", *names)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text counts as empty and has no paragraphs; a row without an id is edited with the next of those, the last
    of them with the first id. Rows that repeat an id follow each other in the order of a hash of their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("hashes", paragraph_hashes(F.col("text"))).withColumn("fp", fingerprint(F.col("hashes"))).drop("hashes")
    # more ranges than partitions: those that fall together then make partitions of even sizes
    buckets = RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.expr("cast(floor(n_chars / 2) as int)")
    pairs = (
        with_next(docs, "doc_id", ["text", "fp"], buckets, ["text"])
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("half", half)
        .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - half)"), F.expr("substring(coalesce(next_text, ''), 1, half)")))
        .withColumn("edited_hashes", paragraph_hashes(F.col("edited")))
        .withColumn("edited_fp", fingerprint(F.col("edited_hashes")))
        .withColumn("other_fp", F.coalesce("next_fp", "fp"))
    )
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), encode(F.col("fp")).alias("fingerprint"), encode(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("other_fp")).alias("near_next"),
    )
