"""Sharding by weighted rendezvous hashing of record keys.

Each shard draws, for every key, an exponential waiting time from a hash of (key, shard), divided by
the shard's weight; the shard with the shortest wait has the key. A new shard therefore takes keys
only into itself, and with weight w of total W it takes w / W of them. The law is ``key``: the key and
the list of shards decide, nothing else.

Slots number the rows of a shard without gaps. They follow the order of the MD5 of the key and the
columns ``order_by``, and the first hex digits of that digest cut a shard into buckets, so the
numbering needs counts per (shard, bucket), a running sum over those few counts, and a row number
within each bucket: no task sees a whole shard, nor all rows of a hot key that differ in ``order_by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.llm._tables import table

HASH_HEX = 13  # 52 bits of MD5, exact in a double


def waiting_time(key: Column, shard: int, weight: float) -> Column:
    """Exponential with rate ``weight``, from the hash of (key, shard)."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("bigint").cast("double")
    return -F.log((draw + F.lit(0.5)) / F.lit(float(16**HASH_HEX))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, of len(weights), with the shortest waiting time; ties go to the smaller number."""
    waits = [F.struct(waiting_time(key, s, w).alias("wait"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*waits))["shard"]


def shard_rows(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, order_by: Sequence[str] = (), bucket_hex: int = 3) -> DataFrame:
    """df with columns shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard).

    A null key counts as the empty string, so all null keys share a shard; rows with equal keys share
    one as well. Rows that are equal in the key and the columns ``order_by`` get their slots in any
    order. An empty table gives an empty result. Columns of df with the names
    that are added are replaced.
    """
    if not weights or min(weights) <= 0 or grown_weight <= 0:
        raise ValueError("weights must be positive")
    df = df.drop("shard", "slot", "grown_shard")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = df.withColumns({
        "shard": rendezvous(text, weights), "grown_shard": rendezvous(text, [*weights, grown_weight]), "_digest": F.md5(F.concat_ws("|", text, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order_by)).cast("binary")),
    }).withColumn("_bucket", F.substring("_digest", 1, bucket_hex))
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_digest", *order_by)
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(starts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("bigint"))
        .drop("_digest", "_bucket", "_start", "_place")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``. A null text has size 1 and no text_crc32; a null doc_id counts as the empty string."""
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    placed = shard_rows(docs, order_by=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The CRC is taken byte by byte over a table of 256 remainders.
OP2_SQL = """
WITH bits AS (SELECT unnest(range(256)) AS n),
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t FROM bits),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, text, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size FROM documents),
summed AS (
  SELECT docs.* EXCLUDE (text), CAST(CASE WHEN text IS NOT NULL THEN xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) END AS BIGINT) AS text_crc32
  FROM docs, crc_table),
waits AS (
  SELECT r, s, -ln((CAST(CAST('0x' || substring(md5(k || ':' || s), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) AS wait
  FROM summed, (SELECT unnest(range(17)) AS s)),
placed AS (
  SELECT r, CAST(arg_min(s, wait) FILTER (WHERE s < 16) AS INTEGER) AS shard, CAST(arg_min(s, wait) AS INTEGER) AS grown_shard FROM waits GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(CAST(text_crc32 AS VARCHAR), '') || '|' || size), doc_id, text_crc32, size) - 1 AS slot,
  grown_shard
FROM summed JOIN placed USING (r)
"""
