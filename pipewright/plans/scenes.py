"""Metric scenes derived from the driver's tables by integer arithmetic, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.session import table

HARD = ["oks", "park", "social_area", "prohibited_site", "water", "railway"]
SPECIAL = ["road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network"]
KINDS = HARD + SPECIAL


def _sql_case(key: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: name: (table, filter, {column: expression in both dialects})
SCENES: dict[str, tuple[str, str, dict[str, str]]] = {
    "consumer": ("customer", "true", {
        "ckey": "c_custkey", "x": "CAST(c_custkey * 7919 % 4000 AS DOUBLE)", "y": "CAST(c_custkey * 104729 % 4000 AS DOUBLE)",
        "flow": "1 + CAST(c_custkey * 31 % 400 AS DOUBLE) / CAST(10 AS DOUBLE)",
        "lon": "37 + CAST(c_custkey * 7919 % 20000 AS DOUBLE) / CAST(10000 AS DOUBLE)", "lat": "55 + CAST(c_custkey * 104729 % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE)"}),
    "pipe": ("supplier", "true", {
        "pkey": "s_suppkey", "x1": "CAST(s_suppkey * 6007 % 4000 AS DOUBLE)", "y1": "CAST(s_suppkey * 15013 % 4000 AS DOUBLE)",
        "x2": "CAST(s_suppkey * 6007 % 4000 + 50 + s_suppkey * 13 % 100 AS DOUBLE)", "y2": "CAST(s_suppkey * 15013 % 4000 + s_suppkey * 17 % 60 - 30 AS DOUBLE)",
        "dn_idx": "CAST(3 + s_suppkey % 10 AS INT)"}),
    "chamber": ("supplier", "s_suppkey % 3 = 0", {
        "hkey": "s_suppkey", "hx": "CAST(s_suppkey * 6007 % 4000 + s_suppkey % 15 AS DOUBLE)", "hy": "CAST(s_suppkey * 15013 % 4000 AS DOUBLE)"}),
    "dense": ("supplier", "true", {  # a town quarter for each 200 keys
        "pkey": "s_suppkey", "x1": "CAST(s_suppkey * 6007 % 400 + 1000 * CAST(floor(s_suppkey / 200) AS BIGINT) AS DOUBLE)", "y1": "CAST(s_suppkey * 15013 % 400 AS DOUBLE)",
        "x2": "CAST(s_suppkey * 6007 % 400 + 1000 * CAST(floor(s_suppkey / 200) AS BIGINT) + 50 + s_suppkey * 13 % 100 AS DOUBLE)", "y2": "CAST(s_suppkey * 15013 % 400 + s_suppkey * 17 % 160 - 80 AS DOUBLE)"}),
    "lattice": ("supplier", "true", {  # a lattice for each 100 keys
        "pkey": "s_suppkey", "x1": "CAST(50 * (s_suppkey % 10) + 1000 * CAST(floor(s_suppkey / 100) AS BIGINT) AS DOUBLE)", "y1": "CAST(50 * (CAST(floor(s_suppkey / 10) AS BIGINT) % 10) AS DOUBLE)",
        "x2": "CAST(50 * (s_suppkey % 10) + 1000 * CAST(floor(s_suppkey / 100) AS BIGINT) + CASE WHEN s_suppkey % 2 = 0 THEN 100 ELSE 0 END AS DOUBLE)",
        "y2": "CAST(50 * (CAST(floor(s_suppkey / 10) AS BIGINT) % 10) + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 100 END AS DOUBLE)",
        "dn_idx": "CAST(3 + s_suppkey % 10 AS INT)"}),
    "box": ("part", "true", {
        "bkey": "p_partkey", "x1": "CAST(p_partkey * 6007 % 4000 AS DOUBLE)", "y1": "CAST(p_partkey * 15013 % 4000 AS DOUBLE)",
        "x2": "CAST(p_partkey * 6007 % 4000 + 10 + p_partkey % 30 AS DOUBLE)", "y2": "CAST(p_partkey * 15013 % 4000 + 10 + p_partkey % 20 AS DOUBLE)",
        "kind": _sql_case("p_partkey", KINDS)}),
    "route": ("orders", "true", {
        "okey": "o_orderkey", "ckey": "o_custkey", "x0": "CAST(o_custkey * 7919 % 4000 AS DOUBLE)", "y0": "CAST(o_custkey * 104729 % 4000 AS DOUBLE)",
        "x1": "CAST(o_custkey * 7919 % 4000 + 20 + o_orderkey % 50 AS DOUBLE)", "y1": "CAST(o_custkey * 104729 % 4000 + o_orderkey % 30 AS DOUBLE)",
        "x2": "CAST(o_custkey * 7919 % 4000 + 20 + o_orderkey % 50 + o_orderkey % 40 - 20 AS DOUBLE)",
        "y2": "CAST(o_custkey * 104729 % 4000 + o_orderkey % 30 + 30 AS DOUBLE)", "dn_idx": "CAST(o_orderkey % 18 AS INT)"}),
    "event": ("events", "true", {
        "ukey": "user_id", "ekey": "event_id", "from_m": "CAST(event_id % 100 AS DOUBLE)", "to_m": "CAST(event_id % 100 + 1 + event_id % 20 AS DOUBLE)",
        "kind": _sql_case("event_id", SPECIAL)}),
}


def scene(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, condition, columns = SCENES[name]
    return table(spark, sf_dir, source).where(condition).select(*[F.expr(e).alias(c) for c, e in columns.items()])


def sql(*names: str) -> str:
    """WITH RECURSIVE and the scenes as common table expressions, ready for more to follow."""
    parts = []
    for name in names:
        source, condition, columns = SCENES[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})")
    return "WITH RECURSIVE " + ",\n".join(parts)


def heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on customer keys: 8 to 15 are roots, k hangs below k // 2; node, up, length, flow of leaves. Keys 1 to 7 are above the roots and in no tree."""
    c = scene(spark, sf_dir, "consumer").where("ckey >= 8")
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("top")).first()["top"]
    edges = c.where("ckey >= 16")
    return edges.select(
        F.col("ckey").alias("node"), F.expr("ckey div 2").alias("up"), F.expr("CAST(10 + ckey * 13 % 150 AS DOUBLE)").alias("length"),
        F.when(F.col("ckey") * 2 > F.lit(top), F.col("flow")).otherwise(0.0).alias("leaf_flow"),
    )


HEAP_SQL = """,
heap AS (
  SELECT c_custkey AS node, c_custkey // 2 AS up, CAST(10 + c_custkey * 13 % 150 AS DOUBLE) AS length,
    CASE WHEN c_custkey * 2 > (SELECT max(c_custkey) FROM customer) THEN 1 + CAST(c_custkey * 31 % 400 AS DOUBLE) / CAST(10 AS DOUBLE) ELSE 0 END AS leaf_flow
  FROM customer WHERE c_custkey >= 16),
clo(node, up) AS (SELECT node, node FROM heap UNION ALL SELECT c.node, h.up FROM clo c JOIN heap h ON c.up = h.node WHERE h.up >= 16),
flows AS (SELECT c.up AS node, sum(h.leaf_flow) AS flow FROM clo c JOIN heap h ON h.node = c.node GROUP BY 1)"""
