"""Merkle manifest of a dataset: a leaf for each record, trees by group, proofs, and their check.

A leaf is the digest of a record's fields. The leaves of a group stand in the order of a key; as long
as a group has several nodes, every ``FANOUT`` consecutive ones become the digest of their texts. The
roots of the groups, in the order of the groups, make one more tree of the same kind.

A level is one window: nodes are partitioned by group and parent index, and the list of the full
frame in order gives each node its run, which is both the parent's preimage and the node's siblings.
The first node of a run carries the parent on, so that parents come once. Runs have at most ``FANOUT``
nodes, so no task holds more of a group than that.

Proofs go the other way: a node's way to the root is its own siblings and its parent's way, so ways
are handed down by an equi-join of each level's nodes with the level above, at most ``FANOUT`` rows to
a key, however large a group is. Digests travel as hex texts; a way has one entry a level.

Scale: records are read once and only their ids and digests are shuffled. Places in a group are
counted over sorted ranges of (group, key): rows of a range, then sums over ranges, so a group that
holds most of the rows is dealt over all ranges, and so are rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.llm._tables import cut, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def record_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields: `-` for null, else the number of its UTF-8 bytes, `:` and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return digest(F.concat(*parts))


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df with ``i`` (place in its group from 0, by the columns ``order``) and ``n`` (rows of the group).

    df should be a written table: its rows are read twice, for the ranges and for themselves. Rows
    that are equal in ``order`` get their places in any order."""
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # rows of one key are dealt over ranges, too
    ranged = cut(tied.repartitionByRange(width, group, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("n"))
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_tie")
    placed = ranged.withColumn("_place", F.row_number().over(inside) - 1)
    joined = placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & (placed["_range"] == starts["_r"]))
    return joined.withColumn("i", F.col("_start") + F.col("_place")).drop("_tie", "_range", "_g", "_r", "_start", "_place")


def tree(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of nodes(g, i, n, node); levels: those with several nodes to a group, (g, i, n, node, left, right, parent)
    each, left and right being the texts of the siblings on that side; roots: (g, node). g may not be null."""
    levels: list[DataFrame] = []
    roots = nodes.where("n = 1").select("g", "node")
    here = nodes.where("n > 1")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        run = Window.partitionBy("g", F.floor(F.col("i") / fanout)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        listed = here.withColumn("run", F.collect_list("node").over(run)).withColumn("at", (F.col("i") % fanout).cast("int"))
        level = cut(
            listed.select(
                "g", "i", "n", "node", F.array_join(F.slice("run", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("run", F.col("at") + 2, F.lit(fanout)), "").alias("right"),
                digest(F.array_join("run", "")).alias("parent"),
            )
        )
        levels.append(level)
        up = level.where(F.col("i") % fanout == 0)  # one node of each run: its parent comes once
        up = up.select("g", F.floor(F.col("i") / fanout).alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("node"))
        roots = roots.unionByName(up.where("n = 1").select("g", "node"))
        here = up.where("n > 1")
        largest = -(-largest // fanout)
    return levels, roots


def ways(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(g, i, way, carried columns) of each leaf: the siblings on its way to the root, from the leaf up, and then tops' own way.

    tops: (g, way, more columns), one row a group, the way above the group's root."""
    carried = [c for c in tops.columns if c not in ("g", "way")]
    above = tops.withColumn("i", F.lit(0).cast("long"))
    for level in reversed(levels):
        # a group whose root is lower than this level isn't in it, and waits as it is
        below = level.select("g", F.col("i").alias("below"), F.struct("left", "right").alias("step"), F.floor(F.col("i") / fanout).alias("i"))
        joined = above.join(below, ["g", "i"], "left")
        way = F.when(F.col("step").isNull(), F.col("way")).otherwise(F.concat(F.array("step"), F.col("way")))
        above = joined.select("g", F.coalesce("below", "i").alias("i"), way.alias("way"), *carried)
    return above


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf gives with the siblings of its way."""
    return F.aggregate(way, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


NO_WAY = "cast(array() as array<struct<left string, right string>>)"


def build_manifest(records: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """records with ``subroot`` (of its group), ``root`` (of all groups) and ``way`` (array<struct<left, right>>: what stands
    left and right of the node of each level, from the leaf up to the root).

    records has its leaf digests in column ``leaf``; groups and keys are ordered by Spark's order of
    their types, nulls first (texts: by UTF-8 bytes). Rows with equal keys are ordered by their leaves,
    so equal records change places without any effect. A null group is a group of its own. A group of
    one record has its leaf as subroot, a single group its subroot as root, and a way can be empty. An
    empty table gives an empty result. Columns of records with the new names are replaced.
    """
    kept = records.drop("subroot", "root", "way")
    names = kept.columns
    given = [F.col(c).alias(f"c{k}") for k, c in enumerate(names)]  # names of their own inside
    by = {c: f"c{k}" for k, c in enumerate(names)}
    source = cut(kept.select(*given))
    # groups as numbers, in order: nulls first
    groups = numbered(source.select(F.col(by[group]).alias("name")).distinct().withColumn("all", F.lit(0)), "all", ["name"])
    groups = cut(groups.select("name", F.col("i").alias("g"), F.col("n").alias("groups")))
    placed = numbered(source, by[group], [*(by[c] for c in order), by[leaf]])
    leaves = cut(placed.join(groups, placed[by[group]].eqNullSafe(groups["name"])).drop("name", "groups"))
    levels, subroots = tree(leaves.select("g", "i", "n", F.col(by[leaf]).alias("node")), fanout)
    over = subroots.join(groups.select("g", F.col("groups").alias("n")), "g")
    top_levels, top = tree(over.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "n", "node"), fanout)
    above = ways(top_levels, top.select("g", F.expr(NO_WAY).alias("way"), F.col("node").alias("root")), fanout)
    tops = subroots.join(above.select(F.col("i").alias("g"), "way", "root"), "g").select("g", "way", F.col("node").alias("subroot"), "root")
    down = ways(levels, tops, fanout)
    out = leaves.join(down, ["g", "i"])
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "subroot", "root", "way")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all documents, a tree for each lang, and every third document checked after tampering.

    Nulls in any field are `-`; a null doc_id comes first in its lang and counts as the empty text for the choice of
    documents that are tampered with. Rows that repeat a doc_id follow in the order of their leaves; equal rows
    give equal leaves, each with a proof of its own. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    fields = {c: F.col(c) for c in FIELDS}
    leaves = docs.select("doc_id", "lang", record_digest(list(fields.values())).alias("leaf"), F.when(chosen, record_digest(list((fields | {"text": lowered}).values()))).alias("tampered"))
    out = build_manifest(leaves, "lang", ["doc_id"])
    root = folded(F.coalesce("tampered", "leaf"), F.col("way"))
    proof = digest(F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), ""))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL_LEVELS = 8  # enough for 8**8 records to a lang


def _sql_tree(name: str, source: str, group: str) -> str:
    """CTEs {name}0 (nodes) to {name}{SQL_LEVELS}: of each node its run, siblings and parent; a group with one node stays as it is."""
    steps = [f"{name}0 AS ({source})"]
    for k in range(SQL_LEVELS):
        steps.append(
            f"{name}r{k} AS (SELECT {group} AS g, i // 8 AS p, max(n) AS n, sha256(string_agg(node, '' ORDER BY i)) AS parent, any_value(node) AS single, list(node ORDER BY i) AS run FROM {name}{k} GROUP BY 1, 2)"
        )
        steps.append(f"{name}{k + 1} AS (SELECT g, p AS i, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n, CASE WHEN n > 1 THEN parent ELSE single END AS node FROM {name}r{k})")
    return ",\n".join(steps)


def _sql_siblings(name: str, place: str, group: str) -> tuple[str, str]:
    """(joins, texts of the siblings) of a row with its place in the tree."""
    joins, siblings = [], []
    for k in range(SQL_LEVELS):
        own, at = f"{name}_{k}", f"({place} // {8**k}) % 8"
        joins.append(f"JOIN {name}r{k} {own} ON {own}.g IS NOT DISTINCT FROM {group} AND {own}.p = {place} // {8 ** (k + 1)}")
        siblings.append(f"CASE WHEN {own}.n > 1 THEN array_to_string({own}.run[1:{at}], '') || array_to_string({own}.run[{at} + 2:], '') ELSE '' END")
    return "\n".join(joins), " || ".join(siblings)


def _sql() -> str:
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = [field(c) for c in FIELDS[:-1]]
    group_joins, group_siblings = _sql_siblings("a", "l.i", "l.lang")
    top_joins, top_siblings = _sql_siblings("b", "l.gi", "0")
    folds, before = ["start AS (SELECT *, used AS h FROM placed)"], "start"  # a step for each level, so that expressions stay short
    for tag, place, group in (("a", "l.i", "l.lang"), ("b", "l.gi", "0")):
        for k in range(SQL_LEVELS):
            at, name = f"({place} // {8**k}) % 8", f"fold_{tag}{k}"
            folded_node = f"CASE WHEN r.n > 1 THEN sha256(array_to_string(r.run[1:{at}], '') || l.h || array_to_string(r.run[{at} + 2:], '')) ELSE l.h END AS h"
            folds.append(f"{name} AS (SELECT l.* EXCLUDE (h), {folded_node} FROM {before} l JOIN {tag}r{k} r ON r.g IS NOT DISTINCT FROM {group} AND r.p = {place} // {8 ** (k + 1)})")
            before = name
    steps = ",\n".join(folds)
    return f"""
WITH bits AS (SELECT unnest(range(256)) AS n),
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t FROM bits),
docs AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k, sha256({" || ".join([*head, field("text")])}) AS leaf, sha256({" || ".join([*head, field(low)])}) AS low FROM documents),
summed AS (
  SELECT docs.*, CASE WHEN k = '' THEN 0 ELSE xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda p: CAST('0x' || p AS BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) END AS crc
  FROM docs, crc_table),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gi, count(*) OVER () AS gn FROM (SELECT DISTINCT lang FROM documents)),
placed AS (
  SELECT s.doc_id, s.lang, s.leaf, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS used, gi, gn,
    row_number() OVER (PARTITION BY s.lang ORDER BY s.doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s.lang) AS n
  FROM summed s JOIN langs ON langs.lang IS NOT DISTINCT FROM s.lang),
{_sql_tree("a", "SELECT lang AS g, i, n, leaf AS node FROM placed", "g")},
{_sql_tree("b", f"SELECT 0 AS g, gi AS i, gn AS n, node FROM a{SQL_LEVELS} JOIN langs ON langs.lang IS NOT DISTINCT FROM g", "g")},
{steps}
SELECT l.doc_id, l.leaf, a{SQL_LEVELS}.node AS subroot, b{SQL_LEVELS}.node AS root, sha256({group_siblings} || {top_siblings}) AS proof_sha256, l.h AS folded_root, l.h = b{SQL_LEVELS}.node AS verified
FROM {before} l
JOIN a{SQL_LEVELS} ON a{SQL_LEVELS}.g IS NOT DISTINCT FROM l.lang
JOIN b{SQL_LEVELS} ON true
{group_joins}
{top_joins}
"""


OP12_SQL = _sql()
