"""Numbers in order within groups of any size: no task sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.session import cut


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """df with ``name``: 1, 2 ... within its group, by the columns ``order``; rows that are equal in them come in any order.

    Rows are dealt by range of (group, order), so that a group which holds most of them is spread over all ranges. A
    number is a row's place in its range and the rows of its group in the ranges before; counts of ranges are few."""
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    source = df.withColumns({**keys, "_tie": F.monotonically_increasing_id()})
    sort = [F.col(k) for k in keys]
    # ranges are drawn from a sample: what they are is written once, and not drawn again if a task is lost
    ranged = cut(cut(source).repartitionByRange(width, *groups, *sort, "_tie").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*groups, "_range").orderBy(*sort, "_tie")
    placed = ranged.withColumn("_place", F.row_number().over(inside))
    same = placed["_range"] == starts["_range"]
    for g in groups:
        same &= placed[g].eqNullSafe(starts[g])
    joined = placed.join(starts, same).withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint"))
    return joined.select(*[placed[c] for c in df.columns if c != name], name)
