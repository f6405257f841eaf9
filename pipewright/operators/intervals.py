"""Sweeps over intervals on a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-4
MOST_LEVELS = 64  # values of a tariff, each of which is a column


def priced_pieces(lines: DataFrame, events: DataFrame, key: str, length: str = "length", default: float = 1.0) -> DataFrame:
    """key, from, to, k: lines(key, length) cut at all ends of events(key, from, to, k), each piece with the
    greatest k of the events that cover it (default: none). Slivers up to EPS go; pieces stay apart.

    k comes from a tariff, so it has few values: for each of them a running sum over the cuts of a line
    counts the events that are open. One sort by line does it; no event meets another."""
    clipped = events.join(lines.select(key, length), key).select(
        key, F.greatest(F.lit(0.0), F.least("from", "to")).alias("from"), F.least(F.col(length), F.greatest("from", "to")).alias("to"), "k"
    ).where(F.col("from") < F.col("to"))
    levels = [r["k"] for r in events.select("k").where(F.col("k") > default).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} values of k: a tariff has few")
    begin, end = F.struct(F.col("from").alias("at"), F.lit(1).alias("step")), F.struct(F.col("to").alias("at"), F.lit(-1).alias("step"))
    ends = clipped.select(key, "k", F.explode(F.array(begin, end)).alias("e")).select(key, "k", "e.at", "e.step")
    whole = lines.select(key, F.explode(F.array(F.lit(0.0), F.col(length))).alias("at")).select(key, F.lit(None).cast("double").alias("k"), "at", F.lit(0).alias("step"))
    open_ = [f"_open{i}" for i in range(len(levels))]
    changes = ends.unionByName(whole).groupBy(key, "at").agg(*(F.sum(F.when(F.col("k") == v, F.col("step")).otherwise(0)).alias(c) for v, c in zip(levels, open_, strict=True)))
    w = Window.partitionBy(key).orderBy("at")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = changes.select(key, "at", F.lead("at").over(w).alias("to"), *(F.sum(c).over(until).alias(c) for c in open_))
    k = F.greatest(F.lit(default), F.lit(default), *(F.when(F.col(c) > 0, v) for v, c in zip(levels, open_, strict=True)))
    return counted.where(F.col("to") - F.col("at") > EPS).select(key, F.col("at").alias("from"), "to", k.alias("k"))


def islands(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """df with ``island``: the number, from 0 in each key, of the run of equal values that a row is in."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    return df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(new)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
