"""Session helpers: shared checkpoint folder, lineage cuts, reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PORTION = 50_000  # rows of a partition


def portions(*tables: DataFrame) -> int:
    """How many partitions rows have to be dealt in that are about as many as those of the largest table; 0: as Spark does.

    Spark merges what it shuffles until about one partition a core is left, so what a task sorts grows with the tables; it
    leaves partitions of a set number. Fewer than spark.sql.shuffle.partitions would not be kept by joins."""
    spark = tables[0].sparkSession
    most = max(t.count() for t in tables)
    return 0 if most <= PORTION * spark.sparkContext.defaultParallelism else portions_for(spark, most)


def portions_for(spark: SparkSession, rows: int) -> int:
    """How many partitions so many rows have to be dealt in, if Spark isn't to merge them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PORTION))


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df dealt by keys in ``parts`` partitions (0: as it is)."""
    return df.repartition(parts, *keys) if parts else df


def joined(left: DataFrame, right: DataFrame, keys: list[str], parts: int, how: str = "inner") -> DataFrame:
    """left joined with right on keys, both dealt in ``parts`` partitions (0: as Spark does).

    Dealt sides are merged: Spark takes the size of what was made of a small file for small, and would send it to all through the driver."""
    right = spread(right, parts, *keys)
    return spread(left, parts, *keys).join(right.hint("merge") if parts else right, keys, how)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder (by default one in the warehouse) and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        folder = conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        if not conf.get("spark.checkpoint.dir", None) and not sc.master.startswith("local[") and folder.startswith(("file:", "/")):
            raise ValueError(f"{folder} is a folder of this machine alone: set spark.checkpoint.dir to one that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
