"""Reading the input tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; where none is configured, one in the warehouse, unless that is local to a machine of a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        folder = given or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        if not given and not sc.master.startswith("local[") and folder.startswith(("file:", "/")):
            raise ValueError(f"{folder} is a folder of this machine alone: set spark.checkpoint.dir to one that all executors share")
        sc.setCheckpointDir(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ours from the file system that it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
