"""The corpus pipeline: quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor, and returns a DataFrame
that is written as Parquet in the shared folder and read again as the next one's docs. All but the
last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pipewright.llm._tables import drop_folder, ensure_checkpoint_dir
from pipewright.llm.near_dedup import near_dedup_stage
from pipewright.llm.packing import packing_stage
from pipewright.llm.quality import quality_stage
from pipewright.llm.suffix_dedup import dedup_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: No stage can be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what a stage returns is written under the checkpoint folder, and removed once the next one's is."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
