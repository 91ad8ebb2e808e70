"""Intermediate tables: written as Parquet to the cluster's shared folder and read back, so
that nothing is computed twice and a lost executor costs no more than the step it was in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meterwise.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
