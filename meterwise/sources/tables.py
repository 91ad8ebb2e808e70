"""Reading the input tables.

The driver's Parquet files store zone-less timestamps; the domain model uses
``timestamp`` in a UTC session, so every timestamp column is cast once here.
Reads are lazy: column pruning and filter pushdown reach the Parquet scan
through whatever the caller selects later (in a UTC session Catalyst unwraps
the cast, so time bounds still become ``PushedFilters``).

A table is ``<name>.parquet`` and whatever files ``<name>_*.parquet`` have landed
beside it by the time it is read; streams take the same files, so a resumed
stream and the tables it is joined to agree.

A table's schema is inferred once per session and path and then passed to every
later read: schema inference reads Parquet footers in a Spark job, which over many
files costs a job per read for nothing.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meterwise.session import ensure_checkpoint_dir

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_SCHEMAS: dict[tuple[str, str], T.StructType] = {}
_LOCK = threading.Lock()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table_glob(sf_dir: str, name: str) -> str:
    """The table and the files that landed beside it."""
    return f"{sf_dir.rstrip('/')}/{{{name},{name}_*}}.parquet"


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """The file schema of ``path``, inferred on first use in a session (Spark application)."""
    key = (spark.sparkContext.applicationId, path)
    with _LOCK:
        s = _SCHEMAS.get(key)
    if s is None:
        s = spark.read.parquet(path).schema
        with _LOCK:
            _SCHEMAS[key] = s
    return s


def utc_projection(schema: T.StructType) -> list[str]:
    """Column list (SQL text) casting zone-less timestamps to ``timestamp``; one projection,
    built without a round trip per column."""
    return [f"CAST(`{f.name}` AS TIMESTAMP) AS `{f.name}`" if isinstance(f.dataType, T.TimestampNTZType) else f"`{f.name}`"
            for f in schema.fields]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table_schema(spark, table_path(sf_dir, name))
    return spark.read.schema(schema).parquet(table_glob(sf_dir, name)).selectExpr(*utc_projection(schema))


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: for what several
    branches of a plan would otherwise compute again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
