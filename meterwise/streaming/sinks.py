"""Stream plumbing: file-stream sources over the driver's tables, idempotent
``foreachBatch`` sinks in the shared checkpoint folder, and read-back of the
final state. A job with a ``run`` name keeps its folder (checkpoint and output)
from one start to the next and goes on where it stopped.

Every sink writes one directory per micro-batch id with ``overwrite``, so a
batch replayed after an executor or driver loss rewrites the same files:
exactly-once output on top of the source offsets kept in the checkpoint.
Nothing is collected to the driver.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from meterwise.session import ensure_checkpoint_dir
from meterwise.sources.tables import table_glob, table_path, table_schema, utc_projection


def stream_dir(spark: SparkSession, name: str, run: str | None = None) -> str:
    """The folder of one streaming job under ``spark.checkpoint.dir``: the same one for every
    start of the run of that name, a fresh one without a name."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{run or uuid.uuid4().hex[:12]}"


def read_stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream over a table and the files that land beside it later (the same files that a
    batch read takes), with the zone-less timestamps cast once, as in batch reads."""
    schema = table_schema(spark, table_path(folder, name))
    return spark.readStream.schema(schema).parquet(table_glob(folder, name)).selectExpr(*utc_projection(schema))


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append", batch_fn=None, run: str | None = None) -> str:
    """Run ``stream`` over everything available now into ``<dir>/data/_batch=<id>``; returns
    the job's folder. ``batch_fn(df, batch_id, dir)`` replaces the default writer."""
    spark = stream.sparkSession
    d = stream_dir(spark, name, run)

    def write(bdf: DataFrame, bid: int) -> None:
        if batch_fn is not None:
            batch_fn(bdf, bid, d)
        else:
            bdf.write.mode("overwrite").parquet(f"{d}/data/_batch={bid}")

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(write)
         .option("checkpointLocation", f"{d}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return d


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows a sink wrote (with ``_batch``), or an empty frame when nothing was written."""
    rows = read_if_written(spark, path)
    if rows is None:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("_batch", T.IntegerType())]))
    return rows


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet rows under ``path``, or None when no batch has made that folder yet; any
    other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@contextmanager
def state_store(spark: SparkSession):
    """The state store that jobs with state of several kinds and timers need (it keeps the state
    on the executors' disks and its changes in the checkpoint)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old)
