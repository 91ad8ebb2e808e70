"""Tables that a stream keeps up: current rows by key, and partial sums in levels.

Both live in a job's folder under ``spark.checkpoint.dir``. A micro-batch writes new folders named
by its id and then one manifest, a small JSON file, that says which folders now hold the table; so
readers see the table before or after a batch, never half of it, and a batch that is run
again (a lost executor or driver) starts from the manifest before it and writes the same folders.
Folders that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a keyed table; for a large one choose so many that a bucket is a task's work.
BUCKETS = 32
#: Folders of a level that are merged into one of the next.
FANOUT = 4


class Manifest:
    """Numbered JSON files in a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark.sparkContext._jvm, folder
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def latest(self) -> int:
        """The last batch with a manifest, -1 without any."""
        p = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(p):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def read(self, batch: int) -> dict:
        if batch < 0:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/manifest/{batch}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, batch: int, content: dict) -> None:
        """The file is complete once it has its name."""
        tmp, to = self._path(f"{self.folder}/manifest/{batch}.tmp"), self._path(f"{self.folder}/manifest/{batch}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        self._fs.delete(to, False)
        if not self._fs.rename(tmp, to):
            raise RuntimeError(f"could not write {to}")

    def remove(self, folders: list[str]) -> None:
        for f in folders:
            self._fs.delete(self._path(f"{self.folder}/{f}"), True)


class KeyedTable:
    """The current row of every key, in hash buckets. A micro-batch reads and rewrites only the
    buckets that its keys fall into; a read opens one version of each bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets
        self._manifest = Manifest(spark, folder)

    def _rows(self, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._rows(self._manifest.read(self._manifest.latest()))

    def merge(self, rows: DataFrame, batch: int, reduce: Callable[[DataFrame], DataFrame]) -> None:
        """Brings the rows of micro-batch ``batch`` in: ``reduce`` makes one row a key of old and new
        ones (any grouping by the keys)."""
        old = self._manifest.read(batch - 1)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).alias("_bucket")
        rows = rows.select(*self.schema.names).persist()
        try:
            touched = sorted(str(r[0]) for r in rows.select(bucket).distinct().collect())  # at most ``buckets`` numbers
            if touched:
                current = self._rows({b: v for b, v in old.items() if b in touched})
                merged = reduce(current.unionByName(rows)).select(*self.schema.names, bucket).repartition(len(touched), "_bucket")
                merged.withColumnRenamed("_bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={batch}")
        finally:
            rows.unpersist()
        new = old | dict.fromkeys(touched, batch)
        self._manifest.write(batch, new)
        stale = set(self._manifest.read(batch - 2).items()) - set(old.items()) - set(new.items()) if batch > 1 else set()
        self._manifest.remove([f"v={v}/bucket={b}" for b, v in stale])


class LeveledSums:
    """Sums by key as partial rows in levels: a micro-batch adds its own sums at level 0, and
    ``FANOUT`` folders of a level become one of the next. So a key has at most FANOUT - 1 rows a level,
    and as many levels as the logarithm of the number of batches; a row is rewritten once a level."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], fanout: int = FANOUT):
        self.spark, self.folder, self.schema, self.keys, self.fanout = spark, folder, schema, keys, fanout
        self.sums = [c for c in schema.names if c not in keys]
        self._manifest = Manifest(spark, folder)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).cast("long").alias(c) for c in self.sums])

    def partial_rows(self) -> DataFrame:
        """The partial sums as they lie."""
        folders = [f for level in self._manifest.read(self._manifest.latest()).values() for f in level]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._summed(self.partial_rows())

    def add(self, rows: DataFrame, batch: int) -> None:
        """Adds the sums of micro-batch ``batch``."""
        levels = {int(k): list(v) for k, v in self._manifest.read(batch - 1).items()}
        self._summed(rows).write.mode("overwrite").parquet(f"{self.folder}/level=0-{batch}")
        levels.setdefault(0, []).append(f"level=0-{batch}")
        gone, k = [], 0
        while len(levels.get(k, [])) >= self.fanout:
            merged = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in levels[k]])
            self._summed(merged).write.mode("overwrite").parquet(f"{self.folder}/level={k + 1}-{batch}")
            levels.setdefault(k + 1, []).append(f"level={k + 1}-{batch}")
            gone, levels[k], k = gone + levels[k], [], k + 1
        before = self._manifest.read(batch - 1)
        self._manifest.write(batch, {str(k): v for k, v in levels.items()})
        if batch > 1:  # what the manifest before the last named and the last two do not
            kept = {f for m in (before, levels) for v in m.values() for f in v}
            self._manifest.remove([f for v in self._manifest.read(batch - 2).values() for f in v if f not in kept])
