"""Global order without one task, and joins on keys of which a few may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import written


def hot_join(big: DataFrame, info: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``big`` joined to ``info`` (at most one row per key) without moving the rows of the keys in
    ``hot``: their few rows of ``info`` are broadcast, all others meet by a shuffle. The caller
    proves the bound of ``hot``."""
    hot = hot.select(*on).distinct()
    few = F.broadcast(info.join(F.broadcast(hot), on, "left_semi"))
    held = big.join(F.broadcast(hot), on, "left_semi").join(few, on, how)
    rest = big.join(F.broadcast(hot), on, "left_anti").join(info, on, how)
    return held.unionByName(rest)


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """``df`` with its row number (from 1) in the given order. Tasks sort ranges of the order;
    a range starts where the sizes of the ranges before it end, and only those sizes (a number
    per range) reach the driver. ``df`` is read twice (its ranges are sampled first)."""
    part, nth = f"{rank}_part", f"{rank}_nth"
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = cut.withColumn(nth, F.monotonically_increasing_id()).select("*", F.spark_partition_id().alias(part))
    cut = written(cut, name)
    sizes = sorted((r[part], r["count"]) for r in cut.groupBy(part).count().collect())
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {rank}_before long")
    local = F.col(nth).bitwiseAND((1 << 33) - 1) + 1
    return cut.join(F.broadcast(offsets), part).withColumn(rank, F.col(f"{rank}_before") + local).select(*df.columns, rank)
