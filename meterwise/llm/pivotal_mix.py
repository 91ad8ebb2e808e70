"""Mixing sources to target weights by pivotal dependent rounding.

A source's words are to be taken ``target / size`` times. Every document of it gets the whole
part of that ratio as copies for sure and the rest as a probability of one more. Pivotal
steps settle the probabilities: two documents with fractional probabilities transfer mass
(words times probability) in a random direction until one of them is 0 or 1, so that each
keeps its expectation and the sum of the words expected does not change. One document at
most stays fractional.

Large sources are cut into buckets of about ``BUCKET`` documents by a hash. Each bucket
settles its own documents and leaves one residual; the residuals of ``FAN`` buckets are
settled in a group, which leaves one, and so on up the tree until a source has one, which is
rounded: the source is then off its target by half of that document at most. A second pass over the buckets repeats their steps (all draws are hashes
of the documents) with the residual's outcome known. So no task holds a source, and rows
travel once.

Edge cases: null sources are one source, the last by order; null texts have size 0. Documents
of size 0 are never taken. Repeated rows are separate units; which of equal rows is taken is
not told apart. Empty tables give empty results. Other columns pass through ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterwise.llm import words as W
from meterwise.llm.scratch import written

BUCKET = 4_000
FAN = 1_000
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
_MASK = (1 << 64) - 1


def with_sizes(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, ``_text_hash`` and ``_size``: the words (runs of other than ASCII white space) of text."""
    columns = [*columns, "_text_hash"]
    work = docs.withColumn("_text_hash", F.xxhash64("text")).select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_t"))
    out = work.select(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("long").alias("_size")).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for _, _, buf, offs in W.chunks(batch.column(len(columns))):
                sizes.append(np.diff(W.split_words(buf, offs, W.NON_SPACE)[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sizes), pa.int64())], schema=arrow)

    return work.mapInArrow(run, out)


def targets(sized: DataFrame) -> DataFrame:
    """Per source: _source, _rank, _source_size, _docs, _target.

    Weights repeat in the order of sources (code points, null last). A level L gives each
    source ``L * weight`` words, but no more than ``MAX_REPEAT`` times its size; in order of
    ``MAX_REPEAT * size / weight`` the sources that stop come first, so L follows from sums
    over the sources before each. One row per source is sorted here, never documents.
    """
    totals = sized.groupBy(F.col("source").alias("_source")).agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_docs"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("_rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    t = totals.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", weight).withColumn("_cap", F.col("_source_size") * F.lit(float(MAX_REPEAT)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("_source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("_level", left / F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("_stops", F.col("_level") > F.col("_cap") / F.col("_w"))
    level = F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everything)
    # the last source never stops but by rounding: the level then does not matter
    return t.withColumn("_target", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))).select("_source", "_rank", "_source_size", "_docs", "_target")


def _draw(a: int, b: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 30)) * 0x94D049BB133111EB) & _MASK
    x = ((x ^ (x >> 27)) * 0xD6E8FEB86659FD93) & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(one: tuple[float, float], two: tuple[float, float], draw: float) -> tuple[float, float]:
    """The new probabilities of two units (words, probability), one of them 0 or 1."""
    (a, p), (b, q) = one, two
    up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
    if draw * (up + down) < down:  # mass from two to one, so that expectations stay
        if a * (1 - p) <= b * q:
            return 1.0, min(1.0, max(0.0, q - up / b)) if a * (1 - p) < b * q else 0.0
        return min(1.0, p + up / a), 0.0
    if a * p <= b * (1 - q):
        return 0.0, min(1.0, q + down / b) if a * p < b * (1 - q) else 1.0
    return max(0.0, p - down / a), 1.0


class _Group:
    """The units of one bucket so far: at most one is fractional."""

    def __init__(self) -> None:
        self.open: tuple[int, int, float, float] | None = None  # row, hash, words, probability

    def add(self, row: int, h: int, words: float, p: float, settled) -> None:
        """Adds a unit; ``settled(row, 0 or 1)`` is called for each that becomes integral."""
        if p <= 0.0 or p >= 1.0:
            settled(row, int(p >= 1.0))
            return
        if self.open is None:
            self.open = (row, h, words, p)
            return
        r, g, w, q = self.open
        q, p = pivot((w, q), (words, p), _draw(g, h))
        self.open = None
        for unit in ((r, g, w, q), (row, h, words, p)):
            if 0.0 < unit[3] < 1.0:
                self.open = unit
            else:
                settled(unit[0], int(unit[3] >= 1.0))


def _residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rank, bucket, h, words, p, unit) in order of (rank, bucket): the unit of each
    bucket that stays fractional, with unit, h, words and its probability."""
    last, group = None, _Group()

    def row() -> pa.RecordBatch:
        unit, h, words, p = group.open
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((last[0], pa.int32()), (last[1], pa.int64()), (h, pa.int64()), (words, pa.float64()), (p, pa.float64()), (unit, pa.int64()))], names=["rank", "bucket", "h", "words", "p", "unit"])

    for batch in batches:
        for rank, bucket, h, words, p, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (rank, bucket) != last:
                if group.open:
                    yield row()
                last, group = (rank, bucket), _Group()
            group.add(unit, h, words, p, lambda *_: None)
    if group.open:
        yield row()


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of groups that become integral: (rank, unit, extra)."""
    last, group = None, _Group()
    for batch in batches:
        done: list[tuple[int, int, int]] = []
        for rank, bucket, h, words, p, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (rank, bucket) != last:
                last, group = (rank, bucket), _Group()
            group.add(unit, h, words, p, lambda u, x, r=rank: done.append((r, u, x)))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32()))], names=["rank", "unit", "extra"])


_UNIT = "rank int, bucket bigint, h bigint, words double, p double, unit bigint"


def _in_order(df: DataFrame, size: str) -> DataFrame:
    """Large units first: one that is still open then meets enough small ones to settle."""
    return df.repartition("rank", "bucket").sortWithinPartitions("rank", "bucket", F.desc(size), "h", "unit" if "unit" in df.columns else "rank")


def _settle_tree(units: DataFrame, buckets: int) -> DataFrame:
    """The outcome (rank, unit, extra) of every bucket's residual; its unit is its bucket."""
    done = None
    while True:
        buckets = -(-buckets // FAN)
        grouped = _in_order(units.withColumn("bucket", F.floor(F.col("bucket") / FAN)).select("rank", "bucket", "h", "words", "p", "unit"), "words")
        part = grouped.mapInArrow(_outcomes, "rank int, unit bigint, extra int")
        done = part if done is None else done.union(part)
        units = written(grouped.mapInArrow(_residuals, _UNIT), "residuals")
        if buckets <= 1:
            return done.union(units.select("rank", "unit", (F.col("p") >= 0.5).cast("int").alias("extra")))


def _copies(n_keep: int, arrow: pa.Schema):
    """Rows (kept columns, rank, bucket, h, size, ratio, the outcome of the bucket's residual)
    in order of their buckets: the kept columns and copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_outcome, group = None, 0, _Group()
        held: tuple[pa.RecordBatch, int] | None = None  # the open unit's row, if from an earlier batch

        for batch in batches:
            keep = batch.select(range(n_keep))
            copies = np.zeros(batch.num_rows, np.int64)
            late: list[pa.RecordBatch] = []

            def settled(row: int, extra: int) -> None:
                if row < 0:
                    late.append(pa.RecordBatch.from_arrays([*held[0].columns, pa.array([held[1] + extra], pa.int64())], schema=arrow))
                else:
                    copies[row] += extra

            cols = (batch.column(n_keep + k).to_pylist() for k in range(6))
            for k, (rank, bucket, h, size, ratio, outcome) in enumerate(zip(*cols, strict=True)):
                if (rank, bucket) != last:
                    if group.open is not None:
                        settled(group.open[0], last_outcome)
                    last, last_outcome, group = (rank, bucket), outcome or 0, _Group()
                if size:
                    copies[k] = int(ratio)
                    group.add(k, h, float(size), ratio - int(ratio), settled)
            ready = np.ones(batch.num_rows, bool)
            if group.open is not None and group.open[0] >= 0:
                k = group.open[0]
                ready[k] = False
                held = (keep.slice(k, 1), int(copies[k]))
                group.open = (-1, *group.open[1:])
            yield from late
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(copies)], schema=arrow).filter(pa.array(ready))
        if group.open is not None:
            yield pa.RecordBatch.from_arrays([*held[0].columns, pa.array([held[1] + last_outcome], pa.int64())], schema=arrow)

    return run


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds _rank, _bucket, _h, _ratio, _source_size and _target to sized rows."""
    own = sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "_size", "_text_hash"))
    buckets = F.ceil(F.col("_docs") / F.lit(BUCKET))
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    return own.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", F.pmod(F.col("_h"), buckets)).withColumn("_ratio", ratio)


def _taken(docs: DataFrame, rows: DataFrame | None, seed: int) -> DataFrame:
    """Rows (row, size, source_size, target, copies); ``rows`` has doc_id, source, row, text."""
    narrow = written(with_sizes(docs, ["doc_id", "source"]), "sizes")
    sources = written(targets(narrow), "sources")
    units = _placed(narrow.where("_size > 0"), sources, seed).select(
        F.col("_rank").alias("rank"), F.col("_bucket").alias("bucket"), F.col("_h").alias("h"), F.col("_size").cast("double").alias("words"),
        (F.col("_ratio") - F.floor("_ratio")).alias("p"), F.col("_bucket").alias("unit"))
    residuals = written(_in_order(units, "words").mapInArrow(_residuals, _UNIT), "residuals")
    most = sources.agg(F.max(F.ceil(F.col("_docs") / F.lit(BUCKET)))).first()[0] or 1
    outcomes = written(_settle_tree(residuals, most), "outcomes")
    sized = narrow.withColumn("row", F.struct("doc_id")) if rows is None else with_sizes(rows, ["doc_id", "source", "row"])
    placed = _placed(sized, sources, seed).select(
        "row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_rank").alias("rank"), F.col("_bucket").alias("bucket"), F.col("_h").alias("h"), F.col("_size").alias("_s"), F.col("_ratio").alias("ratio"))
    known = placed.join(outcomes.select("rank", F.col("unit").alias("bucket"), "extra"), ["rank", "bucket"], "left")
    known = known.select("row", "size", "source_size", "target", "rank", "bucket", "h", "_s", "ratio", "extra")
    schema = known.select("row", "size", "source_size", "target", F.lit(0).cast("long").alias("copies")).schema
    return _in_order(known, "_s").mapInArrow(_copies(4, to_arrow_schema(schema)), schema)


def taken(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), copies, taken."""
    return _taken(docs, None, seed).select("row.doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, all its columns as they are."""
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return _taken(docs, rows, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
