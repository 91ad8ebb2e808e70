"""Language-model scores: stupid backoff over words, leaving the scored document out.

The score of a word is ``c(gram) / c(context)`` for the longest gram of up to ``order`` words
that ends with it and occurs in another document, where the context is the gram without the
word and counts are over all documents but the scored one. Every step to a shorter gram costs
``ALPHA``; a single word scores its share ``c(word) / N``, or ``ALPHA / N`` if it occurs nowhere
else. At the start of a text the longest gram is what the text has. A document's score is the
sum of the logarithms; n_backoff counts the words that took at least one step.

Words (A-Z lower-cased, between ASCII white space) and grams are compared by 64-bit hashes, and
no table of them is held as a whole: the counts of all orders are partitioned by hash.

The orders are counted one after the other, because a gram of k words can occur elsewhere only if
the two grams of k - 1 words in it do: all others are dropped before they are moved.

1. Documents are written once as runs of up to ``RUN_BYTES`` of text, compressed, in a table bucketed
   by the task that wrote them, so that joins to it never move the texts again.
2. Every run lists its distinct grams of an order that may occur elsewhere, sorted by hash and cut
   by ranges of it into ``partitions``, each piece packed and compressed. So a gram, however
   frequent, is one entry per run.
3. A partition gets its pieces from all runs, sums the counts of each gram and sends every piece what
   other runs have of its grams, in the piece's order; a gram that no other run has costs
   next to nothing on the way back (a run of zeros).
4. The totals, one row a run, are joined to the runs, which go on to the next order, and at
   last take the own document's counts off and score.

Edge cases: null texts and texts without words have no words and score null; a gram that only
one document has always backs off; repeated rows are documents of their own and count each
other. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm import words as W
from meterwise.llm.scratch import new_folder, written

#: Words of the longest gram of the registered query.
ORDER = 3
ALPHA = 0.4
#: Entries of a partition of the count table, at most about so many.
PARTITION_PAIRS = 2 << 20
RUN_BYTES = 6 << 20
#: Runs of a bucket of the table of texts: what one task reads and scores.
BUCKET_RUNS = 4


def word_ids(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of each text, end to end, and where each text's begin."""
    low = W.LOWER[buf]
    starts, ends, first = W.split_words(low, offs, W.NON_SPACE)
    return W.word_hashes(low, starts, ends), first


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as compressed byte planes."""
    raw = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").ravel() for c in raw]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, run, ids, sizes, data, n_words): a run's documents and their texts."""
    task = TaskContext.get().partitionId()
    number = task << 32
    for ids, col in _gathered(batches, RUN_BYTES):
        for a, b, buf, offs in W.chunks(col, RUN_BYTES):
            _, _, first = W.split_words(buf, offs, W.NON_SPACE)
            own = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([number], pa.int64()), own, pa.array([_pack(np.diff(offs))], pa.binary()),
                                              pa.array([zstandard.compress(buf.tobytes(), 3)], pa.binary()), pa.array([int(first[-1])], pa.int64())],
                                             names=["task", "run", "ids", "sizes", "data", "n_words"])
            number += 1


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Columns (ids, texts) of batches put together up to ``limit`` bytes, or one batch."""
    parts, size = [], 0
    for batch in batches:
        if parts and size + batch.nbytes > limit:
            yield tuple(pa.concat_arrays([p.column(k) for p in parts]) for k in (0, 1))
            parts, size = [], 0
        parts.append(batch)
        size += batch.nbytes
    if parts:
        yield tuple(pa.concat_arrays([p.column(k) for p in parts]) for k in (0, 1))


def _words(sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    offs = np.concatenate([[0], np.cumsum(_unpack(sizes, 1)[0].astype(np.int64))])
    return word_ids(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), offs)


class Run:
    """The grams of a run's documents, order by order."""

    def __init__(self, sizes: bytes, data: bytes):
        self.ids, self.first = _words(sizes, data)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        #: For each order, how often other documents have the gram that begins at each word.
        self.found: list[np.ndarray] = []

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the next order's grams that other documents may have."""
        k = len(self.found) + 1
        if k == 1:
            return np.arange(len(self.ids)), self.ids
        at = np.flatnonzero(W.inside(self.first, k))
        shorter = self.found[-1] > 0
        at = at[shorter[at] & shorter[at + 1]]
        return at, W.ngram_hashes(self.ids, k)[at] if len(at) else np.zeros(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes among the candidates and how often the run has each."""
        grams = np.sort(self.candidates()[1])
        at = W.run_starts(grams)
        return grams[at], np.diff(np.append(at, len(grams)))

    def learn(self, others: np.ndarray) -> None:
        """Takes what other runs have of the ``distinct`` grams: the order is known then."""
        at, grams = self.candidates()
        found = np.zeros(len(self.ids), np.int64)
        if len(at):
            found[at] = _elsewhere(grams, self.doc[at], others)
        self.found.append(found)


def _row_by_row(batch: pa.RecordBatch) -> Iterator[list]:
    """A batch's rows, one in memory at a time beside it."""
    for k in range(batch.num_rows):
        yield [c[k].as_py() for c in batch.columns]


def _run_of(sizes: bytes, data: bytes, totals: list[bytes | None]) -> Run:
    run = Run(sizes, data)
    for t in totals:
        run.learn(np.concatenate([_unpack(x, 1)[0] for x in t]).astype(np.int64) if t else np.zeros(0, np.int64))
    return run


def _pieces(partitions: int):
    """Rows (part, task, run, data): a run's distinct grams of the next order and their counts, by
    ranges of the hash. From rows (task, run, sizes, data, totals of the orders before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([-(-(k << 64) // partitions) for k in range(1, partitions)], np.uint64)
        for batch in batches:
            for task, number, sizes, data, *totals in _row_by_row(batch):
                grams, count = _run_of(sizes, data, totals).distinct()
                cut = [0, *np.searchsorted(grams, bounds), len(grams)]
                have = [k for k in range(partitions) if cut[k] < cut[k + 1]]
                packed = [_pack(np.diff(grams[cut[k] : cut[k + 1]], prepend=np.uint64(0)), count[cut[k] : cut[k + 1]]) for k in have]
                yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([task] * len(have), pa.int32()), pa.array([number] * len(have), pa.int64()), pa.array(packed, pa.binary())],
                                                 names=["part", "task", "run", "data"])

    return run


def _totals(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each entry the count of its gram over all entries."""
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    at = W.run_starts(gram)
    out = np.empty(len(gram), np.int64)
    out[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), at), np.diff(np.append(at, len(gram))))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, run, part, data) from rows (part, task, run, data) in order: per gram of the piece
    what other runs have of it."""
    last, tasks, runs, pieces = None, [], [], []

    def close() -> pa.RecordBatch:
        each = [_unpack(x, 2) for x in pieces]
        count = np.concatenate([c for _, c in each]).astype(np.int64)
        others = _totals(np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in each]), count) - count
        cut = np.cumsum([0, *(len(c) for _, c in each)])
        data = [_pack(others[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(runs, pa.int64()), pa.array([last] * len(runs), pa.int32()), pa.array(data, pa.binary())],
                                          names=["task", "run", "part", "data"])

    for batch in batches:
        for part, task, number, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last and runs:
                yield close()
                tasks, runs, pieces = [], [], []
            last = part
            tasks.append(task)
            runs.append(number)
            pieces.append(piece)
    if runs:
        yield close()


def _elsewhere(grams: np.ndarray, doc: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each gram how often other documents have it; ``others``: other runs, by distinct gram.
    ``doc`` grows among equal grams."""
    by = np.argsort(grams, kind="stable")
    g, d = grams[by], doc[by]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(new)
    # the run's own count and the others', then the own document's off
    total = np.repeat(others + np.diff(np.append(at, len(g))), np.diff(np.append(at, len(g))))
    new[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(new)
    own = np.diff(np.append(at, len(g)))
    out = np.empty(len(g), np.int64)
    out[by] = total - np.repeat(own, own)
    return out


def _scores(run: Run, total: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(backoffs, score) of each document of a run that knows all orders."""
    counts = run.found
    score = np.log(np.where(counts[0] > 0, counts[0], ALPHA) / total)
    back = np.zeros(len(run.ids), bool)
    for k in range(2, order + 1):
        own = np.flatnonzero(W.inside(run.first, k))
        word, seen = own + k - 1, counts[k - 1][own] > 0
        score[word] += np.log(ALPHA)
        score[word[seen]] = np.log(counts[k - 1][own[seen]] / counts[k - 2][own[seen]])
        back[word] = ~seen
    n = len(run.n)
    return np.bincount(run.doc, back, minlength=n).astype(np.int64), np.bincount(run.doc, score, minlength=n)


def _score(total: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (task, run, sizes, data, totals by order ..., ids)."""
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            for k, (_, _, sizes, data, *totals) in enumerate(_row_by_row(batch.select(range(batch.num_columns - 1)))):
                own = _run_of(sizes, data, totals)
                back, score = _scores(own, total, order) if len(own.ids) else (own.n, np.zeros(len(own.n)))
                yield pa.RecordBatch.from_arrays([ids.slice(k, 1).flatten(), pa.array(own.n, pa.int64()), pa.array(back, pa.int64()), pa.array(np.where(own.n > 0, score, np.nan), from_pandas=True)],
                                                 names=["doc_id", "n_words", "n_backoff", "log_score"])

    return run


def score(docs: DataFrame, *, order: int = 2, partition_pairs: int = PARTITION_PAIRS) -> DataFrame:
    """Per document: doc_id, n_words, n_backoff, log_score (null without words), mean_log_score."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = docs.select("doc_id", "text").mapInArrow(_runs, f"task int, run bigint, ids array<{kind}>, sizes binary, data binary, n_words bigint")
    # as many buckets as the texts' size calls for, known before they are written
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (RUN_BYTES * BUCKET_RUNS)))
    name = f"llm_runs_{uuid.uuid4().hex}"
    listed.write.bucketBy(buckets, "task").option("path", new_folder(spark, "runs")).saveAsTable(name)
    runs = spark.table(name)
    total = runs.agg(F.sum("n_words")).first()[0] or 0
    partitions = max(1, -(-total // partition_pairs))
    known = runs.select("task", "run", "sizes", "data", "ids")
    for k in range(1, order + 1):
        pieces = known.drop("ids").mapInArrow(_pieces(partitions), "part int, task int, run bigint, data binary")
        counted = pieces.repartition("part").sortWithinPartitions("part", "run").mapInArrow(_count, "task int, run bigint, part int, data binary")
        whole = counted.groupBy("task", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "data"))), lambda x: x["data"]).alias(f"totals{k}"))
        whole = written(whole, f"totals{k}").select(F.col("task").alias(f"task{k}"), F.col("run").alias(f"run{k}"), f"totals{k}")
        # the buckets meet on the task alone; the run is compared within
        same = (F.col("task") == F.col(f"task{k}")) & ((F.col("run") - F.col(f"run{k}")) == 0)
        known = known.join(whole.hint("shuffle_hash"), same, "left").drop(f"task{k}", f"run{k}")
    columns = ["task", "run", "sizes", "data", *[f"totals{k}" for k in range(1, order + 1)], "ids"]
    out = known.select(*columns).mapInArrow(_score(total, order), f"doc_id {kind}, n_words bigint, n_backoff bigint, log_score double")
    return out.select("doc_id", "n_words", "n_backoff", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
