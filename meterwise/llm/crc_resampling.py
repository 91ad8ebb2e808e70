"""Importance resampling towards a target: which documents look like the benchmark texts.

Features are all runs of 1 to ``MAX_WORDS`` consecutive words (A-Z lower-cased, ASCII letters and
digits and everything beyond ASCII), joined by one blank, repeats counted; a feature falls into the
bucket crc32(its UTF-8 bytes) modulo ``BUCKETS``. From the counts of the documents and of the
target a bucket gets a gain (the floored log ratio of smoothed shares), a document the sum of the
gains of its features plus Gumbel noise from a hash of its id, and the documents with the highest
sums are drawn: a sample without replacement by importance weight, the same on every run.

The crc32 of a batch's features are computed in matrices. The batch is written again with single
blanks, so that every feature is a slice of it; equal features are told by their 64-bit hash and
one of each is kept; those of one length form a two-dimensional uint8 array, whose checksums are
updated column by column; the results are scattered back to all features. Lengths with fewer than
``FEW`` features, such as those of a very long word, take zlib's function, which gives the same.

The texts are read twice (counts, then weights). Between the passes only ``BUCKETS`` sums reach the
driver and one gain for each goes out. Ranks come from ranges of the scores sorted in tasks.

Edge cases: null, empty and wordless texts have no features and weight 0; a null doc_id is hashed as
empty text and loses ties; ties beyond doc_id go by number of features, then are between equal rows; repeated rows are
documents of their own; empty tables give no rows, and without a target all of its counts are 0;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm import words as W
from meterwise.llm.scratch import written
from meterwise.llm.skew import ranked

MAX_WORDS = 3
BUCKETS = 10_000
#: Documents of fewer words are not drawn; percent of the others that are.
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Lengths of fewer distinct features in a batch are not worth a matrix.
FEW = 16
#: Bytes of a matrix at a time.
MATRIX_BYTES = 4 << 20


def _crc_table() -> np.ndarray:
    """The reflected table of the polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc32_slices(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc32 of ``buf[start : start + length]`` for each slice, by matrices of equal length."""
    out = np.empty(len(start), np.uint32)
    by = np.argsort(length, kind="stable")
    at = W.run_starts(length[by])
    for a, b in zip(at, np.append(at[1:], len(by)), strict=True):
        n, own = int(length[by[a]]), by[a:b]
        if len(own) < FEW:
            data = memoryview(buf)
            out[own] = [zlib.crc32(data[s : s + n]) for s in start[own].tolist()]
            continue
        step = max(1, MATRIX_BYTES // max(n, 1))
        for i in range(0, len(own), step):
            rows = own[i : i + step]
            matrix = buf[start[rows][None, :] + np.arange(n)[:, None]]  # column by column: transposed
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _single_spaced(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each begins."""
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return out, begin


def features(buf: np.ndarray, offs: np.ndarray, buckets: int, max_words: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, its bucket)."""
    low = W.LOWER[buf]
    starts, ends, first = W.split_words(low, offs, W.ALNUM)
    n = np.diff(first)
    if not len(starts):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = W.word_hashes(low, starts, ends)
    text, begin = _single_spaced(low, starts, ends)
    end = begin + ends - starts
    doc = np.repeat(np.arange(len(n)), n)
    hashes, at, size, of = [], [], [], []
    for k in range(1, max_words + 1):
        own = np.flatnonzero(W.inside(first, k))
        hashes.append(W.ngram_hashes(ids, k)[own])
        at.append(begin[own])
        size.append(end[own + k - 1] - begin[own])
        of.append(doc[own])
    hashes, at, size = np.concatenate(hashes), np.concatenate(at), np.concatenate(size)
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    return n, np.concatenate(of), (crc32_slices(text, at[one], size[one]) % buckets).astype(np.int64)[back]


def _count(buckets: int):
    """A task's sums: rows (bucket, n) of the buckets it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offs in W.chunks(batch.column(0)):
                sums += np.bincount(features(buf, offs, buckets)[2], minlength=buckets)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: at most ``buckets`` rows to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), in doubles, for each bucket."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _noise(doc_id: object, seed: int) -> int:
    """Gumbel noise in thousandths from the document's id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in W.chunks(batch.column(1)):
                n, doc, bucket = features(buf, offs, len(gain))
                each = np.bincount(doc, minlength=len(n)).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(gain[bucket[np.argsort(doc, kind="stable")]])])
                weight = np.diff(total[np.concatenate([[0], np.cumsum(each)])])
                ids = batch.column(0).slice(a, b - a)
                noise = np.array([_noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(each), pa.array(weight), pa.array(weight + noise)],
                                                 names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_weigh(gain, seed), f"doc_id {kind}, n_words long, n_features long, weight long, score long")
    scored = written(scored, "scores")
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    order = ranked(enough, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")], "rank", "ranked")
    out = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
