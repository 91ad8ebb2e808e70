"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of three families of terms: hashed words (A-Z lower-cased) and hashed
trigrams of character classes (each ASCII punctuation mark is a class of its own), both weighted
by the square root of their share and by inverse document frequency, which is counted over all
documents; and shares of word and line events (word repeated, word lengths, line repeated, line
lengths, size of the text). Each family has the length ``LENGTHS`` gives it.

A bounded sample of labelled documents, at most ``PER_CLASS`` of each label in order of a hash
of their ids, gives the latent space (the leading singular vectors of their centred vectors)
and, as points of it, the neighbours. Both are broadcast; their size is fixed by parameters.
Every document is projected and compared with every labelled point by blocked products. The
``NEIGHBOURS`` largest cosines vote, weighted by the cosine and by the inverse rate at which
their class was sampled, for the score: the weighted share of label 1.

Edge cases: null texts are empty; an empty text is a point like any other (its size is an
event). Without labelled documents every score is 0.5. Documents with several labels have the
rounded mean; null labels are left out. Repeated rows get equal scores; of rows with one id,
one is a labelled point. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm import words as W

PER_CLASS = 2048
SHAPES = 2048
WORDS = 1024
TERMS = SHAPES + WORDS
EVENTS = 64
#: Lengths of the families: words, shapes, events.
LENGTHS = (0.5, 1.0, 1.0)
RANK = 64
NEIGHBOURS = 32
BLOCK_BYTES = 1 << 20

_CLASS = np.arange(256, dtype=np.uint32) % 64 + 8  # marks; overwritten below
_CLASS[0x80:] = 5
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 2, 3, 4
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[0x0A] = False


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each of n texts has."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    return np.bincount((key[W.run_starts(key)] >> np.uint64(44)).astype(np.int64), minlength=n)


def raw_terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term counts, event shares) of texts, a row each."""
    n = len(offs) - 1
    terms = np.zeros((n, TERMS), np.float32)
    shapes = terms[:, WORDS:]
    if len(buf) > 2:
        c = _CLASS[buf]
        t = ((((c[:-2] << 7) | c[1:-1]) << 7 | c[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        ok = W.inside(offs, 3)
        owner = np.repeat(np.arange(n), np.diff(offs))[:-2]
        shapes[:] = np.bincount(owner[ok] * SHAPES + t[ok], minlength=n * SHAPES).reshape(n, SHAPES)
    events = np.zeros((n, EVENTS), np.float32)
    starts, ends, first = W.split_words(buf, offs, W.NON_SPACE)
    h = W.word_hashes(buf, starts, ends)
    size = np.diff(first)
    owner = np.repeat(np.arange(n), size)
    small = W.word_hashes(W.LOWER[buf], starts, ends) >> np.uint64(64 - WORDS.bit_length() + 1)
    terms[:, :WORDS] = np.bincount(owner * WORDS + small.astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    for gap, at in ((1, 0), (2, 2)):  # equal to the last word, to the one before
        if len(h) > gap:
            same = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
            events[:, at] = np.bincount(owner[gap:][same], minlength=n)
            events[:, at + 1] = size - events[:, at]
    events[:, 4] = _distinct(owner, h, n)
    events[:, 5] = size - events[:, 4]
    events[:, 6:22] = np.bincount(owner * 16 + np.minimum(ends - starts, 15), minlength=n * 16).reshape(n, 16)
    ls, le, lfirst = W.split_words(buf, offs, _NOT_BREAK)
    lines = np.diff(lfirst)
    lowner = np.repeat(np.arange(n), lines)
    events[:, 22:38] = np.bincount(lowner * 16 + np.minimum(np.log2(le - ls + 1).astype(np.int64), 15), minlength=n * 16).reshape(n, 16)
    events[:, 38] = _distinct(lowner, W.word_hashes(buf, ls, le), n)
    events[:, 39] = lines - events[:, 38]
    events[np.arange(n), 40 + np.minimum(np.log2(size + 1).astype(np.int64), 23)] = 1
    for a, b in ((0, 2), (2, 4), (4, 6), (6, 22), (22, 38), (38, 40), (40, 64)):
        events[:, a:b] /= np.maximum(events[:, a:b].sum(1, keepdims=True), 1)
    return terms, np.sqrt(events)


def vectors(buf: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    terms, events = raw_terms(buf, offs)
    families = [np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)) * w for x, w in ((terms[:, :WORDS], idf[:WORDS]), (terms[:, WORDS:], idf[WORDS:]))] + [events]
    for x, length in zip(families, LENGTHS, strict=True):
        x *= length / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.concatenate(families, axis=1, dtype=np.float32)


def leading(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of ``x`` (columns), by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, x.shape[1])))
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for a, b, buf, offs in W.chunks(batch.column(0), BLOCK_BYTES):
            df += (raw_terms(buf, offs)[0] > 0).sum(0)
            n += b - a
    yield pa.RecordBatch.from_arrays([pa.array(range(TERMS + 1), pa.int32()), pa.array(np.append(df, n))], names=["term", "n"])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    rows = docs.select("text").mapInArrow(_document_frequency, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1)
    for r in rows:
        df[r.term] = r.n
    return np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) + np.float32(0.1)


class Model:
    """Projection and labelled points; ``weight`` is what a neighbour's vote counts."""

    def __init__(self, idf: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray):
        self.idf, self.label, self.weight = idf, label.astype(np.float32), weight.astype(np.float32)
        self.mean = x.mean(0) if len(x) else np.zeros(TERMS + EVENTS, np.float32)
        x = x - self.mean
        self.basis = np.ascontiguousarray(leading(x.astype(np.float64), RANK)).astype(np.float32)
        self.points = self.project(x)

    def project(self, centred: np.ndarray) -> np.ndarray:
        p = centred @ self.basis
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if not len(self.points):
            return np.full(n, 0.5)
        cosine = self.project(vectors(buf, offs, self.idf) - self.mean) @ self.points.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) * self.weight[near]
        return np.clip((vote * self.label[near]).sum(1) / vote.sum(1), 0.0, 1.0).astype(np.float64)


def labelled_sample(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label) of at most ``per_class`` documents a label; documents per sampled one."""
    own = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(F.col(column))).cast("int").alias("label"))
    counts = {r.label: r.n for r in own.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1]), {k: n / min(n, per_class) for k, n in counts.items()}


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", *, per_class: int = PER_CLASS) -> Model:
    """Learns from the labels given; frequencies come from all documents given."""
    idf = inverse_frequency(docs)
    sample, rate = labelled_sample(labels, column, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in W.chunks(batch.column(2), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([v.tobytes() for v in vectors(buf, offs, idf)], pa.binary())], names=["doc_id", "label", "vector"])

    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    one = one.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted(one.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, vector binary").collect(), key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.vector, np.float32) for r in rows], np.float32).reshape(len(rows), TERMS + EVENTS)
    label = np.array([r.label for r in rows], np.int64)
    return Model(idf, x, label, np.array([rate[k] for k in label.tolist()]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in W.chunks(batch.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(buf, offs))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
