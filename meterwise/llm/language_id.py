"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of other than letters becomes one blank (JVM side).
The n-grams of one to three characters, blanks included, are hashed into ``BUCKETS``
buckets. Training counts the buckets per language over every training row (each task sums
its own rows first); the table of log probabilities, languages times buckets, is broadcast,
in blocks of ``LANGUAGES`` languages if there are more: each block is a pass over the texts
that carries the best language and the sum of all likelihoods so far. There is no class
prior: languages are equally likely before a text is read. Scoring adds up, per text, the
table's entries at the text's buckets: a sparse batch product in numpy, on runs of texts of
bounded size, so a text may be of any length.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0; so does every
text if there is nothing to learn from. Training rows with a null language or no letters
are left out. Ties go to the first language by code point. Repeated rows count each time
and get equal results. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meterwise.llm import words as W
from meterwise.llm.scratch import written

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of one broadcast table (0.13 MB each), and of what the driver holds at a time.
LANGUAGES = 512
UND = "und"


def letters(text: Column) -> Column:
    """The text's letters, lower-cased, each run of other characters one blank, a blank at
    either end; empty if there are none."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " "))
    return F.when(F.length(clean) > 0, F.concat(F.lit(" "), clean, F.lit(" "))).otherwise("")


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and where each text starts."""
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), lead[offs]


def bucket_ids(points: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each code point; ``BUCKETS`` where it would leave its text."""
    n = len(points)
    x = points.astype(np.uint32) * np.uint32(0x9E3779B1)
    for k in range(1, order):
        x[: n - k] ^= (points[k:].astype(np.uint32) + np.uint32(k)) * np.uint32((0x85EBCA6B, 0xC2B2AE35)[k - 1])
        x[: n - k] *= np.uint32(0x27D4EB2F)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D) + np.uint32(2 * order)
    out = (x >> np.uint32(17)).astype(np.int32)
    for k in range(1, order):
        at = offs[1:] - k
        out[at[at >= 0]] = BUCKETS
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): this task's n-grams by language."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, s in sums.items():
            at = np.flatnonzero(s[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        names = batch.column(1).to_pylist()
        for a, b, buf, offs in W.chunks(batch.column(0)):
            points, at = code_points(buf, offs)
            own = sorted(set(names[a:b]))
            which = np.searchsorted(own, names[a:b])
            owner = np.repeat(which, np.diff(at))
            for order in ORDERS:
                c = np.bincount(owner * (BUCKETS + 1) + bucket_ids(points, at, order), minlength=len(own) * (BUCKETS + 1)).reshape(len(own), -1)
                for k, lang in enumerate(own):
                    sums[lang] = sums[lang] + c[k] if lang in sums else c[k]
            if len(sums) > 64:
                yield from flush()
    yield from flush()


class Model:
    """Languages in code point order and their log probabilities by bucket (the last: 0)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)) if langs else np.zeros((0, BUCKETS))
        self.table = np.concatenate([p, np.zeros((len(langs), 1))], axis=1).astype(np.float32)

    def totals(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood of each text in each language, and whether the text has letters."""
        n = len(offs) - 1
        total = np.zeros((n, len(self.langs)))
        points, at = code_points(buf, offs)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            for order in ORDERS:
                ids = bucket_ids(points, at, order)
                for k in range(len(self.langs)):
                    total[full, k] += np.add.reduceat(self.table[k][ids], at[full], dtype=np.float64)
        some = np.zeros(n, bool)
        some[full] = True
        return total, some


class Languages:
    """What was learned: the counts, written, and the languages in blocks."""

    def __init__(self, counts: DataFrame, blocks: list[list[str]]):
        self.counts, self.blocks = counts, blocks

    def model(self, block: list[str]) -> Model:
        """The table of one block of languages."""
        found = self.counts.where(F.col("lang").between(block[0], block[-1])).toArrow()
        c = np.zeros((len(block), BUCKETS))
        c[np.searchsorted(block, found.column("lang").to_pylist()), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        return Model(block, c)


def train(docs: DataFrame) -> Languages:
    """Learns from all rows (text, lang) given."""
    rows = docs.select(letters(F.col("text")).alias("t"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND t <> ''")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-counts")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    return Languages(counts, [langs[k : k + LANGUAGES] for k in range(0, len(langs), LANGUAGES)])


def _pass(shared, text_at: int, first: bool, schema: pa.Schema):
    """One block's pass: rows with (lang, best, mass) after the other columns: the likeliest language
    so far, its log-likelihood, and the log of the sum of all likelihoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            keep = batch.num_columns - (0 if first else 3)
            for a, b, buf, offs in W.chunks(batch.column(text_at), 1 << 20):
                own = batch.slice(a, b - a)
                total, some = m.totals(buf, offs)
                top = total.argmax(1)
                best = total[np.arange(b - a), top]
                mass = best + np.log(np.exp(total - best[:, None]).sum(1))
                lang = [m.langs[k] if x else None for k, x in zip(top.tolist(), some.tolist(), strict=True)]
                if not first:
                    old = own.column(keep).to_pylist()
                    before, sums = (own.column(keep + k).to_numpy(zero_copy_only=False) for k in (1, 2))
                    stay = before >= best  # ties go to the first language
                    lang = [o if s else n for o, n, s in zip(old, lang, stay.tolist(), strict=True)]
                    best, mass = np.maximum(best, before), np.logaddexp(mass, sums)
                yield pa.RecordBatch.from_arrays([*own.columns[:keep], pa.array(lang, pa.string()), pa.array(best), pa.array(mass)], schema=schema)

    return run


def _judged(rows: DataFrame, model: Languages) -> DataFrame:
    """(row, lang (null: none), score) from (row, text)."""
    work = rows.select("row", letters(F.col("text")).alias("letters"))
    out = work.select("*", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("best"), F.lit(0.0).alias("mass")).schema
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.fields])
    for k, block in enumerate(model.blocks):
        shared = rows.sparkSession.sparkContext.broadcast(model.model(block))
        work = work.mapInArrow(_pass(shared, 1, k == 0, to_arrow_schema(out)), out)
        if k < len(model.blocks) - 1:  # so that the block can go before the next one is made
            work = written(work, "languages")
            shared.destroy()
    if not model.blocks:
        return work.select("row", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"))
    score = F.when(F.col("lang").isNotNull(), F.least(F.lit(1.0), F.exp(F.col("best") - F.col("mass")))).otherwise(0.0)
    return work.select("row", "lang", score.alias("score"))


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score per document."""
    return _judged(docs.select(F.struct("doc_id").alias("row"), "text"), model).select("row.doc_id", F.coalesce("lang", F.lit(UND)).alias("lang_pred"), "score")


def keep_identified(docs: DataFrame, model: Languages, min_score: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose language is found with ``min_score``.

    The score is a posterior over the whole text and not normalised by length: after a few words
    it is near 1 for any text, also in a language not learned or in gibberish. So in practice
    only texts without letters (and all, if nothing was learned) are dropped."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return _judged(rows, model).where(F.col("lang").isNotNull() & (F.col("score") >= min_score)).select("row.*")
