"""Benchmark decontamination by suffix arrays over the training text.

The documents are cut into shards (runs of rows of an Arrow batch); each shard gets a suffix
array over its words, in which every suffix of every benchmark item is found by binary
search. That gives all places where a suffix's window occurs; places that follow each other
in both item and document are joined into the longest verbatim matches, and their words are
the document words inside occurrences of a window.

Words are runs of ASCII letters and digits and all characters beyond ASCII, after A-Z is
lower-cased. A window is ``window`` consecutive words of an item; an item of fewer words
(but not none) is one window.

Nothing is shuffled: a shard is built, searched and forgotten within its task, so a lost
executor only repeats its own shards. The items are broadcast in blocks of about
``BLOCK_BYTES`` of text, of which the driver and the tasks hold one at a time; more blocks mean more
passes over the shards, each written with what was hit so far, before the next block is made.

Edge cases: a null or empty text, and a text without words, has no words and no hits. Null
or wordless items match nothing. Repeated items count once; an item with a null id hits
words but is not listed. Equal documents, and repeated rows, each get their own row. Any
other columns of the documents, whatever their names, pass through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm import words as W
from meterwise.llm.scratch import written

WINDOW = 13
#: Text of benchmark items in one broadcast.
BLOCK_BYTES = 16 << 20
#: Words of a shard (a longer document is a shard of its own).
SHARD_BYTES = 5 << 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])
MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


class SuffixArray:
    """The suffixes of word codes (0 ends a text) in order of their first ``words`` codes at least."""

    def __init__(self, hashes: np.ndarray, words: int = 16):
        n = len(hashes)
        self.bits = max(1, int(n).bit_length())
        self.code_bits = min(24, (64 - self.bits) // 2)
        self.full = np.concatenate([hashes, np.zeros(max(words, 2), np.uint64)])
        self.codes = self.encode(self.full)
        code = self.codes
        idx = np.arange(n, dtype=np.uint64)
        b = np.uint64(self.bits)
        key = (code[:n] << np.uint64(self.code_bits)) | code[1 : n + 1]
        packed = np.sort((key << b) | idx)
        self.sa = (packed & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        key = packed >> b
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.zeros(n + 1, np.int64)
        depth = 2
        while depth < words and n:
            group = np.cumsum(new)
            rank[self.sa] = group
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            pos = self.sa[at]
            order = _sort_two(group[at], rank[np.minimum(pos + depth, n)])
            self.sa[at] = pos[order]
            g, r = group[at], rank[np.minimum(self.sa[at] + depth, n)]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
            new[at] = fresh
            depth *= 2

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        code = hashes >> np.uint64(64 - self.code_bits)
        code[(code == 0) & (hashes != 0)] = 1
        return code

    def search(self, query: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of code rows (all of one width): the first suffix whose beginning is
        not before (``right``: is after) the row."""
        lo = np.zeros(len(query), np.int64)
        hi = np.full(len(query), len(self.sa), np.int64)
        span = np.arange(query.shape[1])
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            have, want = self.codes[self.sa[mid][:, None] + span], query[open_]
            diff = have != want
            at = diff.argmax(1)
            rows = np.arange(len(open_))
            less = have[rows, at] < want[rows, at]
            down = less | (~diff.any(1) if right else False)
            lo[open_[down]] = mid[down] + 1
            hi[open_[~down]] = mid[~down]


def _sort_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order by (a, b)."""
    n = len(a)
    bits = max(1, n.bit_length())
    wide = max(1, int(b.max()).bit_length())
    if int(a.max()).bit_length() + wide + bits <= 64:
        key = (a.astype(np.uint64) << np.uint64(wide)) | b.astype(np.uint64)
        packed = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.lexsort((b, a))


class Items:
    """One block of benchmark items: their words' hashes, and every suffix as a query row."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        buf, offs = W.text_bytes(pa.array(texts, pa.string()))
        buf = W.LOWER[buf]
        starts, ends, first = W.split_words(buf, offs, W.ALNUM)
        h = W.word_hashes(buf, starts, ends)
        self.ids, self.window = ids, window
        self.hashes = np.concatenate([h, np.zeros(window, np.uint64)])
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(h)) - first[:-1][self.item] if len(h) else np.zeros(0, np.int64)
        left = n[self.item] - self.at if len(h) else np.zeros(0, np.int64)
        self.pos = np.arange(len(h))
        self.length = np.minimum(left, window)
        # a suffix stands for a window if it has a window's words, or is a whole shorter item
        self.whole = (left >= window) | ((self.at == 0) & (n[self.item] < window)) if len(h) else np.zeros(0, bool)


def find(sa: SuffixArray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(suffix, shard word, words matched) for each length: the verified places where a
    suffix's first window (or whole short item) occurs."""
    for length in np.unique(items.length):
        q = np.flatnonzero((items.length == length) & (items.whole))
        if not len(q):
            continue
        span = np.arange(length)
        for a in range(0, len(q), 1 << 16):
            s = q[a : a + (1 << 16)]
            rows = items.hashes[items.pos[s][:, None] + span]
            query = sa.encode(rows.ravel().copy()).reshape(rows.shape)
            two = min(2, int(length))
            lo = sa.search(query[:, :two], False)
            hi = sa.search(query[:, :two], True)
            some = np.flatnonzero(lo < hi)
            if not len(some):
                continue
            lo, hi = sa.search(query[some], False), sa.search(query[some], True)
            n = hi - lo
            which = np.repeat(some, n)
            if not len(which):
                continue
            place = sa.sa[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            same = (sa.full[place[:, None] + span] == rows[which]).all(1)
            yield s[which[same]], place[same], np.full(int(same.sum()), length)


def shard_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a shard's words, a 0 after each text; the first word of each text."""
    low = W.LOWER[buf]
    starts, ends, first = W.split_words(low, offs, W.ALNUM)
    h = W.word_hashes(low, starts, ends)
    n = len(offs) - 1
    out = np.zeros(len(h) + n, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(h)) + doc] = h
    return out, first + np.arange(n + 1)


def _mark(hashes: np.ndarray, first: np.ndarray, items: Items, mask: np.ndarray, listed: list[set], matches: bool) -> list[list[tuple]]:
    """Marks hit words in ``mask``, adds item ids to ``listed``; the matches by text, if asked for."""
    n = len(first) - 1
    sa = SuffixArray(hashes, items.window)
    runs: list[list[tuple]] = [[] for _ in range(n)]
    edge = np.zeros(len(hashes) + 1, np.int64)
    for suffix, place, length in find(sa, items):
        np.add.at(edge, place, 1)
        np.add.at(edge, place + length, -1)
        doc = np.searchsorted(first, place, "right") - 1
        item = items.item[suffix]
        for pair in np.unique(doc * len(items.ids) + item).tolist():
            if items.ids[pair % len(items.ids)] is not None:
                listed[pair // len(items.ids)].add(items.ids[pair % len(items.ids)])
        if not matches:
            continue
        # windows that follow each other in item and document are one match
        order = np.lexsort((place, place - items.at[suffix], item, doc))
        d, t, p, w = doc[order], item[order], place[order], items.at[suffix][order]
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1) | (w[1:] != w[:-1] + 1)]))
        stop = np.append(cut[1:], len(d)) - 1
        for a, b in zip(cut, stop, strict=True):
            k = int(d[a])
            runs[k].append((items.ids[t[a]], int(w[a]), int(p[a] - first[k]), int(p[b] - p[a] + length[0])))
    mask |= np.cumsum(edge[:-1]) > 0
    return runs


def _pass(block, text_at: int, first_pass: bool, last: bool, keep: str, schema: pa.Schema):
    """One pass of the shards over one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        for batch in batches:
            for a, b, buf, offs in W.chunks(batch.column(text_at), SHARD_BYTES):
                own = batch.slice(a, b - a)
                hashes, first = shard_words(buf, offs)
                n = b - a
                mask = np.zeros(len(hashes), bool)
                listed: list[set] = [set() for _ in range(n)]
                earlier: list[list] = [[] for _ in range(n)]
                if not first_pass:
                    bits, names, found = (own.column(own.num_columns - 3 + k).to_pylist() for k in range(3))
                    for k in range(n):
                        size = int(first[k + 1] - first[k])
                        mask[first[k] : first[k + 1]] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=size).astype(bool)
                        listed[k].update(names[k])
                        earlier[k] = [tuple(m.values()) for m in found[k]]
                runs = _mark(hashes, first, items, mask, listed, keep == "matches") if len(items.pos) else [[] for _ in range(n)]
                runs = [x + y for x, y in zip(earlier, runs, strict=True)]
                cols = [own.column(k) for k in range(own.num_columns - (0 if first_pass else 3))]
                if not last:
                    bits = [np.packbits(mask[first[k] : first[k + 1]]).tobytes() for k in range(n)]
                    cols += [bits, [sorted(x) for x in listed], [[dict(zip(("item_id", "item_word", "doc_word", "n_words"), m, strict=True)) for m in r] for r in runs]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
                    continue
                n_words = np.diff(first) - 1
                total = np.concatenate([[0], np.cumsum(mask)])
                n_hit = total[first[1:]] - total[first[:-1]]
                dirty = (n_hit > 0) & (20 * n_hit >= n_words)
                if keep == "clean":
                    yield pa.RecordBatch.from_arrays(cols, schema=schema).filter(pa.array(~dirty))
                    continue
                cols = [c for k, c in enumerate(cols) if k != text_at]
                sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in listed]
                cols += [n_words, n_hit, [len(x) for x in listed], sha, dirty]
                if keep == "matches":
                    cols.append([[dict(zip(("item_id", "item_word", "doc_word", "n_words"), m, strict=True)) for m in r] for r in runs])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[object, bool]]:
    """The distinct items in broadcast blocks of bounded size, made one after the other, and whether
    a block is the last."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL").distinct()
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else own.collect()
        rows.sort(key=lambda r: (r.i or "", r.t))
        yield spark.sparkContext.broadcast(Items([r.i for r in rows], [r.t for r in rows], window)), k == n - 1


def _run(docs: DataFrame, benchmark: DataFrame, columns: list[str], keep: str, window: int, block_bytes: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    work = docs.select(*[F.col(f"`{c}`") for c in columns])
    text_at = columns.index("text")
    fields = list(work.schema.fields)
    state = [T.StructField("_hit", T.BinaryType()), T.StructField("_listed", T.ArrayType(T.StringType())), T.StructField("_found", T._parse_datatype_string(MATCH))]
    for k, (block, last) in enumerate(_blocks(benchmark, window, block_bytes)):
        if not last:
            out = T.StructType(fields + state)
        elif keep == "clean":
            out = T.StructType(fields)
        else:
            out = T.StructType([f for j, f in enumerate(fields) if j != text_at] + RESULT.fields + ([T.StructField("matches", state[2].dataType)] if keep == "matches" else []))
        work = work.mapInArrow(_pass(block, text_at, k == 0, last, keep, to_arrow_schema(out)), out)
        if not last:  # so that the block can go before the next one is made
            work = written(work, "pass")
            block.destroy()
    return work


def scan(docs: DataFrame, benchmark: DataFrame, *, matches: bool = False, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at
    least a word hit and at least a twentieth of them); with ``matches`` also the maximal
    verbatim matches (item, word of the item, word of the document, words)."""
    return _run(docs, benchmark, ["doc_id", "text"], "matches" if matches else "digest", window, block_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they are, without the contaminated ones."""
    return _run(docs, benchmark, docs.columns, "clean", window, block_bytes)
