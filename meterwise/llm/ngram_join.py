"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of
at least 0.75, as connected groups.

1. Every text becomes its set of hashed shingles; documents with equal sets share a digest
   and are one node from then on.
2. A tree of group counts alone can't prune over all documents: with hundreds of shingles in
   a set, unrelated points lie as close as counts of random hashes do. So the trees are built
   within blocks. ``BANDS`` keys of ``ROWS`` minimum hashes each are taken of every set; nodes
   that share a key get an edge to the key's first node (one edge per row, never pairs; rows
   of one key are first joined within each task, so a frequent key sends one row per task).
   The edges' connected components are blocks. A pair at the threshold of 0.75 fails to meet
   with probability (1 - 0.75**5)**60 = 9e-8, a pair at 0.8 with 4e-11.
3. Each block's sets are hashed into ``GROUPS`` groups of shingles; the group counts are the
   points of an R-tree (``CountTree``). The overlap of two sets is at most the sum of the
   coordinate minima of their points, hence also of a point and a node's upper corner; what
   that bound leaves is verified on the sets. Points already in one group are not compared
   again. A block of more than ``BLOCK_SHINGLES`` shingles is cut into chunks, and every
   pair of chunks is a task of its own, so no task holds an unbounded block.
4. Links (a spanning forest of each block's) give the final components.

Edge cases: null or empty texts, and texts of blanks, have no shingles and link with nothing;
texts of fewer than ``n`` words have one shingle, the whole sequence; repeated rows and equal
sets are one node. Null ids never become a component id unless there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm import words as W
from meterwise.llm.components import components
from meterwise.llm.scratch import written

SHINGLE = 5
#: Similarity: 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
BANDS = 60
ROWS = 5
GROUPS = 128
BLOCK_SHINGLES = 4 << 20
LEAF = 16
#: Orders of minimum hashes in which neighbours are compared first.
ROUNDS = 12
#: Shingles of the pairs compared at a time.
PAIR_SHINGLES = 4 << 20


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and where each begins."""
    low = W.LOWER[buf]
    starts, ends, first = W.split_words(low, offs, W.NON_SPACE)
    h = W.word_hashes(low, starts, ends)
    grams = W.ngram_hashes(h, n)
    out, sizes = [], np.zeros(len(offs) - 1, np.int64)
    for k in range(len(offs) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            s = s[W.run_starts(s)]
        elif b > a:
            s = W.ngram_hashes(h[a:b], b - a)
        else:
            continue
        sizes[k] = len(s)
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    run = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(sets))])
    return W.mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


_ODD = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(32))


def band_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys (bands by sets) of sets that are not empty."""
    out = np.empty((BANDS, len(at) - 1), np.uint64)
    for band in range(BANDS):
        key = np.full(len(at) - 1, band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = W.mix(key + np.minimum.reduceat((sets ^ _XOR[k]) * _ODD[k], at[:-1]))
        out[band] = key
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, h, size, digest) per document."""
    for batch in batches:
        for a, b, buf, offs in W.chunks(batch.column(2)):
            sets, at = shingle_sets(buf, offs)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(digests(sets, at), pa.int64(), mask=n == 0)], names=["doc_id", "h", "n", "digest"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, false) of each set, and edges (digest, digest, true) between sets of
    one run of rows that share a key; a key's later rows are replaced by the edges."""
    for batch in batches:
        for _, _, buf, offs in W.chunks(batch.column(0), 4 << 20):
            sets, at = shingle_sets(buf, offs)
            d = digests(sets, at)
            some = np.flatnonzero(np.diff(at))
            if not len(some):
                continue
            # equal sets once
            d, one = np.unique(d[some], return_index=True)
            own_at = np.concatenate([[0], np.cumsum(np.diff(at)[some[one]])])
            own_sets = np.concatenate([sets[at[k] : at[k + 1]] for k in some[one]])
            key = band_keys(own_sets, own_at).ravel()
            own = np.tile(d, BANDS)
            by = np.argsort(key, kind="stable")
            key, own = key[by], own[by]
            begin = W.run_starts(key)
            x, y = _distinct_pairs(own, np.repeat(own[begin], np.diff(np.append(begin, len(key)))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[begin].view(np.int64), x])), pa.array(np.concatenate([own[begin], y])), pa.array(np.arange(len(begin) + len(x)) >= len(begin))], names=["a", "b", "edge"])


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of different values, the larger first."""
    keep = x != y
    x, y = np.maximum(x[keep], y[keep]), np.minimum(x[keep], y[keep])
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def _key_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the rows of a key (in order of keys) to its first; edges pass through."""
    last = None
    for batch in batches:
        a, b, edge = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        ex, ey = a[edge], b[edge]
        key, own = a[~edge], b[~edge]
        if len(key):
            if last is not None:
                key, own = np.append(last[0], key), np.append(last[1], own)
            begin = W.run_starts(key)
            head = np.repeat(own[begin], np.diff(np.append(begin, len(key))))
            last = (key[begin[-1]], own[begin[-1]])
            ex, ey = np.concatenate([ex, own]), np.concatenate([ey, head])
        x, y = _distinct_pairs(ex, ey)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])


class CountTree:
    """An R-tree, packed bottom-up in the given order, over group counts; a node keeps its upper
    corner, the smallest and largest set size below it, and the first and last component, so
    that a search passes over the component it comes from as a whole."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray, order: np.ndarray):
        self.order = order
        self.levels = []
        top, lo, hi, first, last = points[order], sizes[order], sizes[order], component[order], component[order]
        while True:
            self.levels.append((top, lo, hi, first, last))
            if len(top) <= LEAF:
                break
            at = np.arange(0, len(top), LEAF)
            top, lo, hi = np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)

    def near(self, point: np.ndarray, size: int, component: int, percent: int) -> np.ndarray:
        """The points of other components whose bound allows a link with the given one."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, lo, hi, first, last = (x[at] for x in self.levels[depth])
            # 100 * overlap >= percent * (size + other - overlap); sizes within the ratio
            ok = ((first != component) | (last != component)) & (100 * hi >= percent * size) & (100 * size >= percent * lo)
            at, top, lo = at[ok], top[ok], lo[ok]
            bound = np.minimum(top, point).sum(1, dtype=np.int64)
            at = at[(100 + percent) * bound >= percent * (size + lo)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


class _Sets:
    """A block's sets as codes, end to end, and exact comparison of many pairs at once."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(x) for x in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate(sets)
        self.code = np.unique(self.flat, return_inverse=True)[1].astype(np.int64)
        self.bits = max(1, int(self.code.max()).bit_length())

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair link."""
        out = np.zeros(len(x), bool)
        total = np.cumsum(self.size[x] + self.size[y])
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIR_SHINGLES, "right")))
            both = np.concatenate([x[a:b], y[a:b]])
            pair = np.tile(np.arange(b - a), 2)
            n = self.size[both]
            spot = np.repeat(self.at[both] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.sort((np.repeat(pair, n) << self.bits) | self.code[spot])
            same = np.bincount(key[1:][key[1:] == key[:-1]] >> self.bits, minlength=b - a)
            out[a:b] = 100 * same >= self.percent * (self.size[x[a:b]] + self.size[y[a:b]] - same)
            a = b
        return out


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of ``x``, whose paths are shortened to them."""
    root = parent[x]
    while not np.array_equal(step := parent[root], root):
        root = step
    parent[x] = root
    return root


def _union(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the groups of each pair; a group's root is its first set."""
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)


def link_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of its component's first set."""
    m = len(sets)
    parent, every = np.arange(m), np.arange(m)
    block = _Sets(sets, percent)
    smallest = [np.minimum.reduceat((block.flat ^ _XOR[k]) * _ODD[k], block.at[:-1]) for k in range(ROUNDS)]
    for key in smallest:
        by = np.argsort(key, kind="stable")
        begin = W.run_starts(key[by])
        run = np.diff(np.append(begin, m))
        head = np.repeat(by[begin], run)
        later = np.ones(m, bool)
        later[begin] = False
        # each with the one before it, and with the first of its run
        x = np.concatenate([by[1:][later[1:]], by[later]])
        y = np.concatenate([by[:-1][later[1:]], head[later]])
        apart = _find(parent, x) != _find(parent, y)
        x, y = x[apart], y[apart]
        if len(x):
            ok = block.linked(x, y)
            _union(parent, x[ok], y[ok])
    root = _find(parent, every)
    if (root == root[0]).all():
        return root
    points = np.zeros((m, GROUPS), np.uint16)
    group = np.repeat(every, block.size) * GROUPS + (block.flat >> np.uint64(57)).astype(np.int64)
    points.ravel()[:] = np.minimum(np.bincount(group, minlength=m * GROUPS), 65535)
    # components and copies side by side keep the corners of the tree's nodes small
    tree = CountTree(points, block.size, root, np.lexsort((smallest[1], smallest[0], root)))
    largest = np.bincount(root).argmax()
    for k in np.flatnonzero(root != largest).tolist():
        own = np.array([k])
        near = tree.near(points[k], int(block.size[k]), int(root[k]), percent)
        step = 64
        while len(near):
            near = near[_find(parent, near) != _find(parent, own)[0]]
            some, near = near[:step], near[step:]
            if len(some):
                ok = block.linked(np.full(len(some), k), some)
                _union(parent, np.full(int(ok.sum()), k), some[ok])
            step *= 4
    return _find(parent, every)


def _blocks(percent: int):
    """Links (digest, digest of its component's first) of each (block, part, part), whose
    rows come together."""

    def close(texts: list[str], own: list[int]) -> pa.RecordBatch:
        found: dict[int, np.ndarray] = {}
        for _, _, buf, offs in W.chunks(pa.array(texts, pa.large_string())):
            sets, at = shingle_sets(buf, offs)
            for k, d in enumerate(digests(sets, at)):
                found[int(d)] = sets[at[k] : at[k + 1]]
        have = sorted(set(own) & set(found))  # a row whose id another document shares may differ
        root = link_block([found[d] for d in have], percent) if len(have) > 1 else np.zeros(len(have), np.int64)
        ids = np.array(have, np.int64)
        keep = np.flatnonzero(root != np.arange(len(have)))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(ids[root[keep]], pa.int64())], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, own = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cut = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip(cut, cut[1:], strict=False):
                if keys[a] != last and texts:
                    yield close(texts, own)
                    texts, own = [], []
                last = keys[a]
                own += batch.column(3).slice(a, b - a).to_pylist()
                texts += batch.column(4).slice(a, b - a).to_pylist()
        if texts:
            yield close(texts, own)

    return run


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def groups(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, h (hash of its text), n_shingles, component_id (the smallest
    doc_id reachable by links; a label only, since ids may be null or shared) and node (the
    digest that stands for its group, null without shingles)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _hash(F.col("text")).alias("h"), "text")
    profile = written(rows.mapInArrow(_profile, f"doc_id {id_type}, h bigint, n bigint, digest bigint"), "profile")
    keyed = docs.select("text").mapInArrow(_keys, "a bigint, b bigint, edge boolean")
    edges = keyed.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_key_edges, "x bigint, y bigint")
    blocks = components(edges)
    # one document per set of a block, found again by its id and its text's hash
    sets = profile.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("of"), F.max("n").alias("n"))
    nodes = written(sets.join(blocks.withColumnRenamed("node", "digest"), "digest").select("digest", "root", "n", F.col("of.doc_id").alias("i"), F.col("of.h").alias("h")), "nodes")
    large = nodes.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("parts"))
    part = F.pmod(F.col("digest"), F.col("parts")).cast("int")
    placed = nodes.join(large, "root").withColumn("p", part).withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    placed = placed.select("root", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "digest", "i", "h")
    texts = rows.withColumnRenamed("doc_id", "j").withColumnRenamed("h", "g")
    # always by a shuffle of both sides: the texts are no more than once the input
    found = placed.hint("merge").join(texts, (F.col("h") == F.col("g")) & F.col("i").eqNullSafe(F.col("j"))).select("root", "p", "q", "digest", "text")
    links = found.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(_blocks(percent), "x bigint, y bigint")
    linked = components(links).withColumnRenamed("node", "digest")
    # the smallest id of each set, then of each component of sets
    ids = profile.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    ids = ids.join(linked, "digest", "left")
    least = ids.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    named = ids.join(least, "root", "left").where("root IS NOT NULL OR rows > 1").select("digest", "root", F.coalesce("component", "least").alias("component"))
    return profile.join(named, "digest", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("root", "digest").alias("node"))


def keep_one(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are, one of each group: that with the smallest id
    (of rows with that id, the one whose text's hash is smallest; of equal rows, one).
    Documents without shingles all stay."""
    found = written(groups(docs, percent=percent), "groups")
    first = found.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("of"))
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    keep = first.select(F.col("of.doc_id").alias("__i"), F.col("of.h").alias("__h"))
    keep = keep.join(rows.select(F.col("doc_id").alias("__i2"), F.col("h").alias("__h2"), "rows"), (F.col("__h") == F.col("__h2")) & F.col("__i").eqNullSafe(F.col("__i2"))).select("__i", "__h", (F.col("rows") > 1).alias("__many"))
    bare = found.where("n_shingles = 0").select(F.col("doc_id").alias("__i"), F.col("h").alias("__h")).distinct().withColumn("__many", F.lit(False))
    own = docs.withColumn("__text_hash", _hash(F.col("text")))
    kept = own.join(keep.union(bare), (F.col("__h") == F.col("__text_hash")) & F.col("__i").eqNullSafe(own["doc_id"]))
    back = [own[c] for c in docs.columns]
    return kept.where(~F.col("__many")).select(*back).union(kept.where("__many").dropDuplicates(["__i", "__h"]).select(*back))
