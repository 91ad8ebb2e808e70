"""The prefix trie of rebuilt conversations, from fingerprints that compose.

Conversation c is rebuilt from the first h turns of conversation c - c % ``GROUP`` (its base) and
its own turns after its first h, where h is the unsigned crc32 of c in decimal modulo ``HEADS``.
No rebuilt text is ever made. A sequence of n turns has the fingerprint (n, s), s being the sum of
x_i * B**i over its turns modulo primes (four lanes, about 124 bits; x_i is taken from the turn's
SHA-256). Fingerprints form a monoid, (m, s) (n, t) = (m + n, s + B**m t), with inverses for
known parts, so that the prefixes of a rebuilt conversation are the base's prefixes, then
``P + B**(p - h) (S_i - S_h)`` from the prefix sums S of the own turns.

1. Turns are sorted by range of (conv_id, turn): a conversation of any length is spread over
   tasks. Each task folds its own part; parts that begin within a conversation are completed by
   the folded parts before them, one summary a range (the only thing the driver sees).
2. The prefixes of all rebuilt conversations, each a fingerprint and a reference to its stored
   last turn, are grouped to nodes. A group is proved equal by its references: all of its
   members' last turns have one SHA-256 and their parents one fingerprint, which, from the root
   down, makes the whole sequences equal. A group that fails (never seen) is refingerprinted
   with other bases.
3. A node belongs to its smallest member; the nodes of one owner are a chain that ends where the
   owner ends. Sums over a subtree are sums along the rest of the chain, plus, for every prefix of
   an owner above its chain, the chain's total: one row a prefix, grouped with partial sums.
4. The members that end at a node are listed in blocks of ``BLOCK`` ids; where a node has several,
   their texts are hashed one after the other (SHA-256 has no parallel form), never held at once.

Edge cases: rows without conv_id are no conversation's and are left out; a null turn comes first,
null role and text are empty; rows with equal turns are ordered by role and the text's first 32
characters, then by the turn's SHA-256 (so repeated rows are turns of their own); empty tables
give no rows, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.scratch import written
from meterwise.llm.skew import hot_join

#: Conversations whose ids begin alike share a base: c - c % GROUP.
GROUP = 20
#: At most HEADS - 1 turns come from the base.
HEADS = 4
#: Conversation ids per block of a node's ends, and nodes per block of a chain.
BLOCK = 4096
CHAIN_BLOCK = 1024

PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
LANES = ["s0", "s1", "s2", "s3"]


def _bases(seed: int) -> np.ndarray:
    raw = hashlib.sha256(f"bases {seed}".encode()).digest()[:16]
    return np.frombuffer(raw, ">u4").astype(np.int64) % (PRIMES - 1000) + 500


def _powers(bases: np.ndarray, n: int) -> np.ndarray:
    """Powers 0 to n of the bases, lane by lane, by doubling."""
    out = np.ones((4, 1), np.int64)
    step = bases.copy()
    while out.shape[1] <= n:
        out = np.concatenate([out, out * step[:, None] % PRIMES[:, None]], axis=1)
        step = step * step % PRIMES
    return out


def _power(bases: np.ndarray, n: int) -> np.ndarray:
    """The n-th power of the bases; n may be negative."""
    return np.array([pow(int(b), int(n), int(p)) for b, p in zip(bases, PRIMES, strict=True)], np.int64)


def _values(refs: pa.Array) -> np.ndarray:
    """x of each turn, lane by lane, from its SHA-256."""
    raw = np.frombuffer(b"".join(refs.to_pylist()), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)
    return (raw % PRIMES).T


def _fold(bases: np.ndarray):
    """Adds, to turns in order, their place k in the part of their conversation that the task
    has and the sum of that part up to them; plus the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, k, s, powers = None, 0, np.zeros(4, np.int64), _powers(bases, 1 << 12)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            new = np.concatenate([[True], c[1:] != c[:-1]])
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(c)))
            place = np.arange(len(c)) - np.repeat(at, sizes) + 1
            first = int(sizes[0])
            if conv == c[0]:
                place[:first] += k
            else:
                s = np.zeros(4, np.int64)
            if place.max() >= powers.shape[1]:
                powers = _powers(bases, int(place.max()))
            sums = np.cumsum(_values(batch.column(1)) * powers[:, place] % PRIMES[:, None], axis=1)
            begin = np.concatenate([np.zeros((4, 1), np.int64), sums], axis=1)[:, at]
            begin[:, 0] -= s
            sums = (sums - np.repeat(begin, sizes, axis=1)) % PRIMES[:, None]
            conv, k, s = c[-1], int(place[-1]), sums[:, -1].copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), part, np.int32)), batch.column(0), pa.array(place.astype(np.int64)), *(pa.array(x) for x in sums), batch.column(1), batch.column(2)],
                names=["part", "conv_id", "k", *LANES, "ref", "n_words"])

    return run


def _carried(folded: DataFrame, bases: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """For each range that begins within a conversation: (conversation, turns and sum of the ranges
    before). From one summary a range: the last turn of its first and of its last conversation."""
    ends = folded.groupBy("part").agg(
        F.min(F.struct("conv_id", (-F.col("k")).alias("k"), *LANES)).alias("a"), F.max(F.struct("conv_id", "k", *LANES)).alias("z")).orderBy("part").collect()
    out: dict[int, tuple[int, int, list[int]]] = {}
    conv, n, s = None, 0, np.zeros(4, np.int64)
    for r in ends:
        if conv == r.a.conv_id:
            out[r.part] = (conv, n, s.tolist())
        before = (n, s) if conv == r.z.conv_id else (0, np.zeros(4, np.int64))
        conv, n = r.z.conv_id, before[0] + r.z.k
        s = (before[1] + _power(bases, before[0]) * np.array([r.z[x] for x in LANES], np.int64)) % PRIMES
    return out


def _completed(carried: dict[int, tuple[int, int, list[int]]], bases: np.ndarray):
    """Places and sums of whole conversations from those of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, k = (batch.column(i).to_numpy() for i in range(3))
            k, s = k.copy(), np.array([batch.column(3 + i).to_numpy() for i in range(4)])
            for p in np.unique(part).tolist():
                if p in carried:
                    c, n, before = carried[p]
                    own = np.flatnonzero((part == p) & (conv == c))
                    k[own] += n
                    s[:, own] = (np.array(before, np.int64)[:, None] + _power(bases, n)[:, None] * s[:, own]) % PRIMES[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(k), *(pa.array(x) for x in s), batch.column(7), batch.column(8)], names=["conv_id", "pos", *LANES, "ref", "n_words"])

    return run


def _prints(s: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(s.T.astype(">u4")).tobytes()
    return pa.Array.from_buffers(pa.binary(), s.shape[1], [None, pa.py_buffer(np.arange(0, len(raw) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(raw)])


PREFIX = "conv_id bigint, depth bigint, fp binary, parent binary, ref binary, n_words bigint, ends boolean"


def _prefixes(bases: np.ndarray):
    """Rows of PREFIX from rows (conv_id, place in the sequence it is taken from, sums up to there,
    ref, n_words, shift: how far the places move, h sums to take off, base sums to add, whether it
    is the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, shift = batch.column(1).to_numpy(), batch.column(8).to_numpy()
            s, off, add = (np.array([batch.column(a + i).to_numpy() for i in range(4)]) for a in (2, 9, 13))
            refs, real = batch.column(6), pos > 0
            x = np.zeros_like(s)
            if real.any():
                own = np.flatnonzero(real)
                powers = _powers(bases, int(pos.max()))
                x[:, own] = _values(refs.take(pa.array(own))) * powers[:, pos[own]] % PRIMES[:, None]
            move = np.ones_like(s)
            for v in np.unique(shift).tolist():
                move[:, shift == v] = _power(bases, v)[:, None]
            mod = PRIMES[:, None]
            fp = (add + move * ((s - off) % mod)) % mod
            parent = (add + move * ((s - x - off) % mod)) % mod
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos + shift), _prints(fp), _prints(parent), refs, batch.column(7), batch.column(17)],
                                             names=["conv_id", "depth", "fp", "parent", "ref", "n_words", "ends"])

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, fp, ends_sha256) from blocks (depth, fp, block, ids) in order."""
    last, state, out = None, None, []
    for batch in batches:
        for depth, fp, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, fp) != last:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (depth, fp), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield _rows(out)
            out = []
    if last is not None:
        yield _rows([(*last, state.hexdigest())])


def _rows(rows: list[tuple[int, bytes, str]]) -> pa.RecordBatch:
    d, f, h = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.binary()), pa.array(h, pa.string())], names=["depth", "fp", "ends_sha256"])


def _turns(conversations: DataFrame) -> DataFrame:
    """The turns as fixed-size rows: SHA-256 of role and text as reference, number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ref = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(32)).alias("head"), ref.alias("ref"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("nth"))


def _prefix_rows(turns: DataFrame, bases: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation (PREFIX), and the conversations that are spread
    over several ranges (at most one a range)."""
    spark = turns.sparkSession
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("ref"), F.asc("nth")]
    lanes = ", ".join(f"{x} bigint" for x in LANES)
    cut = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "ref", "n_words")
    folded = written(cut.mapInArrow(_fold(bases), f"part int, conv_id bigint, k bigint, {lanes}, ref binary, n_words bigint"), "folded")
    carried = _carried(folded, bases)
    hot = spark.createDataFrame([(c,) for c, _, _ in carried.values()], "conv_id long")
    own = folded.mapInArrow(_completed(carried, bases), f"conv_id bigint, pos bigint, {lanes}, ref binary, n_words bigint")
    head = F.struct("pos", *LANES, "ref", "n_words")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, head))).alias("head"))
    base = convs.select(F.col("conv_id").alias("base_id"), F.col("head").alias("base"))
    c = F.col("conv_id")
    convs = convs.withColumn("h", F.crc32(c.cast("string")) % HEADS).join(base, F.col("base_id") == c - c % GROUP, "left")
    taken = F.least("h", F.coalesce(F.size("base"), F.lit(0))).cast("long")
    at = lambda a, i: F.when(i > 0, F.get(a, (i - 1).cast("int")))  # noqa: E731  the fingerprint of the first i turns
    skipped = F.least("h", "n")
    convs = convs.select("conv_id", "h", taken.alias("p"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), "base",
                         at(F.col("head"), skipped).alias("off"), at(F.col("base"), taken).alias("add"))
    convs = written(convs, "convs")
    zeros = [F.lit(0).cast("long").alias(f"{k}{i}") for k in ("off", "add") for i in range(4)]
    shift0 = F.lit(0).cast("long").alias("shift")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(x) for x in LANES], F.lit(None).cast("binary").alias("ref"),
                        F.lit(0).cast("long").alias("n_words"), shift0, *zeros, (F.col("len") == 0).alias("ends"))
    top = convs.where("p > 0").select("conv_id", "len", F.explode(F.slice("base", F.lit(1), F.col("p").cast("int"))).alias("t"))
    top = top.select("conv_id", "t.pos", *[f"t.{x}" for x in LANES], "t.ref", "t.n_words", shift0, *zeros, (F.col("len") == F.col("t.pos")).alias("ends"))
    info = convs.select("conv_id", "h", "p", "len", "off", "add")
    rest = hot_join(own, info, ["conv_id"], hot).where("pos > h")
    lane = lambda k, i: F.coalesce(F.col(f"{k}.{LANES[i]}"), F.lit(0)).cast("long").alias(f"{k}{i}")
    move = F.col("p") - F.col("h")
    rest = rest.select("conv_id", "pos", *LANES, "ref", "n_words", move.alias("shift"), *[lane(k, i) for k in ("off", "add") for i in range(4)],
                       (F.col("pos") + move == F.col("len")).alias("ends"))
    return written(root.unionByName(top).unionByName(rest).mapInArrow(_prefixes(bases), PREFIX), "prefixes"), hot


def _nodes(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prefixes, nodes, spread conversations); the nodes' members are proved to be equal."""
    for seed in range(8):
        prefixes, hot = _prefix_rows(turns, _bases(seed))
        nodes = prefixes.groupBy("depth", "fp").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
            F.min("parent").alias("parent"), F.max("parent").alias("parent_too"), F.min("ref").alias("ref"), F.max("ref").alias("ref_too"))
        nodes = written(nodes, "nodes")
        if nodes.where("NOT (ref <=> ref_too) OR parent <> parent_too").isEmpty():
            return prefixes, nodes.drop("ref", "ref_too", "parent_too"), hot
    raise RuntimeError("eight sets of bases all met a collision of fingerprints")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; plus fp, the node's fingerprint."""
    prefixes, nodes, hot = _nodes(written(_turns(conversations), "turns"))
    own = nodes.select("*", ((F.col("n_convs") - 1) * F.col("n_words")).alias("value"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"),
                       F.floor(F.col("depth") / CHAIN_BLOCK).alias("block"))

    # along the own chain, downwards: within blocks, then over the blocks below
    inner = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = own.groupBy("conv_id", "block").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf"))
    outer = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("conv_id", "block", F.sum("value").over(outer).alias("more"), F.sum("leaf").over(outer).alias("more_leaf")).where("more IS NOT NULL")
    chain = own.select("conv_id", "depth", "fp", "parent", "n_convs", "block", F.sum("value").over(inner).alias("saved"), F.sum("leaf").over(inner).alias("leaves"))
    chain = chain.join(later, ["conv_id", "block"], "left").select(
        "conv_id", "depth", "fp", "parent", "n_convs", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaf", F.lit(0))).alias("leaves"))

    # to the nodes above the own chain
    tops = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("value").alias("up_saved"), F.sum("leaf").alias("up_leaves"))
    up = hot_join(prefixes.select("conv_id", "depth", "fp"), tops, ["conv_id"], hot).where("depth < top")
    up = up.groupBy("depth", "fp").agg(F.sum("up_saved").alias("up_saved"), F.sum("up_leaves").alias("up_leaves"))
    kids = own.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count("*").alias("n_children"))

    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    ends = prefixes.where("ends").groupBy("depth", "fp", block).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "block").select("depth", "fp", "block", "ids")
    ends = ends.mapInArrow(_chained, "depth bigint, fp binary, ends_sha256 string")

    node = chain.select("depth", "fp", F.struct("conv_id", "parent", "n_convs", "saved", "leaves").alias("node"))
    parts = node.unionByName(up, allowMissingColumns=True).unionByName(kids, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = parts.groupBy("depth", "fp").agg(F.max("node").alias("node"), zero("up_saved").alias("up_saved"), zero("up_leaves").alias("up_leaves"),
                                             zero("n_children").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"))
    whole = written(whole.select("depth", "fp", "node.*", "up_saved", "up_leaves", "n_children", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "whole")

    # the parent's smallest member; a parent of many children is one of at most 1,000
    many = max(1000, whole.count() // 1000)
    up_one = whole.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    crowded = whole.where(F.col("n_children") > many).select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"))
    placed = hot_join(whole.where("depth > 0"), up_one, ["depth", "parent"], crowded).unionByName(whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("up_leaves")).cast("long").alias("n_leaves"),
                         (F.col("saved") + F.col("up_saved")).cast("long").alias("saved_tokens"), "ends_sha256", "fp")
