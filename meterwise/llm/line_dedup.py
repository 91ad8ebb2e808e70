"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line (between line feeds, outer ASCII white space aside) that is not blank goes if it equals
an earlier line, or, from ``MIN_CHARS`` characters, if the first place of a line within
``MAX_EDITS`` edits of it is earlier than its own first place; the order is that of doc_id,
then of the text's hash, then of the line's number. Blank lines stay. Edits of shorter lines
make other words of them, so these go as exact repeats only. A document that had words and
loses all of them goes as a whole.

1. Lines are grouped by hash (partial minimum of place, so a line that fills a third of the
   corpus is one row per task); only distinct lines go on.
2. A line is split into ``MAX_EDITS + 1`` segments; ``MAX_EDITS`` edits leave one of them as it
   is. Its index keys are hashes of its length and a segment; its probes are hashes of the
   substrings that could be that segment in a line shorter by 0 to ``MAX_EDITS`` characters,
   at the places that the edits before it allow. Lines that share a key are candidates.
3. A key with more than ``HOT`` lines is not paired. Its lines are split anew into four times as
   many segments, and their keys keep all segments but ``MAX_EDITS``, which any true pair still
   shares, until no key is hot or segments are single characters (``LEVELS``). So lines that
   share much but not all of their text part ways before they are paired.
4. Candidates lose their common beginning and end; the rest is verified by a bit-parallel
   automaton whose words hold the band of ``2 * MAX_EDITS + 1`` diagonals, one word per edit.

Edge cases: a null text stays null, an empty one empty. Equal rows (doc_id and text) are one
document: they lose the same lines. Null ids come first. Lines of one character class, ties
and very long lines need no special care: keys are hashes of any length of text.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import written

#: Characters of the shortest line that goes as an exact repeat, and as a near one.
EXACT_CHARS = 1
MIN_CHARS = 20
MAX_EDITS = 1
HOT = 64
LEVELS = 4
#: ASCII white space: a line's own, outside of it, is not compared.
SPACES = " \t\n\x0b\f\r"
#: Candidate lines whose hashes (8 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def _key(line: Column, length: Column, segments: int, left_out: tuple[int, ...], shifts: tuple[int, ...]) -> Column:
    """Hash of the segments kept of a line of ``length``, found in ``line`` after shifts."""
    parts: list[Column] = []
    first, shift = 0, 0
    for k, move in zip((*left_out, segments), (*shifts, 0), strict=True):
        if k > first:  # the run of kept segments before the next left-out one
            a, b = (F.floor(length * F.lit(x) / F.lit(segments)).cast("int") for x in (first, k))
            parts.append(F.substring(line, a + 1 + shift, b - a))
        first, shift = k + 1, shift + move
    return F.xxhash64(F.lit(segments), F.lit(",".join(map(str, left_out))), length, *parts)


def _splits(segments: int, edits: int) -> tuple[list[tuple], list[tuple]]:
    """(segments left out, shift after each of them) of the index keys, and of the further probes."""
    index, probes, seen = [], [], set()
    for out in combinations(range(segments), edits):
        index.append((out, (0,) * edits))
        for shifts in product(range(-edits, edits + 1), repeat=edits):
            shorter = sum(shifts)
            if 0 <= shorter and sum(map(abs, shifts)) <= edits and any(shifts):
                # shifts matter only where a kept segment follows
                kept, at = [], 0
                for k in range(segments):
                    if k in out:
                        at += shifts[out.index(k)]
                    else:
                        kept.append((k, at))
                if (shorter, tuple(kept)) in seen or (shorter == 0 and not any(s for _, s in kept)):
                    continue
                seen.add((shorter, tuple(kept)))
                probes.append((out, shifts))
    return index, probes


def keys(line: Column, length: Column, segments: int, edits: int) -> tuple[list[Column], list[Column]]:
    """(index keys, further probes) of a line, a column each: for few segments."""
    index, probes = _splits(segments, edits)
    return [_key(line, length, segments, out, shifts) for out, shifts in index], [_key(line, length - F.lit(sum(shifts)), segments, out, shifts) for out, shifts in probes]


def _document_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.col("text"))


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(i, k, pos, line, n, h, g): every line of at least ``shortest`` characters with its
    document's id and key, its length and two hashes."""
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("i"), _document_key().alias("k"), F.posexplode(F.split("text", "\n")).alias("pos", "whole"))
    line = F.btrim("whole", F.lit(SPACES))
    return rows.select("i", "k", "pos", line.alias("line")).withColumn("n", F.length("line")).where(F.col("n") >= shortest).withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit("g"), "line"))


def _keyed(lines: DataFrame, segments: int, edits: int) -> DataFrame:
    """(key, index, h) of distinct lines: the keys of ``keys`` as rows, one expression for any number
    of segments (the driver plans and compiles an expression per key otherwise)."""
    index, probes = _splits(segments, edits)
    splits = F.from_json(F.lit(str([[*out, *shifts] for out, shifts in [*index, *probes]])), "array<array<int>>")
    rows = lines.select("h", "line", "n", F.explode(splits).alias("split"))
    out, shifts = ([F.get("split", F.lit(e)) for e in range(at, at + edits)] for at in (0, edits))
    length = F.col("n") - sum(shifts, F.lit(0))
    parts, first, shift = [], F.lit(0), F.lit(0)
    for k, move in zip((*out, F.lit(segments)), (*shifts, F.lit(0)), strict=True):  # the kept segments before each left-out one
        a, b = (F.floor(length * x / F.lit(segments)).cast("int") for x in (first, k))
        parts.append(F.substring(F.col("line"), a + 1 + shift, b - a))
        first, shift = k + 1, shift + move
    unmoved = F.forall(F.slice("split", edits + 1, edits), lambda move: move == 0)
    return rows.select(F.xxhash64(*out, length, *parts).alias("key"), unmoved.alias("index"), "h")


def _pairs(keyed: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b of lines that share a key which is not hot; lines h of hot keys)."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.count_if("index").alias("indexed")).where("rows > 1 AND indexed > 0")
    shared = written(keyed.join(counts.select("key", "rows"), "key"), "line-keys")
    cold = shared if last else shared.where(F.col("rows") <= HOT)
    a = cold.where("index").select("key", F.col("h").alias("a"))
    b = cold.select("key", F.col("h").alias("b"), F.col("index").alias("both"))
    # two indexed lines meet twice: once is enough
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) | (~F.col("both") & (F.col("a") > F.col("b"))))
    hot = shared.where(F.lit(not last) & (F.col("rows") > HOT)).select("h").distinct()
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), hot


def _of_hashes(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """(h, line, n): each line among the hashes once. The hashes are broadcast if their count
    allows, else both sides are shuffled."""
    wanted = F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes
    return lines.join(wanted, "h").groupBy("h").agg(F.min("line").alias("line"), F.min("n").alias("n"))


def _common(a: Column, b: Column, end: bool) -> Column:
    """The length of the common beginning (or end) of two strings, by halving."""
    part = (lambda s, n: F.right(s, n)) if end else (lambda s, n: F.left(s, n))
    most = F.least(F.length(a), F.length(b))
    bits = F.reverse(F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int")))

    def step(n: Column, bit: Column) -> Column:
        more = n + F.pow(F.lit(2), bit).cast("int")
        return F.when((more <= most) & (part(a, more) == part(b, more)), more).otherwise(n)

    return F.aggregate(bits, F.lit(0), step)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits, by a banded bit-parallel automaton.

    Bit ``d + edits`` of word e is set if e edits can align the first j characters of b with
    the first j + d of a. A character of b keeps the bits whose character of a matches; an
    edit moves a bit into the next word: in place (substitution), one diagonal down (b has
    one more) or up (a has one more).
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    x, y = F.split(a, ""), F.split(b, "")
    chars_a = F.when(F.length(a) == 0, F.array().cast("array<string>")).otherwise(x)
    chars_b = F.when(F.length(b) == 0, F.array().cast("array<string>")).otherwise(y)

    def match(own: Column):
        def one(c: Column, j: Column) -> Column:
            out = F.lit(0)
            for d in range(-edits, edits + 1):
                out = out + F.when(F.when(j + d >= 0, F.get(own, j + d)) == c, F.lit(1 << (d + edits))).otherwise(F.lit(0))
            return out

        return one

    def word(k: int) -> str:
        return f"w{k}"

    start = F.struct(*[F.lit(sum(1 << (d + edits) for d in range(e + 1)) & full).alias(word(e)) for e in range(edits + 1)])

    def step(acc: Column, m: Column) -> Column:
        new = [acc[word(0)].bitwiseAND(m)]
        for e in range(1, edits + 1):
            less = acc[word(e - 1)]
            one = acc[word(e)].bitwiseAND(m).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(one.bitwiseAND(F.lit(full)))
        return F.struct(*[w.alias(word(e)) for e, w in enumerate(new)])

    masks = F.element_at(F.transform(F.array(chars_a), lambda own: F.transform(chars_b, match(own))), 1)
    state = F.aggregate(masks, start, step, lambda acc: acc[word(edits)])  # the last word holds all others
    diagonal = F.length(a) - F.length(b) + edits
    ok = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(ok, F.pmod(F.floor(state / F.pow(F.lit(2), F.greatest(diagonal, F.lit(0)))), F.lit(2)) == 1).otherwise(F.lit(False))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def near(x: Column, y: Column, edits: int) -> Column:
    """``within``, the common beginning and end left away first."""

    def end(s: Column) -> Column:
        cut = lambda q: F.struct(*[F.left(s[c], F.length(s[c]) - q).alias(c) for c in "xy"])
        return _let(_let(_common(s["x"], s["y"], True), cut), lambda m: within(m["x"], m["y"], edits))

    begin = lambda p: F.struct(*[F.right(c, F.length(c) - p).alias(n) for n, c in (("x", x), ("y", y))])
    return _let(_let(_common(x, y, False), begin), end)


def near_pairs(lines: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """(a, b): hashes of different distinct lines within ``edits`` edits."""
    segments, found, hot = edits + 1, None, None
    for level in range(LEVELS):
        if hot is None:
            own = [F.col(c) for c in distinct.columns if c.startswith(("index_", "probe_"))]
            each = [F.struct(c.alias("key"), F.lit(name.startswith("index_")).alias("index")) for c, name in zip(own, [c for c in distinct.columns if c.startswith(("index_", "probe_"))], strict=True)]
            keyed = distinct.select("h", F.explode(F.array(*each)).alias("e")).select("e.key", "e.index", "h").where("key IS NOT NULL")
        else:
            keyed = _keyed(_of_hashes(lines, hot), segments, edits)
        pairs, hot = _pairs(keyed, level == LEVELS - 1)
        found = pairs if found is None else found.union(pairs)
        if level == LEVELS - 1 or not hot.limit(1).count():
            break
        hot, segments = written(hot, "hot-lines"), segments * 4
    found = written(found.distinct(), "line-pairs")
    ids = found.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = written(_of_hashes(lines, written(ids, "line-ids")), "line-texts")
    both = found.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x"), F.col("n").alias("nx")), "a")
    both = both.join(texts.select(F.col("h").alias("b"), F.col("line").alias("y"), F.col("n").alias("ny")), "b").where(F.abs(F.col("nx") - F.col("ny")) <= edits)
    return both.where(near(F.col("x"), F.col("y"), edits)).select("a", "b")


def removals(docs: DataFrame, *, edits: int = MAX_EDITS, shortest: int = MIN_CHARS) -> DataFrame:
    """(k, removed, n_exact, n_near): per document key the numbers of the lines that go; lines
    of fewer than ``shortest`` characters stay."""
    lines = _lines(docs, shortest)
    index, probes = keys(F.col("line"), F.col("n"), edits + 1, edits)
    long = F.col("n") >= MIN_CHARS  # shorter lines have no keys
    named = [F.when(long, k).alias(f"index_{j}") for j, k in enumerate(index)] + [F.when(long, k).alias(f"probe_{j}") for j, k in enumerate(probes)]
    each = lines.select("h", "g", F.struct("i", "k", "pos").alias("at"), *named)
    # the keys are the same for equal lines, so any of them will do
    distinct = written(each.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("rows"), *[F.max(c).alias(c) for c in each.columns[3:]]), "lines")
    near = near_pairs(lines, distinct, edits)
    place = distinct.select("h", "first")
    order = near.join(place.select(F.col("h").alias("a"), F.col("first").alias("fa")), "a").join(place.select(F.col("h").alias("b"), F.col("first").alias("fb")), "b")
    late = order.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct().withColumn("near", F.lit(True))
    marked = distinct.select("h", "g", "first", "rows").join(late, "h", "left").where("rows > 1 OR near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    own = lines.select("h", "g", F.struct("i", "k", "pos").alias("at")).join(marked, ["h", "g"])
    gone = own.where(F.col("near") | ~F.col("at").eqNullSafe(F.col("first"))).select(F.col("at.k").alias("k"), F.col("at.pos").alias("pos"), F.col("at").eqNullSafe(F.col("first")).alias("near"))
    once = gone.groupBy("k", "pos").agg(F.max("near").alias("near"))
    return once.groupBy("k").agg(F.collect_list("pos").alias("removed"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"))


def dedup(docs: DataFrame, *, edits: int = MAX_EDITS) -> DataFrame:
    """The documents as struct ``row`` (all columns, text without the lines that go), with
    n_lines, n_exact, n_near and ``whole`` (whether it had words and lost them all)."""
    gone = removals(docs, edits=edits, shortest=EXACT_CHARS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), _document_key().alias("k"))
    both = rows.join(gone, "k", "left").withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    has_word = lambda c: F.coalesce(c.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = both.select("row", text.alias("clean"), "text", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")])
    return out.select(F.col("row").withField("text", F.col("clean")).alias("row"), "n_lines", "n_exact", "n_near", (has_word(F.col("text")) & ~has_word(F.col("clean"))).alias("whole"))


def clean(docs: DataFrame, *, edits: int = MAX_EDITS) -> DataFrame:
    """The documents with their remaining lines, all other columns as they are; documents that
    lost all their words go. A column n_chars is brought up to date."""
    out = dedup(docs, edits=edits).where(~F.col("whole")).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
