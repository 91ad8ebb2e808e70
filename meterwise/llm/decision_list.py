"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

``statistics`` computes the statistics of every whole text. ``learn`` finds an ordered list of
rules for label 0 by sequential covering: on two thirds of the labelled rows a rule grows, one
threshold condition at a time, by the gain in information (FOIL), as long as that helps; on
the other third its last conditions are cut while that raises its worth (hits less misses,
over both). A rule that keeps its precision there is added, the rows it covers leave both
parts, and the next one grows. Thresholds are quantiles; the rows are reduced to the numbers
of their bins once, so each step is one small aggregation of counts per feature and bin.
``verdict`` turns the list into one conditional expression, rule by rule in their order.

Edge cases: null texts count as empty: all statistics 0, failing the base rule by length.
Without labelled rows, or with one label only, the list is empty and keeps everything. Null
labels are left out; a document with several labels counts once for each. Repeated rows get
equal results. ``add_statistics`` replaces columns of the same names; others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import written

SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share", "line_words")
QUANTILES = [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998]
MAX_RULES = 10
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
MIN_SHARE = 0.002


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float
    cut: int  # the bins below ``cut`` are those up to the threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def binned(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.cut) if self.above else c < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """The words within three-word windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            # equal windows stand side by side once sorted
            last = lambda x, k: (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
            next_ = lambda x, k: (k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, k: last(x, k) | next_(x, k)), lambda x: x["i"]))

        none = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("at"))
        add = lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p - acc["at"])).alias("sum"), p.alias("at"))
        sums = F.aggregate(_let(placed, starts), none, add, lambda acc: acc["sum"])
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(sums)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(words, windows), covered))


def _without(text: Column, pattern: str) -> Column:
    """How many characters of a text match."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and the features, per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + r"\z", "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return _features(first.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _without(F.col("text"), r"[#*$%&|<>]").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        _without(F.col("text"), "[A-Z]").cast("long").alias("n_upper"), _without(F.col("text"), "!").cast("long").alias("n_bang"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    ))


def _features(s: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return s.select(
        "*", share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_bang", "n_words").alias("bang_share"),
        share("n_distinct", "n_words").alias("distinct_share"), share("n_words", "n_lines").alias("line_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _counts(rows: DataFrame) -> dict[tuple[str, int, int], int]:
    """Rows per (feature, bin, label)."""
    flat = rows.select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("e"))
    return {(r.f, r.b, r.y): r.n for r in flat.groupBy("e.f", "e.b", "y").agg(F.count("*").alias("n")).collect()}


def _best(counts: dict[tuple[str, int, int], int], cuts: dict[str, list[float]], hits: int, misses: int, least: int) -> tuple[Condition, int, int] | None:
    """The condition with the largest gain, its hits (label 0) and misses."""
    found, most = None, 1e-9
    before = math.log2(hits / (hits + misses))
    for f in FEATURES:
        low = [0, 0]
        for cut, threshold in enumerate(cuts[f], start=1):
            low = [low[y] + counts.get((f, cut - 1, y), 0) for y in (0, 1)]
            for above in (False, True):
                p, n = (hits - low[0], misses - low[1]) if above else low
                if p >= least:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > most:
                        found, most = (Condition(f, above, threshold, cut), p, n), gain
    return found


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.binned()
    return out


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """The rules for label 0 from rows (y, the features), in order."""
    rows = labelled.where("y IN (0, 1)")
    marks = rows.agg(*[F.percentile_approx(f, QUANTILES, 10000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("y") == 0, F.col(f)), QUANTILES, 10000).alias(f"{f}_0") for f in FEATURES]).first()
    if marks[FEATURES[0]] is None:
        return []
    cuts = {f: sorted({float(x) for x in [*(marks[f] or []), *(marks[f"{f}_0"] or [])]}) for f in FEATURES}

    def bin_of(f: str) -> Column:  # how many thresholds lie below
        return F.aggregate(F.array(*[F.lit(x) for x in cuts[f]]), F.lit(0), lambda acc, t: acc + (F.col(f) > t).cast("int")).alias(f)

    rest = written(rows.select("y", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) < 2).alias("grow"), *[bin_of(f) for f in FEATURES]), "bins")
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        grow, rule = rest.where("grow"), []
        while len(rule) < MAX_CONDITIONS:
            counts = _counts(grow.where(_all(rule)))
            hits, misses = (sum(n for (f, _, y), n in counts.items() if f == FEATURES[0] and y == k) for k in (0, 1))
            if not hits or not misses:
                break
            found = _best(counts, cuts, hits, misses, max(3, int(MIN_SHARE * (hits + misses))) if not rule else 3)
            if found is None:
                break
            rule.append(found[0])
            if found[2] == 0:
                break
        if not rule:
            return rules
        # how many of the leading conditions each row of the other part meets, by label
        met = F.lit(0)
        for k in range(len(rule), 0, -1):
            met = F.when(_all(rule[:k]) & (met == 0), F.lit(k)).otherwise(met)
        seen = {(r.met, r.y): r.n for r in rest.where("NOT grow").groupBy(met.alias("met"), "y").agg(F.count("*").alias("n")).collect()}
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = (sum(seen.get((m, y), 0) for m in range(k, len(rule) + 1)) for y in (0, 1))
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, n, k))
        best = max(worth, key=lambda w: (w[0], -w[3]))
        if best[1] < MIN_PRECISION * (best[1] + best[2]) or not best[1]:
            return rules
        rules.append(rule[: best[3]])
        rest = rest.where(~_all(rules[-1]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """False from the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def number_of_first_rule(rules: list[list[Condition]]) -> Column:
    """1 for the first rule that holds, and so on; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(~verdict([rules[k - 1]]), F.lit(k)).otherwise(out)
    return out
