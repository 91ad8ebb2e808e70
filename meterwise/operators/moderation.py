"""Moderation pipeline: text in, verdicts and ledger rows out.

Per request everything is bounded (at most 20 items are scored together), so
the per-request steps are array expressions on one row, or small groupBy's
keyed by request id. The only Python step is the pluggable scorer (M3),
which runs as an Arrow-batched ``mapInPandas`` over request batches.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.config import (BLOCK_THRESHOLD, CATEGORIES, CHARS_PER_UNIT, MAX_CHARS_PER_ITEM, MAX_ITEMS_PER_REQUEST, MAX_REASON_CHARS,
                              REVIEW_THRESHOLD, TOKEN_BUDGET_BASE, TOKEN_BUDGET_PER_ITEM)
from meterwise.functions.scalars import item_units, js_round, utf16_length, utf16_prefix

# The characters JavaScript's String.prototype.trim removes (white space and
# line terminators), as code points.
JS_SPACE_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                  0x205F, 0x3000, 0xFEFF)
JS_SPACE_CHARS = "".join(chr(c) for c in JS_SPACE_CODES)


def js_trim(c: Column) -> Column:
    """Trim a character set from both ends (no regex: a linear scan from each end)."""
    return F.trim(c, F.lit(JS_SPACE_CHARS))


# ------------------------------------------------------------------ F9 / F10
def item_array(text: Column) -> Column:
    """One item per non-empty trimmed line, in order (blank lines are dropped first)."""
    return F.filter(F.transform(F.split(text, "\n"), js_trim), lambda x: x != "")


def request_items(requests: DataFrame, text_col: str = "text", id_col: str = "request_id") -> DataFrame:
    """one row per item with its index counted after dropping blanks."""
    r = requests.select(id_col, F.posexplode(item_array(F.col(text_col))).alias("idx", "item"))
    return r.select(id_col, F.col("idx").cast("int").alias("idx"), "item")


def request_validation(requests: DataFrame, text_col: str = "text", id_col: str = "request_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """per request the first failing rule: empty, > 20 items, an item > 8,000 chars
    (the first such index), else ok; with item count and total units (and the columns ``keep``)."""
    # Item lengths are computed once per item (a separate projection, so the split and the
    # UTF-16 count are not re-evaluated by every expression below).
    lens = requests.select(id_col, *keep, F.transform(item_array(F.col(text_col)), lambda x: utf16_length(x)).alias("_lens"))
    return _judged(lens, id_col)


def _judged(lens: DataFrame, id_col: str) -> DataFrame:
    """F10 from the items' lengths (``_lens``)."""
    ln = F.col("_lens")
    first_long = F.array_position(F.transform(ln, lambda n: n > MAX_CHARS_PER_ITEM), True)
    n = F.size(ln)
    units = F.aggregate(ln, F.lit(0), lambda a, b: a + F.greatest(F.lit(1), F.ceil(b / F.lit(CHARS_PER_UNIT))).cast("int"))
    reason = (F.when(n == 0, "empty_input").when(n > MAX_ITEMS_PER_REQUEST, "too_many_items")
              .when(first_long > 0, "item_too_long").otherwise("ok"))
    return lens.select(
        *[c for c in lens.columns if c != "_lens"],
        n.cast("int").alias("n_items"),
        units.cast("int").alias("units"),
        reason.alias("validation"),
        F.when((n > 0) & (n <= MAX_ITEMS_PER_REQUEST) & (first_long > 0), (first_long - 1).cast("int")).alias("bad_index"),
    )


def body_items(body: Column) -> Column:
    """The items of a JSON request body: ``input`` is one string or an array of strings, taken
    as they are. NULL when the body is not such JSON, or any string or the array is empty."""
    value = F.try_variant_get(F.try_parse_json(body), "$.input", "variant")
    many = F.try_variant_get(value, "$", "array<variant>")
    kinds = F.transform(many, lambda e: F.schema_of_variant(e))
    items = (F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
             .when(F.forall(kinds, lambda k: F.coalesce(k == "STRING", F.lit(False))), F.transform(many, lambda e: F.try_variant_get(e, "$", "string"))))
    return F.when((F.size(items) > 0) & F.forall(items, lambda x: x != ""), items)


def body_validation(requests: DataFrame, body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    """F9 + F10 of the API form: ``invalid_input`` for a body ``body_items`` refuses (no items,
    no units), else as ``request_validation``, with the items as an array."""
    r = requests.select(id_col, body_items(F.col(body_col)).alias("items"))
    lens = r.select(id_col, "items", F.coalesce(F.transform("items", utf16_length), F.array().cast("array<int>")).alias("_lens"))
    judged = _judged(lens, id_col)
    return judged.select(id_col, "items", "n_items", "units",
                         F.when(F.col("items").isNull(), "invalid_input").otherwise(F.col("validation")).alias("validation"), "bad_index")


# ------------------------------------------------------------------ M1 / M2
def item_units_df(items: DataFrame) -> DataFrame:
    """M1: units per item = max(1, ceil(UTF-16 length / 2000))."""
    return items.select("request_id", "idx", utf16_length("item").alias("length"), item_units("item").alias("units"))


def request_batches(items: DataFrame, size: int = MAX_ITEMS_PER_REQUEST) -> DataFrame:
    """M2: consecutive items of a request packed into batches of at most ``size``, with the
    unit total and the token budget of one scoring call (bounded groups: <= size rows)."""
    b = items.withColumn("batch", F.floor(F.col("idx") / size).cast("int"))
    g = b.groupBy("request_id", "batch").agg(
        F.count(F.lit(1)).cast("int").alias("n_items"),
        F.sum(item_units("item")).cast("int").alias("units"),
        F.sort_array(F.collect_list(F.struct("idx", "item"))).alias("_items"),
    )
    return g.select("request_id", "batch", "n_items", "units",
                    (F.lit(TOKEN_BUDGET_BASE) + F.lit(TOKEN_BUDGET_PER_ITEM) * F.col("n_items")).cast("int").alias("max_tokens"),
                    F.col("_items.item").alias("items"))


# ------------------------------------------------------------------------ M3
# Fixed word lists of the default (offline) scorer; a real deployment passes its own scorer.
LEXICON = {
    "harassment": ("idiot", "stupid", "loser", "shut up"),
    "hate": ("vermin", "subhuman"),
    "sexual": ("nude", "explicit"),
    "violence": ("kill", "attack", "shoot"),
    "self_harm": ("suicide", "self-harm"),
    "illicit": ("weapon", "drugs", "hack"),
    "spam": ("buy now", "free money", "click here"),
}


#: What a scorer is: made once in every worker, then called with the items of one M2 batch and its
#: token budget; it returns the scores of each item in category order, and the tokens it used.
Scorer = Callable[[list[str], int], tuple[list[list[float]], int, int]]


def lexicon_scorer() -> Scorer:
    """Default scorer: 0.3 per lexicon hit per category, capped at 1 (deterministic, offline). It
    counts four characters as a token and 24 tokens an answer, within the budget."""
    words = [LEXICON[c] for c in CATEGORIES]

    def score(items: list[str], max_tokens: int) -> tuple[list[list[float]], int, int]:
        low = [x.lower() for x in items]
        scores = [[min(sum(x.count(w) for w in ws) * 0.3, 1.0) for ws in words] for x in low]
        return scores, sum(len(x) for x in items) // 4, min(max_tokens, 24 * len(items))

    return score


SCORED = ("request_id long, batch int, idx int, " + ", ".join(f"{c} double" for c in CATEGORIES)
          + ", n_items int, prompt_tokens int, completion_tokens int, failure string")


def score_batches(batches: DataFrame, scorer: Callable[[], Scorer] = lexicon_scorer, size: int = MAX_ITEMS_PER_REQUEST) -> DataFrame:
    """M3: the items of M2's batches (``request_batches``) scored by a pluggable scorer, one call a
    batch with the batch's token budget. A row an item; a batch whose call fails (or answers with another
    number of scores) has one row without ``idx`` that says why in ``failure``, and costs no other
    batch its answer. Tokens are the batch's, on its first row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        names = [f.split()[0] for f in SCORED.split(", ")]
        for frame in frames:
            rows = []
            for req, batch, budget, items in zip(frame["request_id"].tolist(), frame["batch"].tolist(), frame["max_tokens"].tolist(), frame["items"], strict=True):
                items = list(items)
                try:
                    scores, used_in, used_out = score(items, budget)
                    if len(scores) != len(items):
                        raise ValueError(f"{len(scores)} scores for {len(items)} items")
                except Exception as failure:  # noqa: BLE001  any failure is this batch's alone
                    rows.append((req, batch, None, *[None] * len(CATEGORIES), len(items), None, None, f"{type(failure).__name__}: {failure}"[:200]))
                    continue
                rows += [(req, batch, batch * size + k, *s, len(items), used_in if k == 0 else 0, used_out if k == 0 else 0, None) for k, s in enumerate(scores)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("idx", "n_items", "prompt_tokens", "completion_tokens"):
                out[c] = out[c].astype("Int32")
            for c in CATEGORIES:
                out[c] = out[c].astype("float64")
            yield out

    return batches.select("request_id", "batch", "max_tokens", "items").mapInPandas(run, SCORED)


def score_items(items: DataFrame, scorer: Callable[[], Scorer] = lexicon_scorer) -> DataFrame:
    """M3 as a table: every item's score in every category (none for the items of a failed batch)."""
    return score_batches(request_batches(items), scorer).filter("failure IS NULL").select("request_id", "idx", *CATEGORIES)


def score_answers_of(scored: DataFrame) -> DataFrame:
    """The scorer's output as raw answers, one JSON text per request in item order: what M4 checks,
    with the tokens of its batches. A request any batch of which failed has no answer
    (``upstream_status`` 500). A request's items are bounded by F10."""
    entry = F.struct(F.col("idx").alias("index"), F.struct(*CATEGORIES).alias("scores"), F.lit("").alias("reason"))
    done = F.col("failure").isNull()
    total = lambda c: F.sum(c).cast("int").alias(c)
    g = scored.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.when(done, F.struct("idx", entry.alias("e"))))).alias("_es"), F.max(F.when(~done, F.lit(500))).alias("_failed"),
        total("prompt_tokens"), total("completion_tokens"))
    return g.select("request_id", F.when(F.col("_failed").isNull(), F.to_json(F.struct(F.col("_es.e").alias("results")))).alias("answer"),
                    F.coalesce("_failed", F.lit(200)).alias("upstream_status"), "prompt_tokens", F.lit(0).alias("cached_tokens"), "completion_tokens",
                    F.lit(0).alias("reported_reasoning_tokens"), F.lit(0).alias("reasoning_chars"))


def scored_texts(requests: DataFrame, valid: DataFrame, scorer: Callable[[], Scorer] = lexicon_scorer) -> DataFrame:
    """F9, M2 and M3 of the requests in ``valid``: raw answers by request."""
    items = request_items(requests).join(valid.select("request_id"), "request_id", "left_semi")
    return score_answers_of(score_batches(request_batches(items), scorer))


def text_verdicts(requests: DataFrame, scorer: Callable[[], Scorer] = lexicon_scorer) -> DataFrame:
    """F10, F9, M2, M3, M4 and M5 as one plan: the verdicts of every valid request's texts."""
    valid = request_validation(requests).filter(F.col("validation") == "ok")
    results, _ = ingest_scores(scored_texts(requests, valid, scorer), valid)
    return verdicts(results)


# ------------------------------------------------------------------------ M4
_SCORES = ", ".join(f"{c}: double" for c in CATEGORIES)
ANSWER_SCHEMA = f"array<struct<results: array<struct<index: double, scores: struct<{_SCORES}>, reason: string>>>>"
_JSON_OPTS = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
              "allowNumericLeadingZeros": "false", "allowBackslashEscapingAnyCharacter": "false", "mode": "PERMISSIVE"}


def _parse(answer: Column) -> Column:
    # Wrapping in brackets makes trailing text (a second document, junk) a parse error.
    return F.from_json(F.concat(F.lit("["), answer, F.lit("]")), ANSWER_SCHEMA, _JSON_OPTS)


def check_answers(answers: DataFrame, validation: DataFrame) -> DataFrame:
    """M4's strict check of each request's answer, the way ``JSON.parse`` + type checks are:
    the parsed ``results``, their reasons' types and ``check``, the first of these that applies, or ok.
    An answer is rejected whole when it is not one JSON document, ``results`` is not an array of
    objects, an entry's index is not an integer in [0, n) or repeats, a score is missing, not a
    number or outside [0, 1], or there are fewer than n results. Answers that did not come
    (``upstream_status`` other than 200) have no row.
    """
    a = answers.filter(F.col("upstream_status") == 200).join(validation.select("request_id", "n_items"), "request_id", "inner")
    parsed = _parse(F.col("answer"))
    results = F.when(F.size("_parsed") == 1, F.get("_parsed", 0).getField("results"))
    # The variant parser is strict about NaN / Infinity (the bracket parse is strict about
    # trailing text); it also tells a string ``reason`` from a number or boolean (those
    # become '', as in the reference).
    rtypes = F.transform(F.try_variant_get("_variant", "$.results", "array<variant>"),
                         lambda e: F.schema_of_variant(F.try_variant_get(e, "$.reason", "variant")))
    p = (a.select("request_id", "n_items", parsed.alias("_parsed"), F.try_parse_json(F.col("answer")).alias("_variant"))
         .select("request_id", "n_items", results.alias("results"), F.when(F.col("_variant").isNotNull(), rtypes).alias("rtypes"),
                 ((F.size("_parsed") == 1) & F.col("_variant").isNotNull()).alias("_doc_ok")))
    n = F.col("n_items")

    def entry_ok_index(e):
        i = e.getField("index")
        return i.isNotNull() & (i == F.floor(i)) & (i >= 0) & (i < n)

    def entry_ok_scores(e):
        s = e.getField("scores")
        conds = [s.getField(c).isNotNull() & (s.getField(c) >= 0) & (s.getField(c) <= 1) for c in CATEGORIES]
        out = s.isNotNull()
        for c in conds:
            out = out & c
        return out

    res = F.col("results")
    idx_ok = F.forall(res, lambda e: entry_ok_index(e))
    sc_ok = F.forall(res, lambda e: entry_ok_scores(e))
    distinct = F.size(F.array_distinct(F.transform(res, lambda e: e.getField("index"))))
    reason = (F.when(~F.coalesce(F.col("_doc_ok"), F.lit(False)), "invalid_json")
              .when(res.isNull() | F.exists(res, lambda e: e.isNull()), "bad_results")
              .when(~idx_ok, "bad_index")
              .when(~sc_ok, "bad_score")
              .when(distinct < F.size(res), "duplicate_index")
              .when(F.size(res) < n, "missing_results")
              .otherwise("ok"))
    return p.withColumn("check", reason)


def ingest_scores(answers: DataFrame, validation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: (results, rejects) of the answers by ``check_answers``."""
    checked = check_answers(answers, validation)
    rejects = checked.filter(F.col("check") != "ok").select("request_id", F.col("check").alias("reason"))
    ok = checked.filter(F.col("check") == "ok")
    ex = ok.select("request_id", F.posexplode("results").alias("pos", "e"), "rtypes")
    rtype = F.element_at(F.col("rtypes"), F.col("pos") + 1)
    reason_txt = F.when(rtype.isNull() | (rtype == "STRING"), F.coalesce(F.col("e.reason"), F.lit(""))).otherwise(F.lit(""))
    out = ex.select(
        "request_id",
        F.col("e.index").cast("int").alias("idx"),
        *[F.col("e.scores").getField(c).alias(c) for c in CATEGORIES],
        reason_txt.alias("reason"),
    )
    return out, rejects


# ------------------------------------------------------------------ M5 - M7
def _r3(c: Column) -> Column:
    """``Math.round(s * 1000) / 1000`` on doubles."""
    return js_round(c * F.lit(1000.0)) / F.lit(1000.0)


def verdicts(results: DataFrame) -> DataFrame:
    """M5: scores rounded to 3 places first; top = max; block >= 0.8, review >= 0.4, else
    allow; ``flagged`` = categories >= 0.4 in category order; reason cut at 300 UTF-16 units."""
    r = results.select("request_id", "idx", *[_r3(F.col(c)).alias(c) for c in CATEGORIES], "reason")
    top = F.greatest(*[F.col(c) for c in CATEGORIES])
    flagged = F.filter(F.array(*[F.when(F.col(c) >= REVIEW_THRESHOLD, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return r.select(
        "request_id", "idx", *CATEGORIES,
        top.alias("top_score"),
        F.when(top >= BLOCK_THRESHOLD, "block").when(top >= REVIEW_THRESHOLD, "review").otherwise("allow").alias("verdict"),
        flagged.alias("flagged"),
        utf16_prefix(F.col("reason"), MAX_REASON_CHARS).alias("reason"),
    )


def top_category_cols() -> tuple[Column, Column]:
    """(category, score) of the highest category; ties go to the earlier category."""
    best_c, best_s = F.lit(CATEGORIES[0]), F.col(CATEGORIES[0])
    for c in CATEGORIES[1:]:
        better = F.col(c) > best_s
        best_c = F.when(better, F.lit(c)).otherwise(best_c)
        best_s = F.when(better, F.col(c)).otherwise(best_s)
    return best_c, best_s


def top_category(scored: DataFrame) -> DataFrame:
    """M6: highest category per item; ties go to the earlier category."""
    c, s = top_category_cols()
    return scored.select("request_id", "idx", c.alias("top_category"), s.alias("top_category_score"))


def _tie_up_table() -> list[bool]:
    """For k in 0..1000: is the double nearest k/1000 at or above k/1000 exactly?
    (decides ``toFixed(2)`` at a decimal tie)."""
    from decimal import Decimal

    return [Decimal(k / 1000) >= Decimal(k) / Decimal(1000) for k in range(1001)]


TIE_UP = _tie_up_table()


def fixed2(score: Column) -> Column:
    """``Number.prototype.toFixed(2)`` of a score already rounded to 3 places (0..1)."""
    k = F.round(score * 1000).cast("int")
    up = F.element_at(F.array(*[F.lit(b) for b in TIE_UP]), k + 1)
    r = F.pmod(k, F.lit(10))
    h = (F.floor(k / 10) + F.when((r > 5) | ((r == 5) & up), 1).otherwise(0)).cast("int")
    return F.concat(F.floor(h / 100).cast("int").cast("string"), F.lit("."), F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"))


def _label(c: Column) -> Column:
    return F.regexp_replace(c, "^([^_]*)_", "$1 ")


def verdict_detail(v: DataFrame) -> DataFrame:
    """M7: ``cat 0.90 · cat 0.50`` for flagged items, else ``highest: cat 0.12``; then the
    reason, when there is one."""
    j = v.withColumn("top_category", top_category_cols()[0])
    score_of = F.map_from_arrays(F.array(*[F.lit(c) for c in CATEGORIES]), F.array(*[F.col(c) for c in CATEGORIES]))
    parts = F.transform("flagged", lambda c: F.concat(_label(c), F.lit(" "), fixed2(F.element_at(score_of, c))))
    head = F.when(F.size("flagged") > 0, F.array_join(parts, " · ")).otherwise(
        F.concat(F.lit("highest: "), _label(F.col("top_category")), F.lit(" "), fixed2(F.element_at(score_of, F.col("top_category")))))
    detail = F.when(F.col("reason") != "", F.concat(head, F.lit(" · "), F.col("reason"))).otherwise(head)
    return j.select("request_id", "idx", "verdict", detail.alias("detail"))


# ------------------------------------------------------------------ M8 / M9
def reasoning_estimate(answers: DataFrame) -> DataFrame:
    """M8: reasoning tokens: the reported count when present, else the completion tokens
    split by reasoning vs answer text length (rounded half up), 0 when both are empty."""
    a = F.coalesce(utf16_length("answer"), F.lit(0)).cast("long")
    r = F.coalesce(F.col("reasoning_chars"), F.lit(0)).cast("long")
    comp = F.coalesce(F.col("completion_tokens"), F.lit(0)).cast("long")
    est = F.when(a + r > 0, js_round((comp * r) / (a + r))).otherwise(F.lit(0))
    return answers.select("request_id", F.coalesce(F.col("reported_reasoning_tokens").cast("long"), est.cast("long")).alias("reasoning_tokens"))
