"""Admission: may a request run, and what would it cost (P1-P5), plus the metering
step that turns admitted, scored requests into ledger rows (M9).

P2 judges every attempt against one snapshot (``as_of``), the way concurrent
requests each see the state before any of them is recorded. P4 replays the
attempts in time order, where a refused attempt leaves no ledger row; that
fold is cut where an account pauses for more than 24 h, and only what the
balance can refuse is folded in strict order.
"""

from __future__ import annotations

import calendar
from collections import deque
from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.config import DAILY_REQUEST_LIMIT, DEFAULT_RETRY_AFTER_S, MICROS_PER_CENT, PACK_CENTS
from meterwise.operators.moderation import Scorer, ingest_scores, lexicon_scorer, reasoning_estimate, scored_texts, verdicts
from meterwise.operators.pricing import active_unit_price, cost_micros_of, price_micros_of
from meterwise.operators.usage import window_counts
from meterwise.sources.lifecycle import ledger_append
from meterwise.sources.tables import materialized

# Fixed value: the header form that the service accepts.
BEARER = r"(?i)^Bearer\s+(\S+)$"


def _ts(dt: datetime) -> Column:
    return F.lit(dt).cast("timestamp")


def _epoch_ms(dt: datetime) -> int:
    return calendar.timegm(dt.timetuple()) * 1000 + dt.microsecond // 1000


def key_auth(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Bearer token from the Authorization header (scheme case-insensitive), SHA-256
    hex, matched against live keys. No match: NULL key and account."""
    token = F.regexp_extract("authorization", BEARER, 1)
    # Requests without a token get a key of their own that matches nothing: a NULL key would
    # send all of them to one task.
    h = F.when(token != "", F.sha2(token, 256)).otherwise(_unmatched())
    live = api_keys.filter(F.col("revoked_at").isNull()).select("key_hash", "key_id", "account_id")
    r = requests.select("request_id", h.alias("key_hash"))
    return r.join(live, "key_hash", "left").select("request_id", "key_id", "account_id")


def _unmatched() -> Column:
    return F.concat(F.lit("none:"), F.col("request_id").cast("string"))


def retry_after(next_slot: Column, as_of: datetime) -> Column:
    """Seconds until the oldest call ages out: max(1, ceil(ms / 1000)) with the slot at
    millisecond precision; 3600 when there is no slot."""
    slot_ms = F.floor(F.unix_micros(next_slot) / 1000)
    s = F.greatest(F.lit(1), F.ceil((slot_ms - F.lit(_epoch_ms(as_of))) / 1000))
    return F.coalesce(s, F.lit(DEFAULT_RETRY_AFTER_S)).cast("long")


def admission(requests: DataFrame, validation: DataFrame, auth: DataFrame, usage: DataFrame, balances: DataFrame,
              service_prices: DataFrame, service: str, as_of: datetime, limit: int = DAILY_REQUEST_LIMIT) -> DataFrame:
    """P2 (+P3): the answer to every attempt against the ``as_of`` snapshot, checks in the
    reference's order: 400 bad input, 401 no key, 503 no active price, 429 limit reached,
    402 balance below the quote, else 200."""
    price = active_unit_price(service_prices, service).select("unit_price_micros").scalar()  # one row at most
    # What is known per account is joined first, so the requests meet it once; those without an
    # account get a key of their own (see ``key_auth``).
    facts = window_counts(usage, as_of).join(balances.select("account_id", "balance_micros"), "account_id", "full")
    facts = facts.select(F.col("account_id").cast("string").alias("_account"), "used", "oldest_at", "balance_micros")
    j = (requests.select("request_id").join(validation.select("request_id", "validation", "units"), "request_id", "inner")
         .join(auth, "request_id", "left")
         .withColumn("_account", F.coalesce(F.col("account_id").cast("string"), _unmatched()))
         .join(facts, "_account", "left")
         .withColumn("unit_price_micros", price))
    quote = (F.col("units").cast("long") * F.col("unit_price_micros"))
    u = F.coalesce(F.col("used"), F.lit(0))
    bal = F.coalesce(F.col("balance_micros"), F.lit(0))
    status = (F.when(F.col("validation") != "ok", 400).when(F.col("key_id").isNull(), 401)
              .when(F.col("unit_price_micros").isNull(), 503).when(u >= limit, 429)
              .when(bal < quote, 402).otherwise(200))
    next_slot = F.col("oldest_at") + F.expr("INTERVAL 24 HOURS")
    return j.select(
        "request_id", "account_id", "key_id", status.alias("status_code"), "units", quote.alias("quote_micros"),
        F.when(status == 429, retry_after(next_slot, as_of)).alias("retry_after_s"),
    )


def quote(requests: DataFrame, validation: DataFrame, auth: DataFrame, balances: DataFrame, service_prices: DataFrame,
          service: str) -> DataFrame:
    """P5: units x price, whether the balance covers it, the balance after, and how many
    items each credit pack buys at this price."""
    price = active_unit_price(service_prices, service).select("unit_price_micros").scalar()  # one row at most
    j = (validation.filter(F.col("validation") == "ok").select("request_id", "units")
         .join(auth.filter(F.col("account_id").isNotNull()), "request_id", "inner")
         .join(balances.select("account_id", "balance_micros"), "account_id", "left")
         .withColumn("unit_price_micros", price).filter(F.col("unit_price_micros").isNotNull()))
    q = F.col("units").cast("long") * F.col("unit_price_micros")
    bal = F.coalesce(F.col("balance_micros"), F.lit(0)).cast("long")
    packs = [F.floor(F.lit(c * MICROS_PER_CENT) / F.col("unit_price_micros")).cast("long").alias(f"items_per_pack_{c}")
             for c in PACK_CENTS]
    return j.select("request_id", "account_id", "units", q.alias("quote_micros"), (bal >= q).alias("affordable"),
                    (bal - q).alias("balance_after_micros"), *packs)


# ---------------------------------------------------------------------------- P4
REPLAY_SCHEMA = ("request_id long, account_id long, at timestamp, status_code int, charged_micros long, "
                 "counted boolean, balance_after_micros long")
#: What the fold reads, in P4 and ST4 alike: attempts (``micros``: the quote), credits and calls made before.
FOLD_ROWS = "kind string, request_id long, account_id long, at timestamp, micros long, outcome string"
#: Order of rows of one instant.
KIND_RANK = {"opening": 0, "prior": 1, "credit": 2, "attempt": 3}
DAY_MICROS = 24 * 3600 * 1_000_000


class AccountFold:
    """What the answers to an account's next attempts depend on: its balance and the times
    (microseconds) of its last ``limit`` recorded calls. ``need`` is the balance at the start
    that would have kept every attempt so far from a 402."""

    __slots__ = ("balance", "recorded", "limit", "bound", "need")

    def __init__(self, limit: int, balance: int = 0, recorded=(), bound: bool = True):
        self.balance, self.recorded, self.limit, self.bound, self.need = balance, deque(recorded, maxlen=limit), limit, bound, -(1 << 62)

    def step(self, kind: str, t: int, micros: int, outcome: str) -> tuple[int, int, bool] | None:
        """Takes the next row; for an attempt (status, charged, counted). With ``bound`` off the
        balance refuses nothing."""
        if kind == "prior":
            self.recorded.append(t)
            return None
        if kind != "attempt":
            self.balance += micros
            return None
        if sum(1 for r in self.recorded if r > t - DAY_MICROS) >= self.limit:
            return 429, 0, False
        self.need = max(self.need, micros - self.balance)
        if self.bound and self.balance < micros:
            return 402, 0, False
        if outcome == "ok":
            self.balance -= micros
            self.recorded.append(t)
            return 200, micros, True
        if outcome == "invalid":
            self.recorded.append(t)
            return 502, 0, True
        return 502, 0, False  # upstream error: nothing recorded, nothing charged


def replay_input(admitted_snapshot: DataFrame, outcomes: DataFrame, requests: DataFrame, usage: DataFrame,
                 balances: DataFrame, as_of: datetime, limit: int = DAILY_REQUEST_LIMIT, credits: DataFrame | None = None) -> DataFrame:
    """Rows of the P4 / ST4 fold (FOLD_ROWS): every attempt whose answer depends on the account's
    history, the account's balance at the snapshot as a credit of that instant, the last ``limit``
    calls before it (older ones can never block), and ``credits`` (account_id, at, micros) that
    land later."""
    text = lambda v: F.lit(v).cast("string")
    att = (admitted_snapshot.filter(~F.col("status_code").isin(400, 401, 503))
           .join(requests.select("request_id", "at"), "request_id", "inner")
           .join(outcomes, "request_id", "left")
           .select(F.lit("attempt").alias("kind"), "request_id", "account_id", "at", F.col("quote_micros").alias("micros"),
                   F.coalesce("outcome", F.lit("upstream")).alias("outcome")))
    none = F.lit(None).cast("long").alias("request_id")
    w = Window.partitionBy("account_id").orderBy(F.desc("created_at"), F.desc("id"))
    prior = (usage.filter((F.col("created_at") > _ts(as_of - timedelta(hours=24))) & (F.col("created_at") <= _ts(as_of)))
             .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
             .select(F.lit("prior").alias("kind"), none, "account_id", F.col("created_at").alias("at"), F.lit(0).cast("long").alias("micros"), text(None).alias("outcome")))
    opening = balances.filter(F.col("balance_micros") != 0).select(
        F.lit("credit").alias("kind"), none, "account_id", _ts(as_of).alias("at"), F.col("balance_micros").cast("long").alias("micros"), text(None).alias("outcome"))
    if credits is not None:
        opening = opening.unionByName(credits.select(F.lit("credit").alias("kind"), none, "account_id", "at", F.col("micros").cast("long").alias("micros"),
                                                     text(None).alias("outcome")))
    history = prior.unionByName(opening).join(att.select("account_id").distinct(), "account_id", "left_semi")
    return att.unionByName(history.select(*att.columns))


def admission_replay(admitted_snapshot: DataFrame, outcomes: DataFrame, requests: DataFrame, usage: DataFrame,
                     balances: DataFrame, as_of: datetime, limit: int = DAILY_REQUEST_LIMIT, credits: DataFrame | None = None) -> DataFrame:
    """Replay every attempt in time order per account. A refused attempt writes no row,
    so it neither counts nor spends; an admitted one with a valid answer counts and spends
    its quote; an invalid answer counts but spends 0; an upstream error leaves no trace.

    ``admitted_snapshot`` is P2's output; rows refused for reasons that do not depend on
    the account's history (400, 401, 503) keep that answer and skip the fold.
    ``outcomes``: (request_id, outcome) with outcome in ok / invalid / upstream.
    """
    fixed = admitted_snapshot.filter(F.col("status_code").isin(400, 401, 503)).join(
        requests.select("request_id", "at"), "request_id", "inner").select(
        "request_id", "account_id", "at", "status_code", F.lit(0).cast("long").alias("charged_micros"),
        F.lit(False).alias("counted"), F.lit(None).cast("long").alias("balance_after_micros"))
    rows = replay_input(admitted_snapshot, outcomes, requests, usage, balances, as_of, limit, credits)
    return replay_fold(rows, limit).unionByName(fixed)


def segmented(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seg``, the first day of the account's run of consecutive days: two segments
    lie more than 24 h apart, so no call of one counts in the other. Runs are found on the days an
    account has, not on its rows."""
    day = F.floor(F.unix_micros("at") / F.lit(DAY_MICROS)).alias("_day")
    dated = rows.select("*", day)
    w = Window.partitionBy("account_id").orderBy("_day")
    days = dated.select("account_id", "_day").distinct()
    days = days.select("account_id", "_day", F.when(F.coalesce(F.col("_day") - F.lag("_day").over(w) > 1, F.lit(True)), F.col("_day")).alias("_first"))
    days = days.select("account_id", "_day", F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seg"))
    return dated.join(days, ["account_id", "_day"]).drop("_day")


def replay_fold(rows: DataFrame, limit: int = DAILY_REQUEST_LIMIT) -> DataFrame:
    """The fold over FOLD_ROWS, an account's segments side by side.

    Each segment is first folded as if the balance refused nothing, which yields its answers, what
    it adds to the balance and the balance it needs at its start. A running sum over the segments of an
    account gives the balance each one starts with; where that covers the need (a segment that never
    runs dry) the answers stand. From an account's first segment that does run dry on, its rows are
    folded again in order. Both passes are a secondary sort (hash-partition, sort) streamed through
    ``mapInPandas`` with the small state of one account; no group is held as a frame."""
    rows = materialized(segmented(rows), "replay-rows")
    free = materialized(_folded(rows, ["account_id", "seg"], limit, bound=False), "replay-segments")
    w = Window.partitionBy("account_id").orderBy("seg")
    starts = free.filter("need IS NOT NULL").select(
        "account_id", "seg", "need", F.coalesce(F.sum("balance_after_micros").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"))
    dry = starts.filter(F.col("need") > F.col("start")).groupBy("account_id").agg(F.min(F.struct("seg", "start")).alias("_dry"))
    dry = dry.select("account_id", F.col("_dry.seg").alias("dry_seg"), F.col("_dry.start").alias("dry_start"))
    stand = (free.filter("need IS NULL").join(starts.select("account_id", "seg", "start"), ["account_id", "seg"])
             .join(dry.select("account_id", "dry_seg"), "account_id", "left").filter("dry_seg IS NULL OR seg < dry_seg")
             .withColumn("balance_after_micros", F.col("balance_after_micros") + F.col("start")))
    again = rows.join(dry, "account_id").filter("seg >= dry_seg").select(*rows.columns)
    opening = dry.select(F.lit("opening").alias("kind"), F.lit(None).cast("long").alias("request_id"), "account_id", F.timestamp_micros(F.col("dry_seg") * DAY_MICROS).alias("at"),
                         F.col("dry_start").alias("micros"), F.lit(None).cast("string").alias("outcome"), F.col("dry_seg").alias("seg"))
    replayed = _folded(again.unionByName(opening), ["account_id"], limit, bound=True).filter("need IS NULL")
    cols = [c.split()[0] for c in REPLAY_SCHEMA.split(", ")]
    return stand.select(*cols).unionByName(replayed.select(*cols))


def _folded(rows: DataFrame, group: list[str], limit: int, bound: bool) -> DataFrame:
    """REPLAY_SCHEMA, seg and need: a row an attempt, and per group one without request whose
    ``balance_after_micros`` is what the group adds to the balance and ``need`` what it needs."""
    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])[F.col("kind")].alias("_rank")
    ordered = rows.select("*", rank).repartition(*group).sortWithinPartitions(*group, "at", "_rank", "request_id")
    return ordered.drop("_rank").mapInPandas(_replay_partition(len(group), limit, bound), REPLAY_SCHEMA + ", seg long, need long")


def _replay_partition(n_keys: int, limit: int, bound: bool):
    """The fold over one sorted partition. Columns are read once per Arrow batch into plain
    lists (times as integer microseconds), so a row costs a few list reads and compares."""
    cols = ["request_id", "account_id", "at", "status_code", "charged_micros", "counted", "balance_after_micros", "seg", "need"]

    def frame(rows):
        out = pd.DataFrame(rows, columns=cols)
        out["at"] = pd.to_datetime(out["at"], unit="us")
        out["request_id"], out["need"] = out["request_id"].astype("Int64"), out["need"].astype("Int64")
        return out

    def run(batches):
        cur, fold, rows = None, None, []
        for pdf in batches:
            accounts, segs = pdf["account_id"].tolist(), pdf["seg"].tolist()
            times = pdf["at"].astype("datetime64[us]").astype("int64").tolist()
            for req, account, seg, kind, t, micros, outcome in zip(pdf["request_id"].tolist(), accounts, segs, pdf["kind"].tolist(), times,
                                                                   pdf["micros"].tolist(), pdf["outcome"].tolist(), strict=True):
                key = (account, seg)[:n_keys]
                if key != cur:
                    if cur is not None:
                        rows.append((None, cur[0], None, 0, 0, False, fold.balance, cur[-1], fold.need))
                    cur, fold = key, AccountFold(limit, bound=bound)
                answer = fold.step(kind, t, micros, outcome)
                if answer is not None:
                    rows.append((int(req), account, t, *answer, fold.balance, seg, None))
            yield frame(rows)
            rows = []
        if cur is not None:
            yield frame([(None, cur[0], None, 0, 0, False, fold.balance, cur[-1], fold.need)])

    return run


# ---------------------------------------------------------------------------- M9
def answer_outcomes(answers: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per answered request: ok / invalid (failed the strict check) / upstream (no answer)."""
    rj = rejects.select("request_id", F.lit(True).alias("_rejected"))
    j = answers.select("request_id", "upstream_status").join(rj, "request_id", "left")
    out = (F.when(F.col("upstream_status") != 200, "upstream").when(F.col("_rejected"), "invalid").otherwise("ok"))
    return j.select("request_id", out.alias("outcome"))


def answer_outcomes_of(checked: DataFrame) -> DataFrame:
    """ok / invalid of the answers that came (M4's check); an attempt without one is upstream."""
    return checked.select("request_id", F.when(F.col("check") == "ok", "ok").otherwise("invalid").alias("outcome"))


def metering(admitted: DataFrame, answers: DataFrame, rejects: DataFrame, reasoning: DataFrame, requests: DataFrame,
             service_prices: DataFrame, model_costs: DataFrame, service: str, model: str) -> DataFrame:
    """M9: ledger rows for admitted requests. Valid answer: its units, status 200; invalid
    answer: 0 units, status 502; upstream error: no row. Missing usage counts 0 tokens;
    price by U1, cost by U3."""
    a = admitted.filter(F.col("status_code") == 200).select("request_id", "account_id", "key_id", "units")
    ans = answers.filter(F.col("upstream_status") == 200)
    j = (a.join(ans, "request_id", "inner")
         .join(rejects.select("request_id", F.lit(True).alias("_rejected")), "request_id", "left")
         .join(reasoning, "request_id", "left")
         .join(requests.select("request_id", "at"), "request_id", "inner"))
    bad = F.coalesce(F.col("_rejected"), F.lit(False))
    rows = j.select(
        F.col("request_id").alias("id"), "account_id", F.col("key_id").alias("api_key_id"), F.lit(service).alias("service"),
        F.when(bad, 0).otherwise(F.col("units")).cast("int").alias("units"), F.lit(model).alias("model"),
        F.coalesce("prompt_tokens", F.lit(0)).cast("int").alias("input_tokens"),
        F.coalesce("cached_tokens", F.lit(0)).cast("int").alias("cached_input_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).cast("int").alias("output_tokens"),
        F.coalesce("reasoning_tokens", F.lit(0)).cast("int").alias("reasoning_tokens"),
        F.when(bad, 502).otherwise(200).cast("short").alias("status"),
        F.lit(None).cast("int").alias("latency_ms"),
        F.col("at").alias("created_at"),
    )
    rows = price_micros_of(rows, service_prices, service, out="price_micros")
    rows = cost_micros_of(rows, model_costs, model, out="cost_micros")
    return rows.select("id", "account_id", "api_key_id", "service", "units", "model", "input_tokens", "cached_input_tokens",
                       "output_tokens", "reasoning_tokens", "price_micros", "cost_micros", "status", "latency_ms", "created_at")


def text_to_ledger(requests: DataFrame, validation: DataFrame, api_keys: DataFrame, ledger: DataFrame, balances: DataFrame, service_prices: DataFrame,
                   model_costs: DataFrame, service: str, model: str, as_of: datetime, scorer: Callable[[], Scorer] = lexicon_scorer) -> tuple[DataFrame, DataFrame]:
    """The path of a call from its text to the ledger: P1 and P2 admit, the items of admitted requests
    only are packed (M2) and scored (M3), answers are checked (M4) and judged (M5), and what is
    due is metered (M9) and appended to the ledger by request id (S4). Returns (verdicts, new rows).
    ``requests``: request_id, authorization, text, at; ``validation``: F10 of them."""
    admitted = materialized(admission(requests, validation, key_auth(requests, api_keys), ledger, balances, service_prices, service, as_of)
                            .filter(F.col("status_code") == 200), "admitted")
    valid = validation.join(admitted.select("request_id"), "request_id", "left_semi")
    answers = materialized(scored_texts(requests, valid, scorer), "answers")
    results, rejects = ingest_scores(answers, valid)
    rows = metering(admitted, answers, rejects, reasoning_estimate(answers), requests, service_prices, model_costs, service, model)
    return verdicts(results), ledger_append(ledger, rows)
