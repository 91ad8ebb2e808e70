"""Usage reports: daily series, limits, rolling windows, rate impact, margins.

Every report is for all accounts at once. Time windows are half-open the
way the reference writes them: ``created_at > as_of - interval`` is strict,
and so is the rolling 24 h rule, which is evaluated on integer microseconds
because Spark's interval frames are inclusive at both ends.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.config import DAILY_REQUEST_LIMIT, MICROS_24H
from meterwise.operators.pricing import price_micros_tokens

#: Granularities of which each lies within the one before it (weeks lie in no month).
NESTED = ("year", "quarter", "month", "day", "hour")


def _ts(dt: datetime) -> Column:
    return F.lit(dt).cast("timestamp")


def _since(df: DataFrame, as_of: datetime, delta: timedelta, ts_col: str = "created_at") -> DataFrame:
    return df.filter(F.col(ts_col) > _ts(as_of - delta))


def day_text(ts: str | Column) -> Column:
    return F.date_format(F.date_trunc("day", F.col(ts) if isinstance(ts, str) else ts), "yyyy-MM-dd")


def daily_usage(usage: DataFrame, as_of: datetime) -> DataFrame:
    """A1: per account and UTC day in the last 30 days: requests, units, spend."""
    u = _since(usage, as_of, timedelta(days=30))
    return u.groupBy("account_id", day_text("created_at").alias("day")).agg(
        F.count(F.lit(1)).cast("int").alias("requests"),
        F.sum("units").cast("long").alias("units"),
        F.sum("price_micros").cast("long").alias("spent_micros"),
    )


def daily_simulated(simulated: DataFrame, as_of: datetime) -> DataFrame:
    """A2: per account and UTC day in the last 30 days: simulated spend."""
    s = _since(simulated, as_of, timedelta(days=30))
    return s.groupBy("account_id", day_text("created_at").alias("day")).agg(F.sum("amount_micros").cast("long").alias("spent_micros"))


def merge_daily(real: DataFrame, simulated: DataFrame, keys=("account_id", "day")) -> DataFrame:
    """Full outer merge of two daily series on their keys; a missing side counts 0."""
    s = simulated.withColumnRenamed("spent_micros", "simulated_micros")
    m = real.join(s, list(keys), "full")
    z = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return m.select(*keys, z("requests", "int"), z("units", "long"), z("spent_micros", "long"), z("simulated_micros", "long"))


def daily_merged(usage: DataFrame, simulated: DataFrame, as_of: datetime) -> DataFrame:
    """A3: real and simulated spend side by side, per account and day."""
    return merge_daily(daily_usage(usage, as_of), daily_simulated(simulated, as_of))


def daily_totals(usage: DataFrame, simulated: DataFrame, as_of: datetime) -> DataFrame:
    """J11 on the whole service: one row per day with both series."""
    u = _since(usage, as_of, timedelta(days=30)).groupBy(day_text("created_at").alias("day")).agg(
        F.count(F.lit(1)).cast("int").alias("requests"), F.sum("units").cast("long").alias("units"),
        F.sum("price_micros").cast("long").alias("spent_micros"))
    s = _since(simulated, as_of, timedelta(days=30)).groupBy(day_text("created_at").alias("day")).agg(
        F.sum("amount_micros").cast("long").alias("spent_micros"))
    return merge_daily(u, s, keys=("day",))


def window_counts(usage: DataFrame, as_of: datetime) -> DataFrame:
    """Per account: calls in the 24 h before ``as_of`` (strict) and the oldest of them."""
    u = _since(usage, as_of, timedelta(hours=24))
    return u.groupBy("account_id").agg(F.count(F.lit(1)).cast("int").alias("used"), F.min("created_at").alias("oldest_at"))


def limit_status(accounts: DataFrame, usage: DataFrame, as_of: datetime, limit: int = DAILY_REQUEST_LIMIT) -> DataFrame:
    """A4: per account: used in 24 h, remaining = max(0, limit - used), next slot = oldest + 24 h."""
    c = accounts.select("account_id").join(window_counts(usage, as_of), "account_id", "left")
    used = F.coalesce(F.col("used"), F.lit(0))
    return c.select(
        "account_id",
        used.cast("int").alias("used"),
        F.greatest(F.lit(0), F.lit(limit) - used).cast("int").alias("remaining"),
        (F.col("oldest_at") + F.expr("INTERVAL 24 HOURS")).alias("next_slot_at"),
    )


def key_usage_24h(api_keys: DataFrame, usage: DataFrame, as_of: datetime) -> DataFrame:
    """For each live key, its account's calls in the last 24 h (0 / NULL when none)."""
    k = api_keys.filter(F.col("revoked_at").isNull()).select("key_id", "account_id")
    j = k.join(window_counts(usage, as_of), "account_id", "left")
    return j.select(
        "key_id", "account_id",
        F.coalesce(F.col("used"), F.lit(0)).cast("int").alias("used_24h"),
        "oldest_at",
        (F.col("oldest_at") + F.expr("INTERVAL 24 HOURS")).alias("next_slot_at"),
    )


def kpi_30d(usage: DataFrame, simulated: DataFrame, as_of: datetime) -> DataFrame:
    """A5: per account over 30 days: spend incl. simulated, simulated only, items checked."""
    d = daily_merged(usage, simulated, as_of)
    return d.groupBy("account_id").agg(
        (F.sum("spent_micros") + F.sum("simulated_micros")).cast("long").alias("spend_micros"),
        F.sum("simulated_micros").cast("long").alias("simulated_micros"),
        F.sum("units").cast("long").alias("items"),
    )


def rate_impact_30d(usage: DataFrame, model_rates: DataFrame, as_of: datetime) -> DataFrame:
    """Per account and model over 30 days: counts, token sums, charged, cost, and the same
    tokens repriced at the given rates. The formula is linear, so it runs on the sums (one
    rounding per group), after aggregation."""
    u = _since(usage, as_of, timedelta(days=30))
    g = u.groupBy("account_id", "model").agg(
        F.count(F.lit(1)).cast("int").alias("requests"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("cached_input_tokens").cast("long").alias("cached_input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum("reasoning_tokens").cast("long").alias("reasoning_tokens"),
        F.sum("price_micros").cast("long").alias("charged_micros"),
        F.sum("cost_micros").cast("long").alias("cost_micros"),
    )
    return price_micros_tokens(g, model_rates)


def margin(usage: DataFrame) -> DataFrame:
    """Revenue, cost and margin % per account, model and day; NULL margin when revenue <= 0."""
    g = usage.groupBy("account_id", "model", day_text("created_at").alias("day")).agg(
        F.sum("price_micros").cast("long").alias("revenue_micros"), F.sum("cost_micros").cast("long").alias("cost_micros"))
    rev, cost = F.col("revenue_micros"), F.col("cost_micros")
    return g.withColumn("margin_pct", F.when(rev > 0, (rev - cost).cast("double") / rev.cast("double") * 100.0))


SERIES = (("spend", "micros", "price_micros"), ("items", "units", "units"), ("latency", "ms", "latency_ms"), ("tokens", None, "tokens"))


def ledger_series(usage: DataFrame) -> DataFrame:
    """A8's series of the ledger (account_id, series_id, unit, total). The ledger is summed per account
    first; only the four sums of an account are then turned into rows. Tokens carry no unit.
    Values are whole numbers (money in micros), so totals are exact in any order."""
    tokens = (F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    sums = usage.select("account_id", "price_micros", "units", "latency_ms", tokens).groupBy("account_id").agg(
        *[F.sum(c).cast("long").alias(c) for _, _, c in SERIES])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("series_id"), F.lit(u).cast("string").alias("unit"), F.col(c).alias("total")) for n, u, c in SERIES]))
    return sums.select("account_id", rows.alias("s")).select("account_id", "s.*")


def series_totals(sums: DataFrame) -> DataFrame:
    """Totals per unit of ``series_sums``, never across units (no unit, NULL or empty, is one
    group), with the number of series in each unit group and a flag when an account mixes units."""
    per_unit = sums.groupBy("account_id", "unit").agg(F.sum("total").alias("total"), F.count(F.lit(1)).cast("int").alias("series"))
    units = F.count(F.lit(1)).over(Window.partitionBy("account_id"))
    return per_unit.withColumn("mixed_units", units > 1)


def series_sums(series: DataFrame, value: str = "value") -> DataFrame:
    """The total of each series of an account (an empty unit counts as none)."""
    return series.withColumn("unit", F.nullif("unit", F.lit(""))).groupBy("account_id", "unit", "series_id").agg(
        F.sum(value).alias("total"))


def usage_rollup(usage: DataFrame, granularities=("hour", "day", "month")) -> DataFrame:
    """The same measures per account at several time granularities, hours and longer. The ledger
    is shuffled by account and the longest granularity and sorted once there, with running sums per
    granularity: the last call of an hour, of a day and so on gives its row. So a task holds its
    calls once, in a sort that spills, in place of hash tables of the hours and of a copy per granularity."""
    nested = [g for g in NESTED if g in granularities]
    out = usage.select("account_id", "units", "price_micros", *[F.date_trunc(g, "created_at").alias(f"_{g}") for g in granularities])
    for g in (*nested, *(g for g in granularities if g not in nested)):
        own, shorter = (nested[: nested.index(g) + 1], nested[nested.index(g) + 1 :]) if g in nested else ([g], [])
        w = Window.partitionBy("account_id", *[f"_{x}" for x in own]).orderBy(*[f"_{x}" for x in shorter], "price_micros")
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        row = F.struct(F.lit(g).alias("granularity"), F.col(f"_{g}").alias("bucket"), F.count(F.lit(1)).over(run).cast("int").alias("requests"),
                       F.sum("units").over(run).cast("long").alias("units"), F.sum("price_micros").over(run).cast("long").alias("spent_micros"))
        out = out.select("*", F.when(F.lead(F.lit(True)).over(w).isNull(), row).alias(f"_row_{g}"))
    rows = out.select("account_id", F.explode(F.array(*[F.col(f"_row_{g}") for g in granularities])).alias("r"))
    return rows.filter("r IS NOT NULL").select("account_id", "r.*")


def rolling_24h(usage: DataFrame) -> DataFrame:
    """For every ledger row, the account's rows in ``(ts - 24h, ts]`` and its next slot
    (oldest of them + 24 h).

    Partitioned by (account, UTC day), not by account: each day also receives a copy of the
    previous day's rows shifted by +24 h, and a shifted row is inside the window exactly
    when its shifted time is after ``ts``. A busy account is therefore cut into day-sized
    window partitions (each row is shuffled twice), never its whole history in one task.
    """
    day_us = F.lit(MICROS_24H)
    us = F.unix_micros("created_at")
    cur = usage.select("id", "account_id", "created_at", us.alias("_us"), F.floor(us / day_us).alias("_day"), F.lit(0).alias("_sh"))
    prev = usage.select(F.lit(None).cast("long").alias("id"), "account_id", F.lit(None).cast("timestamp").alias("created_at"),
                        (us + day_us).alias("_us"), (F.floor(us / day_us) + 1).alias("_day"), F.lit(1).alias("_sh"))
    u = cur.unionByName(prev)
    part = Window.partitionBy("account_id", "_day")
    run = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    after = part.orderBy("_us").rangeBetween(1, Window.unboundedFollowing)
    sh = F.col("_sh")
    used = F.sum(1 - sh).over(run) + F.sum(sh).over(part) - F.sum(sh).over(run)
    oldest = F.coalesce(F.min(F.when(sh == 1, F.col("_us"))).over(after) - day_us, F.min(F.when(sh == 0, F.col("_us"))).over(part))
    out = u.select("id", "account_id", "created_at", "_sh", used.cast("int").alias("used_24h"), oldest.alias("_oldest"))
    return out.filter(F.col("_sh") == 0).select(
        "id", "account_id", "created_at", "used_24h",
        (F.timestamp_micros("_oldest") + F.expr("INTERVAL 24 HOURS")).alias("slot_at"))


def wallet_entries(accounts: DataFrame, charges: DataFrame, sessions: DataFrame, invoices: DataFrame,
                   usage: DataFrame, simulated: DataFrame, app_tag: str) -> DataFrame:
    """Credits (+) and debits (-) per account as one time-ordered entry stream."""
    from meterwise.operators.wallet import purchase_entries

    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer")).filter(F.col("customer").isNotNull())
    p = purchase_entries(charges, sessions, invoices, app_tag)
    credits = p.join(a, "customer", "inner").select(
        "account_id", F.col("id").alias("entry_id"), F.timestamp_seconds("created").alias("entry_at"),
        F.col("micros").alias("delta_micros"), F.lit(0).alias("entry_rank"))
    debits = usage.select("account_id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("entry_id"), F.col("created_at").alias("entry_at"),
                          (-F.col("price_micros")).alias("delta_micros"), F.lit(1).alias("entry_rank"))
    sims = simulated.select("account_id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("entry_id"), F.col("created_at").alias("entry_at"),
                            (-F.col("amount_micros")).alias("delta_micros"), F.lit(2).alias("entry_rank"))
    return credits.unionByName(debits).unionByName(sims)


def running_balance(entries: DataFrame) -> DataFrame:
    """The balance after every entry, in (time, credit-first, id) order.

    A distributed prefix sum: the running sum inside each (account, UTC day) plus the
    account's total of all earlier days (a window over one row per account and day).
    A busy account's history is split into day-sized sorts instead of one. A day's total is the
    running sum of its last entry, so both come from one exchange of the entries.
    """
    day = F.floor(F.unix_micros("entry_at") / F.lit(MICROS_24H)).alias("_day")
    w = Window.partitionBy("account_id", "_day").orderBy("entry_at", "entry_rank", "entry_id", "delta_micros")
    within = entries.select("*", day).select(
        "account_id", "_day", "entry_id", "entry_at", "delta_micros", F.sum("delta_micros").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_run"),
        F.lead(F.lit(True)).over(w).alias("_more"))
    totals = within.filter("_more IS NULL").select("account_id", "_day", F.col("_run").alias("_tot"))
    before = Window.partitionBy("account_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("account_id", "_day", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_offset"))
    j = within.drop("_more").join(offsets, ["account_id", "_day"], "inner")
    return j.select("account_id", "entry_id", "entry_at", "delta_micros", (F.col("_run") + F.col("_offset")).cast("long").alias("balance_micros"))
