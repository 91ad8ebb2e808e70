"""Pricing functions U1-U3 and the price lookups J6/J7.

The reference evaluates ``price_micros(service, units)`` and
``cost_micros(model, tokens...)`` as SQL functions with a table lookup per
call. Here the lookup tables (services, models, price history) are small
configuration tables with one row per service / model / price change, so
they are broadcast if small enough and joined once per batch of calls; the big side (the
ledger) is never shuffled for pricing. When every call uses one known service
or model (metering, the price lookup), the rates are a scalar subquery instead:
a join on a constant key would plan as a keyless nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_micros(calls: DataFrame, service_prices: DataFrame, service_col: str = "service", units_col: str = "units",
                 out: str = "price_micros") -> DataFrame:
    """``max(units, 0) * unit price`` of the service; unknown service = 0. Ignores ``active``."""
    sp = service_prices.select(F.col("service").alias("_svc"), F.col("unit_price_micros").alias("_unit_price"))
    j = calls.join(sp, calls[service_col] == sp["_svc"], "left")
    return j.withColumn(out, _price(F.col(units_col), F.col("_unit_price"))).drop("_svc", "_unit_price")


def _price(units: Column, unit_price: Column) -> Column:
    return F.coalesce(F.greatest(units.cast("long"), F.lit(0)) * unit_price, F.lit(0)).cast("long")


def price_micros_of(calls: DataFrame, service_prices: DataFrame, service: str, units_col: str = "units",
                    out: str = "price_micros") -> DataFrame:
    """U1 for calls that all use one known service: the unit price is a scalar subquery
    (the service is the key, so one row at most), not a join on a constant."""
    unit = service_prices.filter(F.col("service") == service).select("unit_price_micros").scalar()
    return calls.withColumn(out, _price(F.col(units_col), unit))


def _dec(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def price_micros_tokens(calls: DataFrame, model_rates: DataFrame, model_col: str = "model", out: str = "repriced_micros",
                        cols=("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")) -> DataFrame:
    """U2 (retired five-argument form): token price at per-model rates, rounded once."""
    i, c, o, r = cols
    mr = model_rates.withColumnRenamed("model", "_model")
    j = calls.join(mr, calls[model_col] == mr["_model"], "left")
    amount = (
        F.greatest(_dec(i) - _dec(c), F.lit(0)) * F.col("input_usd_per_mtok")
        + _dec(c) * F.col("cached_input_usd_per_mtok")
        + F.greatest(_dec(o) - _dec(r), F.lit(0)) * F.col("output_usd_per_mtok")
        + _dec(r) * F.col("reasoning_usd_per_mtok")
    )
    return j.withColumn(out, F.coalesce(F.round(amount, 0).cast("long"), F.lit(0).cast("long"))).drop(
        "_model", "input_usd_per_mtok", "cached_input_usd_per_mtok", "output_usd_per_mtok", "reasoning_usd_per_mtok")


def cost_micros(calls: DataFrame, model_costs: DataFrame, model_col: str = "model", out: str = "cost_micros_now",
                cols=("input_tokens", "cached_input_tokens", "output_tokens")) -> DataFrame:
    """What the model provider charges for the call's tokens, rounded half away from zero."""
    i, c, o = cols
    mc = model_costs.withColumnRenamed("model", "_model")
    j = calls.join(mc, calls[model_col] == mc["_model"], "left")
    cost = _cost(cols, F.col("input_usd_per_mtok"), F.col("cached_input_usd_per_mtok"), F.col("output_usd_per_mtok"))
    return j.withColumn(out, cost).drop("_model", "input_usd_per_mtok", "cached_input_usd_per_mtok", "output_usd_per_mtok")


def _cost(cols, r_in: Column, r_cached: Column, r_out: Column) -> Column:
    i, c, o = cols
    amount = F.greatest(_dec(i) - _dec(c), F.lit(0)) * r_in + _dec(c) * r_cached + _dec(o) * r_out
    return F.coalesce(F.round(amount, 0).cast("long"), F.lit(0).cast("long"))


def cost_micros_of(calls: DataFrame, model_costs: DataFrame, model: str, out: str = "cost_micros_now",
                   cols=("input_tokens", "cached_input_tokens", "output_tokens")) -> DataFrame:
    """U3 for calls that all use one known model: its three rates come from one scalar
    subquery (the model is the key, so one row at most), not a join on a constant."""
    r = (model_costs.filter(F.col("model") == model)
         .select(F.struct("input_usd_per_mtok", "cached_input_usd_per_mtok", "output_usd_per_mtok")).scalar())
    return calls.withColumn(out, _cost(cols, r.getField("input_usd_per_mtok"), r.getField("cached_input_usd_per_mtok"),
                                       r.getField("output_usd_per_mtok")))


def active_unit_price(service_prices: DataFrame, service: str) -> DataFrame:
    """The active unit price of one service (0 or 1 row)."""
    return service_prices.filter((F.col("service") == service) & F.col("active")).select("service", "unit_price_micros")


def price_lookup(accounts: DataFrame, balances: DataFrame, service_prices: DataFrame, service: str) -> DataFrame:
    """Per account its balance (0 when absent) and the service's active unit price (NULL when not sold)."""
    price = active_unit_price(service_prices, service).select("unit_price_micros").scalar()  # one row at most
    out = (accounts.select("account_id").join(balances.select("account_id", "balance_micros"), "account_id", "left")
           .withColumn("unit_price_micros", price))
    return out.select("account_id", F.coalesce("balance_micros", F.lit(0)).cast("long").alias("balance_micros"), "unit_price_micros")


def price_asof(calls: DataFrame, price_history: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """The unit price in force when each call was made (NULL before the first price).

    An interval index: the history, turned into ``[valid_from, valid_to)`` ranges on its own, is cut
    into the UTC days that the calls' times span (one row per service and day for a price that
    lasts), and calls meet it by (service, day). So a call is tested against the prices of its own
    day alone, and calls of one service go to as many join partitions as they have days. Only the
    first and last day of the calls reach the driver; a NULL time has no price."""
    day_of = lambda c: F.unix_date(F.to_date(c))
    span = calls.agg(F.min(ts_col).alias("a"), F.max(ts_col).alias("z")).select(day_of("a").alias("a"), day_of("z").alias("z")).first()
    first, last = (span.a, span.z) if span.a is not None else (0, 0)
    w = Window.partitionBy("service").orderBy("valid_from")
    ranges = price_history.select(
        F.col("service").alias("_svc"),
        F.col("unit_price_micros").alias("unit_price_asof"),
        F.col("valid_from").alias("_from"),
        F.lead("valid_from").over(w).alias("_to"),
    )
    a = F.greatest(day_of("_from"), F.lit(first))
    z = F.least(F.coalesce(day_of("_to"), F.lit(last)), F.lit(last))
    index = ranges.filter(a <= z).select("*", F.explode(F.sequence(a, z)).alias("_price_day"))
    dated = calls.withColumn("_day", day_of(ts_col))
    cond = ((dated["service"] == index["_svc"]) & (dated["_day"] == index["_price_day"]) & (dated[ts_col] >= index["_from"])
            & (index["_to"].isNull() | (dated[ts_col] < index["_to"])))
    return dated.join(index, cond, "left").drop("_svc", "_from", "_to", "_day", "_price_day")
