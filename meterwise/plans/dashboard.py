"""A10: the account dashboard for every account, as one plan.

The reference sends 12 reads for one account and merges them in code. Here everything a
dashboard shows is one union of tagged rows (account, tag, a struct of the tag's columns), each
already summed or cut to its top-N per account, folded into a row per account by one
aggregate: no join per part. The ledger (calls and simulated spend) and the purchases (all
charges, free sessions and invoices with their account) are each read once, narrow, and then
used twice: summed, and cut to their newest rows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.config import CHARS_PER_UNIT, DAILY_REQUEST_LIMIT, MICROS_PER_CENT
from meterwise.functions.scalars import face_value_micros, json_text
from meterwise.operators import purchases as PU
from meterwise.operators.pricing import active_unit_price
from meterwise.operators.usage import day_text
from meterwise.operators.wallet import free_invoices, free_sessions, is_settled
from meterwise.sources.fixtures import Fixtures
from meterwise.sources.tables import materialized

#: The newest keys shown; ``n_keys`` counts all live ones.
KEYS_SHOWN = 100


def _tagged(df: DataFrame, tag: str, *cols: Column | str) -> DataFrame:
    """(account_id, <tag>: struct)."""
    return df.select("account_id", F.struct(*cols).alias(tag))


def _ledger_parts(fx: Fixtures) -> list[DataFrame]:
    """Spend, the last 24 h and the daily series from one aggregate; the newest lines."""
    lines = materialized(PU.ledger_and_simulated(fx.usage_events, fx.simulated_spend), "dashboard-lines")
    since = lambda d: F.col("created_at") > F.lit(fx.p.as_of - d).cast("timestamp")
    real, micros = ~F.col("simulated"), F.col("price_micros")
    today = real & since(timedelta(hours=24))
    day = F.when(since(timedelta(days=30)), day_text("created_at")).alias("day")
    days = lines.groupBy("account_id", day).agg(
        F.count(F.when(real, 1)).cast("int").alias("requests"), F.coalesce(F.sum(F.when(real, F.col("units"))), F.lit(0)).cast("long").alias("units"),
        F.coalesce(F.sum(F.when(real, micros)), F.lit(0)).cast("long").alias("spent_micros"),
        F.coalesce(F.sum(F.when(~real, micros)), F.lit(0)).cast("long").alias("simulated_micros"),
        F.count(F.when(today, 1)).cast("int").alias("used"), F.min(F.when(today, F.col("created_at"))).alias("oldest"))
    order = [F.desc("created_at"), F.asc("simulated"), F.asc("id"), F.asc("units"), F.asc("price_micros"), F.asc_nulls_first("latency_ms"), F.asc("status")]
    newest = PU.top_n(lines, "account_id", order, 15, rank_col="rn")
    return [_tagged(days, "day", "day", "requests", "units", "spent_micros", "simulated_micros", "used", "oldest"),
            _tagged(newest, "line", "rn", "id", "service", "units", "status", "price_micros", "latency_ms", "created_at", "simulated")]


def _purchase_parts(fx: Fixtures) -> list[DataFrame]:
    """Credits, and the ten newest charges and ten newest free orders: the ten newest purchases
    and the charge with the card on file are among them."""
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    auto = F.coalesce(json_text("metadata", "kind") == "auto_topup", F.lit(False)).alias("auto")
    ch = fx.charges.select(
        "customer", "id", F.col("amount").alias("amount_cents"), F.col("amount_refunded").alias("refunded_cents"), F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("disputed", F.lit(False)).alias("disputed"), "receipt_url", auto, "created", F.lit(0).alias("source_rank"),
        F.when(is_settled(), (F.col("amount") - F.col("amount_refunded")) * MICROS_PER_CENT).alias("micros"), "payment_method",
        F.get_json_object("payment_method_details", "$.card.brand").alias("card_brand"), F.get_json_object("payment_method_details", "$.card.last4").alias("card_last4"))

    def free(orders: DataFrame, rank: int, receipt: Column, auto: Column) -> DataFrame:
        cents = F.coalesce(json_text("metadata", "credits_cents").cast("long"), F.lit(0))
        return orders.select(
            "customer", "id", cents.alias("amount_cents"), F.lit(0).cast("long").alias("refunded_cents"), F.lit("succeeded").alias("status"), F.lit(False).alias("disputed"),
            receipt.alias("receipt_url"), auto.alias("auto"), "created", F.lit(rank).alias("source_rank"), face_value_micros("metadata").alias("micros"),
            text.alias("payment_method"), text.alias("card_brand"), text.alias("card_last4"))

    bought = ch.unionByName(free(free_sessions(fx.checkout_sessions), 1, text, F.lit(False))).unionByName(
        free(free_invoices(fx.invoices, fx.p.app_tag), 2, F.col("hosted_invoice_url"), auto))
    a = fx.accounts.select("account_id", F.col("stripe_customer_id").alias("customer")).filter(F.col("customer").isNotNull())
    bought = materialized(a.join(bought, "customer").drop("customer"), "dashboard-purchases")
    credit = bought.groupBy("account_id").agg(F.coalesce(F.sum("micros"), none).cast("long").alias("purchased_micros"))
    w = Window.partitionBy("account_id", F.col("source_rank") > 0).orderBy(F.desc("created"), F.asc("source_rank"), F.asc("id"))
    newest = bought.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 10)
    return [_tagged(credit, "credit", "purchased_micros"),
            _tagged(newest, "purchase", (-F.col("created")).alias("newest"), "source_rank", "id", "amount_cents", "refunded_cents", "status", "disputed", "receipt_url", "auto",
                    "created", "payment_method", "card_brand", "card_last4")]


def dashboard(fx: Fixtures) -> DataFrame:
    """One nested row per account, whatever it has: a missing list is empty, a missing sum 0."""
    p = fx.p
    owner = _tagged(fx.accounts, "owner", F.col("stripe_customer_id").isNotNull().alias("customer"), "auto_topup_enabled", "auto_topup_threshold_micros",
                    "auto_topup_amount_cents", "auto_topup_error")
    topups = PU.top_n(fx.topups, "account_id", [F.desc("created_at"), F.desc("id")], 5, rank_col="rn")
    live = fx.api_keys.filter(F.col("revoked_at").isNull())
    keys = PU.top_n(live, "account_id", [F.desc("created_at"), F.desc("key_id")], KEYS_SHOWN, rank_col="rn")
    parts = [owner, *_ledger_parts(fx), *_purchase_parts(fx),
             _tagged(topups, "topup", "rn", "id", "amount_cents", "status", "error", "created_at"),
             _tagged(keys, "key", "rn", "key_id", "name", "prefix", "created_at", "last_used_at"),
             _tagged(live.groupBy("account_id").agg(F.count(F.lit(1)).cast("int").alias("n")), "key_count", "n")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    lists = [F.sort_array(F.collect_list(t)).alias(t) for t in ("day", "line", "purchase", "topup", "key")]
    one = [F.max(t).alias(t) for t in ("owner", "credit", "key_count")]
    d = rows.groupBy("account_id").agg(*one, *lists).filter("owner IS NOT NULL")

    def fields(c: str, names: list[str], keep=lambda x: F.lit(True)) -> Column:
        return F.transform(F.filter(c, keep), lambda x: F.struct(*[x[n].alias(n) for n in names]))

    def total(c: str, f: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x[f])

    bought, spent = F.coalesce("credit.purchased_micros", F.lit(0)).cast("long"), total("day", "spent_micros") + total("day", "simulated_micros")
    paid = F.get(F.filter("purchase", lambda x: (x["source_rank"] == 0) & (x["status"] == "succeeded") & x["payment_method"].isNotNull()), 0)
    used = total("day", "used").cast("int")
    price = active_unit_price(fx.service_prices, p.service).select("unit_price_micros").scalar()  # one row at most
    available = (F.col("owner.customer") & (bought > 0)) if p.free_mode else paid.isNotNull()
    return d.select(
        "account_id", F.struct(bought.alias("purchased_micros"), spent.alias("spent_micros"), (bought - spent).alias("balance_micros")).alias("wallet"),
        F.struct(F.coalesce(price, F.lit(0)).alias("unit_price_micros"), F.lit(CHARS_PER_UNIT).alias("chars_per_unit")).alias("pricing"),
        F.when(paid["card_last4"].isNotNull(), F.struct(F.coalesce(paid["card_brand"], F.lit("card")).alias("card_brand"), paid["card_last4"].alias("card_last4"))).alias("card"),
        F.slice(fields("purchase", ["id", "amount_cents", "refunded_cents", "status", "disputed", "receipt_url", "auto", "created"]), 1, 10).alias("purchases"),
        F.struct(available.alias("available"), F.col("owner.auto_topup_enabled").alias("enabled"),
                 F.round(F.col("owner.auto_topup_threshold_micros") / 10_000).cast("long").alias("threshold_cents"),
                 F.col("owner.auto_topup_amount_cents").alias("amount_cents"), F.col("owner.auto_topup_error").alias("error"),
                 fields("topup", ["id", "amount_cents", "status", "error", "created_at"]).alias("recent")).alias("auto_topup"),
        F.struct(F.lit(DAILY_REQUEST_LIMIT).alias("per_day"), used.alias("used"), F.greatest(F.lit(0), F.lit(DAILY_REQUEST_LIMIT) - used).alias("remaining"),
                 (F.array_min(F.transform("day", lambda x: x["oldest"])) + F.expr("INTERVAL 24 HOURS")).alias("next_slot_at")).alias("limit"),
        fields("key", ["key_id", "name", "prefix", "created_at", "last_used_at"]).alias("keys"), F.coalesce("key_count.n", F.lit(0)).alias("n_keys"),
        F.struct(fields("day", ["day", "requests", "units", "spent_micros", "simulated_micros"], lambda x: x["day"].isNotNull()).alias("daily"),
                 fields("line", ["id", "service", "units", "status", "price_micros", "latency_ms", "created_at", "simulated"]).alias("recent")).alias("usage"))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("-"))


def flat(d: DataFrame) -> DataFrame:
    """The dashboard with a column a field, and each entry of a list as one line of text (times in
    microseconds), so that it can be compared field by field."""
    lists = {"purchases": "purchases", "recent_topups": "auto_topup.recent", "keys": "keys", "daily": "usage.daily", "recent": "usage.recent"}

    def lines(path: str) -> Column:
        at = d.select(path).schema.fields[0].dataType.elementType
        value = lambda x, f: F.unix_micros(x[f.name]) if f.dataType.typeName() == "timestamp" else x[f.name]
        return F.transform(path, lambda x: F.concat_ws("|", *[_text(value(x, f)) for f in at.fields]))

    return d.select("account_id", "wallet.*", "pricing.*", "card.*", F.col("auto_topup.available").alias("available"), F.col("auto_topup.enabled").alias("enabled"),
                    F.col("auto_topup.threshold_cents").alias("threshold_cents"), F.col("auto_topup.amount_cents").alias("topup_cents"), F.col("auto_topup.error").alias("error"),
                    "limit.*", "n_keys", *[lines(path).alias(name) for name, path in lists.items()])
