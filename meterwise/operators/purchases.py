"""Feeds and top-k lists: recent charges, purchases, ledger lines, top-ups, keys, cards.

Every "N newest per account" list is a ``row_number() <= N`` over a window
partitioned by account; Spark plans that as a window group limit, so each
map task keeps only N rows per account before the shuffle and a very large
account never reaches one task whole. Sort keys always end in a unique id
(then in every output column) so ties give the same rows every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.scalars import cents_text, json_text, money_text
from meterwise.operators.wallet import free_invoices, free_sessions


def top_n(df: DataFrame, partition: str, order: list[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows per ``partition`` in ``order`` (a window group limit)."""
    w = Window.partitionBy(partition).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return ranked.withColumnRenamed("_rn", rank_col) if rank_col else ranked.drop("_rn")


# ------------------------------------------------------------------------ T1
def recent_charges(charges: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest charges per customer (any status) with kind and card."""
    c = charges.select(
        "customer", "id", "amount", "amount_refunded", "refunded", "disputed", "status", "receipt_url",
        json_text("metadata", "kind").alias("kind"),
        F.get_json_object("payment_method_details", "$.card.brand").alias("card_brand"),
        F.get_json_object("payment_method_details", "$.card.last4").alias("card_last4"),
        "payment_method", "created",
    )
    return top_n(c, "customer", [F.desc("created"), F.asc("id")], n)


# ------------------------------------------------------------------------ E2
def all_purchases(accounts: DataFrame, charges: DataFrame, sessions: DataFrame, invoices: DataFrame, app_tag: str) -> DataFrame:
    """Every way credits arrive, per account: all charges, free sessions, free invoices."""
    ch = charges.select(
        "customer", "id", F.col("amount").alias("amount_cents"), F.col("amount_refunded").alias("refunded_cents"),
        F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("disputed", F.lit(False)).alias("disputed"),
        "receipt_url", F.coalesce(json_text("metadata", "kind") == "auto_topup", F.lit(False)).alias("auto"),
        "created", F.lit(0).alias("source_rank"),
    )
    cs = free_sessions(sessions).select(
        "customer", "id", F.coalesce(json_text("metadata", "credits_cents").cast("long"), F.lit(0)).alias("amount_cents"),
        F.lit(0).cast("long").alias("refunded_cents"), F.lit("succeeded").alias("status"), F.lit(False).alias("disputed"),
        F.lit(None).cast("string").alias("receipt_url"), F.lit(False).alias("auto"), "created", F.lit(1).alias("source_rank"),
    )
    inv = free_invoices(invoices, app_tag).select(
        "customer", "id", F.coalesce(json_text("metadata", "credits_cents").cast("long"), F.lit(0)).alias("amount_cents"),
        F.lit(0).cast("long").alias("refunded_cents"), F.lit("succeeded").alias("status"), F.lit(False).alias("disputed"),
        F.col("hosted_invoice_url").alias("receipt_url"), F.coalesce(json_text("metadata", "kind") == "auto_topup", F.lit(False)).alias("auto"),
        "created", F.lit(2).alias("source_rank"),
    )
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer")).filter(F.col("customer").isNotNull())
    return a.join(ch.unionByName(cs).unionByName(inv), "customer", "inner").drop("customer")


def purchases_top10(purchases: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest purchases per account; ties: charges, then sessions, then invoices."""
    return top_n(purchases, "account_id", [F.desc("created"), F.asc("source_rank"), F.asc("id")], n)


def purchase_feed(purchases: DataFrame) -> DataFrame:
    """status, title and detail lines of the purchase feed."""
    return purchases.select(
        "account_id", "id",
        F.when(F.col("disputed"), "error").otherwise("success").alias("status_line"),
        F.concat(cents_text("amount_cents"), F.when(F.col("auto"), F.lit(" auto top-up")).otherwise(F.lit(" of credits"))).alias("title"),
        F.when(F.col("disputed"), F.lit("Disputed: not counted"))
        .when(F.col("refunded_cents") > 0, F.concat(F.lit("Refunded "), cents_text("refunded_cents")))
        .alias("detail"),
    )


# ------------------------------------------------------------------- T3 / F6
def ledger_and_simulated(usage: DataFrame, simulated: DataFrame) -> DataFrame:
    """Ledger rows and simulated spend as one line stream (simulated: service ``simulated``)."""
    u = usage.select("account_id", "id", "service", "units", "status", "price_micros", "latency_ms", "created_at",
                     F.lit(False).alias("simulated"))
    s = simulated.select("account_id", "id", F.lit("simulated").alias("service"), F.lit(0).alias("units"),
                         F.lit(200).cast("short").alias("status"), F.col("amount_micros").alias("price_micros"),
                         F.lit(None).cast("int").alias("latency_ms"), "created_at", F.lit(True).alias("simulated"))
    return u.unionByName(s)


def recent_ledger(usage: DataFrame, simulated: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` newest ledger lines per account; ties: real calls first."""
    lines = ledger_and_simulated(usage, simulated)
    order = [F.desc("created_at"), F.asc("simulated"), F.asc("id"), F.asc("units"), F.asc("price_micros"),
             F.asc_nulls_first("latency_ms"), F.asc("status")]
    return top_n(lines, "account_id", order, n)


def ledger_lines(lines: DataFrame) -> DataFrame:
    """level, kind and message of each ledger line, in the dashboard's rule order."""
    sim, svc, st = F.col("simulated"), F.col("service"), F.col("status")
    lat = F.col("latency_ms")
    lat_txt = F.when(lat.isNotNull() & (lat != 0), F.concat(F.lit(" · "), lat.cast("string"), F.lit(" ms"))).otherwise(F.lit(""))
    units = F.col("units")
    return lines.select(
        "account_id", "id", "created_at",
        F.when(sim, "warn").when(st >= 400, "error").otherwise("info").alias("level"),
        F.when(sim, "simulated").when(svc != "moderate", "earlier").when(st >= 400, "failed").otherwise("charged").alias("kind"),
        F.when(sim, F.concat(F.lit("simulated usage · "), money_text("price_micros"), F.lit(" · no moderation behind it")))
        .when(svc != "moderate", F.concat(F.lit("earlier API call · "), money_text("price_micros")))
        .when(st >= 400, F.concat(F.lit("scoring failed · not charged"), lat_txt))
        .otherwise(F.concat(units.cast("string"), F.when(units == 1, F.lit(" unit · ")).otherwise(F.lit(" units · ")),
                            money_text("price_micros"), lat_txt))
        .alias("message"),
    )


# ------------------------------------------------------------------------ T4
def recent_topups(topups: DataFrame, n: int = 5) -> DataFrame:
    """T4: the ``n`` newest top-ups per account; the first is the "last top-up" line."""
    t = topups.select("account_id", "id", "amount_cents", "status", "error", "created_at")
    r = top_n(t, "account_id", [F.desc("created_at"), F.desc("id")], n, rank_col="rn")
    return r.withColumn("is_last", F.col("rn") == 1).drop("rn")


# ------------------------------------------------------------------- J3 / J4
def latest_card(accounts: DataFrame, charges: DataFrame) -> DataFrame:
    """Per account, the payment method of its newest succeeded charge that has one
    (over all charges; one hash aggregate, no sort)."""
    ok = charges.filter((F.col("status") == "succeeded") & F.col("payment_method").isNotNull())
    best = ok.groupBy("customer").agg(F.max_by("payment_method", F.struct("created", "id")).alias("payment_method"))
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer"))
    return a.join(best, "customer", "left").select("account_id", "payment_method")


def card_on_file(accounts: DataFrame, charges: DataFrame, n: int = 10) -> DataFrame:
    """Within the ``n`` newest charges (any status), the newest succeeded one with a payment
    method; its card is shown only when ``last4`` exists, brand defaulting to ``card``."""
    recent = recent_charges(charges, n).filter((F.col("status") == "succeeded") & F.col("payment_method").isNotNull())
    first = recent.groupBy("customer").agg(
        F.min_by(F.struct("card_brand", "card_last4", "id"), F.struct(-F.col("created"), "id")).alias("c"))
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer"))
    j = a.join(first, "customer", "left")
    has = F.col("c.card_last4").isNotNull()
    return j.select(
        "account_id",
        F.col("c.id").alias("charge_id"),
        F.when(has, F.coalesce(F.col("c.card_brand"), F.lit("card"))).alias("card_brand"),
        F.when(has, F.col("c.card_last4")).alias("card_last4"),
    )


# ------------------------------------------------------------------- F5 / F11
def active_keys(api_keys: DataFrame, account_id: int | None = None) -> DataFrame:
    """keys not revoked (optionally of one account), ranked newest first
    within the account (``newest_rank`` 1 is the newest; ties go to the larger id)."""
    k = api_keys.filter(F.col("revoked_at").isNull())
    if account_id is not None:
        k = k.filter(F.col("account_id") == account_id)
    newest = Window.partitionBy("account_id").orderBy(F.col("created_at").desc(), F.col("key_id").desc())
    return k.select("key_id", "account_id", "name", "prefix", "created_at", "last_used_at",
                    F.row_number().over(newest).alias("newest_rank"))


def active_price(prices: DataFrame, promotion_codes: DataFrame) -> DataFrame:
    """newest active price per lookup key and newest active promotion per code."""
    p = prices.filter(F.col("active")).groupBy(F.col("lookup_key").alias("key")).agg(
        F.max_by("id", F.struct("created", "id")).alias("id")).withColumn("kind", F.lit("price"))
    c = promotion_codes.filter(F.col("active")).groupBy(F.col("code").alias("key")).agg(
        F.max_by("id", F.struct("created", "id")).alias("id")).withColumn("kind", F.lit("promotion"))
    return p.unionByName(c)
