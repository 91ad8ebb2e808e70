"""The wallet: balance = purchases - spend, derived on every read, never stored.

Plan shape (for any number of accounts): each credit source is filtered and
pre-aggregated by customer (partial aggregation before the shuffle), the
three are unioned and summed once per customer, mapped to accounts with one
join, and the ledger side is summed per account (again partial aggregation
first). A hot account therefore costs one pre-aggregated row per map task,
not its raw rows, at every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.config import MICROS_PER_CENT
from meterwise.functions.scalars import face_value_micros, json_text


# ---------------------------------------------------------------- filters F1-F4
def is_settled() -> Column:
    """F1's rule on a charge. A NULL is not true: same three-valued rule as SQL WHERE."""
    return (F.col("status") == "succeeded") & F.col("paid") & ~F.col("disputed") & (F.col("currency") == "usd")


def settled_charges(charges: DataFrame) -> DataFrame:
    """succeeded, paid, not disputed, in USD. NULL ``paid``/``disputed`` drop the row."""
    return charges.filter(is_settled())


def free_sessions(sessions: DataFrame) -> DataFrame:
    """completed $0 checkout sessions in payment mode (no app-tag filter)."""
    return sessions.filter(
        (F.col("mode") == "payment")
        & (F.col("status") == "complete")
        & F.col("payment_status").isin("paid", "no_payment_required")
        & (F.col("amount_total") == 0)
    )


def free_invoices(invoices: DataFrame, app_tag: str) -> DataFrame:
    """paid $0 invoices carrying this app's tag (the only tag filter)."""
    return invoices.filter((F.col("status") == "paid") & (F.col("total") == 0) & (json_text("metadata", "app") == app_tag))


def face_values(sessions: DataFrame, invoices: DataFrame) -> DataFrame:
    """face value in micros of every free-order candidate (sessions and invoices)."""
    cols = ["id", "customer", face_value_micros("metadata").alias("face_micros")]
    return sessions.select(*cols).unionByName(invoices.select(*cols))


# ------------------------------------------------------------ purchase entries
def purchase_entries(charges: DataFrame, sessions: DataFrame, invoices: DataFrame, app_tag: str) -> DataFrame:
    """Every credit, one row each: (customer, source, object id, micros, created)."""
    ch = settled_charges(charges).select(
        "customer", F.lit("charge").alias("source"), "id",
        ((F.col("amount") - F.col("amount_refunded")) * MICROS_PER_CENT).alias("micros"), "created",
    )
    cs = free_sessions(sessions).select("customer", F.lit("session").alias("source"), "id", face_value_micros("metadata").alias("micros"), "created")
    inv = free_invoices(invoices, app_tag).select("customer", F.lit("invoice").alias("source"), "id", face_value_micros("metadata").alias("micros"), "created")
    return ch.unionByName(cs).unionByName(inv)


def _per_account(accounts: DataFrame, by_customer: DataFrame) -> DataFrame:
    """Inner equi-join on customer id; accounts without a customer drop out."""
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer")).filter(F.col("customer").isNotNull())
    return a.join(by_customer, "customer", "inner").drop("customer")


def _sum_by_customer(entries: DataFrame) -> DataFrame:
    return entries.groupBy("customer").agg(F.sum("micros").cast("long").alias("micros"))


def purchased_charges(accounts: DataFrame, charges: DataFrame) -> DataFrame:
    """Per account, sum of (amount - refunded) * 10,000 over settled charges."""
    ch = settled_charges(charges).select("customer", ((F.col("amount") - F.col("amount_refunded")) * MICROS_PER_CENT).alias("micros"))
    return _per_account(accounts, _sum_by_customer(ch)).groupBy("account_id").agg(F.sum("micros").cast("long").alias("micros"))


def purchased_sessions(accounts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per account, face value of free checkout sessions."""
    cs = free_sessions(sessions).select("customer", face_value_micros("metadata").alias("micros"))
    return _per_account(accounts, _sum_by_customer(cs)).groupBy("account_id").agg(F.sum("micros").cast("long").alias("micros"))


def purchased_invoices(accounts: DataFrame, invoices: DataFrame, app_tag: str) -> DataFrame:
    """Per account, face value of free tagged invoices."""
    inv = free_invoices(invoices, app_tag).select("customer", face_value_micros("metadata").alias("micros"))
    return _per_account(accounts, _sum_by_customer(inv)).groupBy("account_id").agg(F.sum("micros").cast("long").alias("micros"))


def all_spend(usage: DataFrame, simulated: DataFrame) -> DataFrame:
    """UNION ALL of metered and simulated spend."""
    return usage.select("account_id", F.col("price_micros").alias("micros"), F.lit("usage").alias("source")).unionByName(
        simulated.select("account_id", F.col("amount_micros").alias("micros"), F.lit("simulated").alias("source"))
    )


def spent(usage: DataFrame, simulated: DataFrame) -> DataFrame:
    """Per account, sum of both spend kinds."""
    return all_spend(usage, simulated).groupBy("account_id").agg(F.sum("micros").cast("long").alias("micros"))


def wallet_parts(accounts: DataFrame, charges: DataFrame, sessions: DataFrame, invoices: DataFrame,
                 usage: DataFrame, simulated: DataFrame, app_tag: str) -> DataFrame:
    """Every account with its four pre-aggregated sides (no fan-out), missing = 0."""
    entries = purchase_entries(charges, sessions, invoices, app_tag)
    by_customer = entries.groupBy("customer").agg(
        *[F.sum(F.when(F.col("source") == s, F.col("micros"))).cast("long").alias(f"{s}s_micros") for s in ("charge", "session", "invoice")]
    )
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer"))
    bought = a.join(by_customer, "customer", "left").drop("customer")
    out = bought.join(spent(usage, simulated).withColumnRenamed("micros", "spent_micros"), "account_id", "left")
    return out.select(
        "account_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("charges_micros", "sessions_micros", "invoices_micros", "spent_micros")],
    )


def balances(accounts: DataFrame, charges: DataFrame, sessions: DataFrame, invoices: DataFrame,
             usage: DataFrame, simulated: DataFrame, app_tag: str) -> DataFrame:
    """Every account's purchased, spent and balance micros (balance may be negative)."""
    entries = purchase_entries(charges, sessions, invoices, app_tag).select("customer", "micros")
    bought = _sum_by_customer(entries)
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer"))
    w = a.join(bought.withColumnRenamed("micros", "purchased"), "customer", "left").drop("customer")
    w = w.join(spent(usage, simulated).withColumnRenamed("micros", "spent"), "account_id", "left")
    p = F.coalesce(F.col("purchased"), F.lit(0)).cast("long")
    s = F.coalesce(F.col("spent"), F.lit(0)).cast("long")
    return w.select("account_id", p.alias("purchased_micros"), s.alias("spent_micros"), (p - s).alias("balance_micros"))


def account_charges(accounts: DataFrame, charges: DataFrame) -> DataFrame:
    """J1 as rows: each account's charges (inner join on customer id)."""
    a = accounts.select("account_id", F.col("stripe_customer_id").alias("customer")).filter(F.col("customer").isNotNull())
    return a.join(charges.select("customer", F.col("id").alias("charge_id"), "amount", "amount_refunded", "status", "created"), "customer", "inner").drop("customer")
