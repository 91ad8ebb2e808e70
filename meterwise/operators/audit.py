"""Data-quality audits: the database constraints the reference relies on, checked
as jobs (Q1-Q5). Each returns the offending rows; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.scalars import json_text
from meterwise.operators.wallet import purchase_entries


def dup_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Q1: repeated primary / unique keys; NULL keys may repeat (as in SQL UNIQUE)."""
    out = None
    for name, (df, key) in tables.items():
        d = (df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key"))
             .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
             .select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "key", "n"))
        out = d if out is None else out.unionByName(d)
    return out


def orphans(children: dict[str, tuple[DataFrame, str]], parent: DataFrame, parent_key: str) -> DataFrame:
    """Q2: child rows whose (non-NULL) reference has no parent row."""
    p = parent.select(F.col(parent_key).alias("_ref")).distinct()
    out = None
    for name, (df, ref) in children.items():
        o = (df.filter(F.col(ref).isNotNull()).join(p, F.col(ref) == F.col("_ref"), "left_anti")
             .groupBy(F.col(ref).cast("string").alias("ref")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(name).alias("table_name"), F.lit(ref).alias("ref_column"), "ref", "n"))
        out = o if out is None else out.unionByName(o)
    return out


def check_violations(topups: DataFrame, simulated: DataFrame, service_prices: DataFrame, usage: DataFrame) -> DataFrame:
    """Q3: CHECK constraints (a NULL passes a CHECK): top-up >= 500 cents, simulated amount
    > 0, unit price >= 0; plus the ledger's non-negative money."""
    parts = [
        topups.filter(~F.coalesce(F.col("amount_cents") >= 500, F.lit(True))).select(F.lit("topups").alias("table_name"), F.col("id").cast("string").alias("id"), F.lit("amount_cents >= 500").alias("rule")),
        simulated.filter(~F.coalesce(F.col("amount_micros") > 0, F.lit(True))).select(F.lit("simulated_spend").alias("table_name"), F.col("id").cast("string").alias("id"), F.lit("amount_micros > 0").alias("rule")),
        service_prices.filter(~F.coalesce(F.col("unit_price_micros") >= 0, F.lit(True))).select(F.lit("service_prices").alias("table_name"), F.col("service").alias("id"), F.lit("unit_price_micros >= 0").alias("rule")),
        usage.filter(~F.coalesce((F.col("price_micros") >= 0) & (F.col("cost_micros") >= 0), F.lit(True))).select(F.lit("usage_events").alias("table_name"), F.col("id").cast("string").alias("id"), F.lit("price_micros >= 0 and cost_micros >= 0").alias("rule")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_null_refs(usage: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Q4: ON DELETE SET NULL: ledger rows stay, their key id becomes NULL when the key row
    is gone."""
    k = api_keys.select(F.col("key_id").alias("api_key_id"), F.lit(True).alias("_k"))
    j = usage.join(k, "api_key_id", "left")
    return j.select("id", "account_id", F.when(F.col("_k"), F.col("api_key_id")).alias("api_key_id"), "created_at")


def order_entries(charges: DataFrame, sessions: DataFrame, invoices: DataFrame, app_tag: str) -> DataFrame:
    """The wallet's credits with the order each one pays for: the payment reference that the objects
    of one order share in their metadata (``order``), else the object itself."""
    order = F.coalesce(json_text("metadata", "order"), F.col("id")).alias("order_key")
    refs = [df.select("id", order) for df in (charges, sessions, invoices)]
    refs = refs[0].unionByName(refs[1]).unionByName(refs[2])
    return purchase_entries(charges, sessions, invoices, app_tag).join(refs, "id")


def no_double_count(entries: DataFrame) -> DataFrame:
    """Q5: orders that more than one credit counts (a paid order must not also count as free):
    how many credits, from which sources, and by how much they overstate the order (all but
    the largest of them)."""
    g = entries.groupBy("order_key").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source").alias("sources"),
                                         F.sum("micros").alias("total"), F.max("micros").alias("largest"))
    return g.filter(F.col("n") > 1).select("order_key", "n", F.array_join(F.sort_array("sources"), ",").alias("sources"),
                                           (F.col("total") - F.col("largest")).cast("long").alias("extra_micros"))
