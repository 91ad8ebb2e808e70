"""Data corrections as re-runnable jobs.

Each job returns the rows it would write plus a status per row (``changed`` or
``already`` done), like a dry run; running it on its own output changes
nothing. All are narrow row-wise rewrites or anti/semi joins on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _meta_app(doc: Column) -> Column:
    return F.get_json_object(doc, "$.app")


def retag(tables: dict[str, DataFrame], old_tag: str, new_tag: str, meta_col: str = "metadata") -> DataFrame:
    """B1: objects whose ``metadata.app`` is the old tag get the new tag; the other keys are
    kept (a map merge where the new value wins), and the rewritten metadata is returned. Objects already on the new tag are
    reported as ``already``."""
    out = None
    for name, df in tables.items():
        m = F.from_json(F.col(meta_col), "map<string,string>")
        merged = F.map_concat(m, F.create_map(F.lit("app"), F.lit(new_tag)))
        part = df.filter(_meta_app(F.col(meta_col)).isin(old_tag, new_tag)).select(
            F.lit(name).alias("table_name"), "id",
            F.when(_meta_app(F.col(meta_col)) == old_tag, "changed").otherwise("already").alias("status"),
            F.element_at(merged, "app").alias("app"),
            F.size(merged).alias("n_keys"),
            F.to_json(merged).alias("metadata"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def rename_text(df: DataFrame, col: str, old_pattern: str, new_text: str, key: str = "id") -> DataFrame:
    """B2: values matching the old name (case-insensitive) are replaced by the new text."""
    hit = F.col(col).rlike(f"(?i){old_pattern}")
    return df.filter(hit | (F.col(col) == new_text)).select(
        key, F.col(col).alias("old_text"), F.lit(new_text).alias("new_text"),
        F.when(hit, "changed").otherwise("already").alias("status"))


def retire_catalog(prices: DataFrame, promotion_codes: DataFrame, old_lookup_keys, old_code: str) -> DataFrame:
    """Archive active prices under the old lookup keys and deactivate the old promotion
    code; inactive ones are counted as skipped."""
    p = prices.filter(F.col("lookup_key").isin(*old_lookup_keys)).select(
        F.lit("price").alias("kind"), "id", F.col("lookup_key").alias("key"),
        F.when(F.col("active"), "archive").otherwise("skip").alias("action"))
    c = promotion_codes.filter(F.col("code") == old_code).select(
        F.lit("promotion").alias("kind"), "id", F.col("code").alias("key"),
        F.when(F.col("active"), "deactivate").otherwise("skip").alias("action"))
    return p.unionByName(c)


def email_domain(users: DataFrame, old_domain: str, new_domain: str) -> DataFrame:
    """Placeholder addresses move to the new domain (replace where LIKE '%@old')."""
    old = "@" + old_domain
    return users.filter(F.col("email").endswith(old)).select(
        "user_id", F.col("email").alias("old_email"), F.replace(F.col("email"), F.lit(old), F.lit("@" + new_domain)).alias("email"))


def label_services(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """A ledger written before and after the ``service``/``units`` columns existed, read
    as one table: old rows say ``chat`` and 0 units, new rows what they sold."""
    both = legacy.unionByName(current, allowMissingColumns=True)
    return both.select("id", "account_id", F.coalesce("service", F.lit("chat")).alias("service"),
                       F.coalesce("units", F.lit(0)).cast("int").alias("units"), "created_at")


def rate_floor(model_rates: DataFrame) -> DataFrame:
    """Reasoning tokens priced at least like the rest of the output."""
    return model_rates.withColumn("reasoning_usd_per_mtok", F.greatest("reasoning_usd_per_mtok", "output_usd_per_mtok"))


def purge_accounts(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) accounts: those with no login go, with all their children."""
    return accounts.filter(F.col("user_id").isNotNull()), accounts.filter(F.col("user_id").isNull())


def keep_children(child: DataFrame, kept_accounts: DataFrame, key: str = "account_id") -> DataFrame:
    """Rows of kept accounts only (the cascade of a purge), as a semi join."""
    return child.join(kept_accounts.select(F.col("account_id").alias(key)), key, "left_semi")
