"""Writes without a mutable store: append-if-absent, upserts and change logs.

Parquet has no UPDATE, so every "insert ... on conflict", "update ... set"
of the reference becomes a DataFrame of the rows to write (anti-joins on the
key) or the current state rebuilt from a change log with per-key aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import MICROS_PER_CENT
from meterwise.sources.synced import username_of


def _first_by_all(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the smallest by ``order`` then by every other column."""
    others = [c for c in df.columns if c != key]
    ordered = order + [c for c in others if c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*ordered)).alias("_v"))
    return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in others])


#: A batch of up to so many ids (8 MB) goes to the ledger; a larger one meets it by a shuffle.
MAX_BATCH_IDS = 1_000_000


def ledger_append(ledger: DataFrame, batch: DataFrame, max_ids: int = MAX_BATCH_IDS) -> DataFrame:
    """Rows of ``batch`` to append: the request id is the key, so a retried write (an id
    already in the ledger, or repeated in the batch) adds nothing; the first write wins.

    Of the ledger only the ids that the batch has are looked for: a batch of a counted size is
    broadcast to the ledger's id column, which then is scanned but never shuffled or sorted."""
    first = _first_by_all(batch, "id", ["created_at"])
    ids = first.select("id")
    if batch.limit(max_ids + 1).count() <= max_ids:
        ids = F.broadcast(ids)
    known = ledger.select("id").join(ids, "id", "left_semi")  # no more than the batch
    return first.join(known, "id", "left_anti").select(*batch.columns)


def topup_insert_if_absent(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Top-up rows to insert; nothing when the invoice id already exists. NULL invoice
    ids never conflict (they are all kept)."""
    keyed = batch.filter(F.col("invoice_id").isNotNull())
    nulls = batch.filter(F.col("invoice_id").isNull())
    first = _first_by_all(keyed, "invoice_id", [])
    fresh = first.join(existing.select("invoice_id").filter(F.col("invoice_id").isNotNull()), "invoice_id", "left_anti")
    return fresh.select(*batch.columns).unionByName(nulls)


def catalog_missing(prices: DataFrame, promotion_codes: DataFrame, lookup_keys, promotion_code: str | None) -> DataFrame:
    """Required catalog objects with no *active* synced row: what the seed must create."""
    spark = prices.sparkSession
    req = spark.createDataFrame([("price", k) for k in lookup_keys] + ([("promotion", promotion_code)] if promotion_code else []),
                                "kind string, key string")
    have = (prices.filter(F.col("active")).select(F.lit("price").alias("kind"), F.col("lookup_key").alias("key"))
            .unionByName(promotion_codes.filter(F.col("active")).select(F.lit("promotion").alias("kind"), F.col("code").alias("key"))))
    return req.join(have, ["kind", "key"], "left_anti")


def account_upsert(accounts: DataFrame, users: DataFrame, domain: str) -> DataFrame:
    """Accounts after signing in ``users``: a new account per unknown user, else only the
    label changes; label = username of a placeholder email, else the user's name."""
    u = users.select("user_id", F.coalesce(username_of("email", domain), F.col("name")).alias("new_label"))
    j = accounts.join(u, "user_id", "full")
    action = (F.when(F.col("account_id").isNull(), "insert").when(F.col("new_label").isNotNull(), "update").otherwise("keep"))
    return j.select("account_id", "user_id", F.coalesce("new_label", "label").alias("label"), action.alias("action"))


def preflight_inputs(tables: dict[str, DataFrame]) -> DataFrame:
    """Which required inputs exist (have at least one row); ``ready`` only when all do."""
    parts = None
    for name, df in tables.items():
        one = df.limit(1).select(F.lit(name).alias("name"))
        parts = one if parts is None else parts.unionByName(one)
    spark = next(iter(tables.values())).sparkSession
    req = spark.createDataFrame([(n,) for n in tables], "name string")
    present = req.join(parts.withColumn("present", F.lit(True)), "name", "left")
    return present.select("name", F.coalesce("present", F.lit(False)).alias("present"),
                          F.lit(len(tables)).alias("required"))


def key_state(creates: DataFrame, revokes: DataFrame, usage: DataFrame) -> DataFrame:
    """Current keys from the change log. Stored prefix = first 12 characters and a
    SHA-256 of the key (never the key); a revoke counts only when the revoking account
    owns the key, and the first one wins; last use = the newest call made with the key."""
    k = creates.select("key_id", "account_id", "name", F.substring("key_text", 1, 12).alias("prefix"),
                       F.sha2("key_text", 256).alias("key_hash"), "created_at")
    rv = (revokes.join(creates.select("key_id", "account_id"), ["key_id", "account_id"], "left_semi")
          .groupBy("key_id").agg(F.min("at").alias("revoked_at")))
    used = usage.filter(F.col("api_key_id").isNotNull()).groupBy(F.col("api_key_id").alias("key_id")).agg(
        F.max("created_at").alias("last_used_at"))
    return k.join(used, "key_id", "left").join(rv, "key_id", "left").select(
        "key_id", "account_id", "name", "prefix", "key_hash", "created_at", "last_used_at", "revoked_at")


def settings_state(accounts: DataFrame, changes: DataFrame, failures: DataFrame) -> DataFrame:
    """Auto top-up settings after the change log. A saved change sets the switch,
    threshold (cents x 10,000) and amount; enabling clears the last error, disabling keeps
    it. A scheduled failure switches it off and records its message."""
    last = changes.groupBy("account_id").agg(
        F.max(F.struct("at", "enabled", "threshold_cents", "amount_cents")).alias("c"),
        F.max(F.when(F.col("enabled"), F.col("at"))).alias("last_enable_at"))
    fail = failures.groupBy("account_id").agg(F.max(F.struct("at", "message")).alias("f"))
    j = accounts.join(last, "account_id", "left").join(fail, "account_id", "left")
    failed_after_change = F.col("f.at").isNotNull() & (F.col("c.at").isNull() | (F.col("f.at") > F.col("c.at")))
    enabled = (F.when(failed_after_change, F.lit(False))
               .when(F.col("c.at").isNotNull(), F.col("c.enabled")).otherwise(F.col("auto_topup_enabled")))
    error = (F.when(F.col("f.at").isNotNull() & (F.col("last_enable_at").isNull() | (F.col("f.at") > F.col("last_enable_at"))),
                    F.col("f.message"))
             .when(F.col("last_enable_at").isNotNull(), F.lit(None).cast("string"))
             .otherwise(F.col("auto_topup_error")))
    return j.select(
        "account_id", enabled.alias("auto_topup_enabled"),
        F.coalesce(F.col("c.threshold_cents").cast("long") * MICROS_PER_CENT, F.col("auto_topup_threshold_micros")).alias("auto_topup_threshold_micros"),
        F.coalesce(F.col("c.amount_cents"), F.col("auto_topup_amount_cents")).cast("int").alias("auto_topup_amount_cents"),
        error.alias("auto_topup_error"),
    )


def scheduled_failures(topups: DataFrame) -> DataFrame:
    """Failure events of scheduled top-ups (the message that switched auto top-up off); a
    failed manual top-up leaves the switch alone."""
    return topups.filter((F.col("status") == "failed") & (F.col("trigger") == "schedule")).select(
        "account_id", F.col("created_at").alias("at"), F.coalesce("error", F.lit("Auto top-up failed.")).alias("message"))

