"""Synced (foreign-owned) tables: JSON change feed to typed, latest-per-key rows.

The payment processor's objects land as JSON documents keyed by
``(id, _account_id)`` with an ``_updated_at`` version, possibly late and
possibly more than once. "Latest per key" is a ``max_by`` aggregate, so a
hot key costs one partial-aggregate row per map task, not a sort of its
versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.schemas import CUSTOMER_DOC

KEY = ("id", "_account_id")


def synced_typed(raw: DataFrame, doc_schema: T.StructType = CUSTOMER_DOC) -> DataFrame:
    """JSON document per row to typed columns (plus key and version columns)."""
    doc = F.from_json("_raw_data", doc_schema)
    cols = [doc.getField(f.name).alias(f.name) for f in doc_schema.fields if f.name != "id"]
    return raw.select("id", "_account_id", "_updated_at", *cols)


def synced_latest(rows: DataFrame, key=KEY, version: str = "_updated_at") -> DataFrame:
    """The newest version of every object (ties broken by the whole row, deterministic).
    Run it on the raw feed (JSON text is orderable; typed maps are not)."""
    others = [version] + [c for c in rows.columns if c not in key and c != version]
    latest = rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("_v"))
    return latest.select(*key, *[F.col(f"_v.{c}").alias(c) for c in others])


def username_of(email, domain: str):
    """Username of a placeholder address (lower-cased), NULL for a real email."""
    e = F.col(email) if isinstance(email, str) else email
    return F.when(F.lower(e).endswith("@" + domain), F.lower(F.substring_index(e, "@", 1)))


def billing_email(email, domain: str):
    """The email a checkout may prefill: NULL for placeholder addresses."""
    e = F.col(email) if isinstance(email, str) else email
    return F.when(~F.lower(e).endswith("@" + domain), e)


def customer_link(accounts: DataFrame, users: DataFrame, customers: DataFrame, domain: str) -> DataFrame:
    """Per account, what the customer link needs: ``create`` when there is no stored
    customer id or it has no synced customer; ``update_email`` when the billing email is
    set and differs from the synced one; else ``keep``."""
    c = customers.select(F.col("id").alias("stripe_customer_id"), F.col("email").alias("synced_email"), F.lit(True).alias("_synced"))
    u = users.select("user_id", billing_email("email", domain).alias("billing_email"))
    j = accounts.select("account_id", "user_id", "stripe_customer_id").join(u, "user_id", "left").join(c, "stripe_customer_id", "left")
    synced = F.coalesce(F.col("_synced"), F.lit(False))
    action = (F.when(F.col("stripe_customer_id").isNull() | ~synced, "create")
              .when(F.col("billing_email").isNotNull() & ~F.col("billing_email").eqNullSafe(F.col("synced_email")), "update_email")
              .otherwise("keep"))
    return j.select("account_id", "stripe_customer_id", "billing_email", "synced_email", action.alias("action"))
