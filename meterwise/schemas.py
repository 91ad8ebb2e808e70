"""Declared schemas of the owned tables and of the synced JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, S, B, TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()
RATE = T.DecimalType(12, 4)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


OWNED = {
    "accounts": _st(("account_id", L, False), ("user_id", L, True), ("label", S, False), ("stripe_customer_id", S, True),
                    ("auto_topup_enabled", B, False), ("auto_topup_threshold_micros", L, False),
                    ("auto_topup_amount_cents", I, False), ("auto_topup_error", S, True), ("created_at", TS, False)),
    "api_keys": _st(("key_id", L, False), ("account_id", L, False), ("name", S, False), ("prefix", S, False),
                    ("key_hash", S, False), ("created_at", TS, False), ("last_used_at", TS, True), ("revoked_at", TS, True)),
    "usage_events": _st(("id", L, False), ("account_id", L, False), ("api_key_id", L, True), ("service", S, False),
                        ("units", I, False), ("model", S, False), ("input_tokens", I, False), ("cached_input_tokens", I, False),
                        ("output_tokens", I, False), ("reasoning_tokens", I, False), ("price_micros", L, False),
                        ("cost_micros", L, False), ("status", T.ShortType(), False), ("latency_ms", I, True),
                        ("created_at", TS, False)),
    "service_prices": _st(("service", S, False), ("unit_price_micros", L, False), ("active", B, False), ("updated_at", TS, False)),
    "model_costs": _st(("model", S, False), ("input_usd_per_mtok", RATE, False), ("cached_input_usd_per_mtok", RATE, False),
                       ("output_usd_per_mtok", RATE, False)),
    "simulated_spend": _st(("id", L, False), ("account_id", L, False), ("amount_micros", L, False), ("created_at", TS, False)),
    "topups": _st(("id", L, False), ("account_id", L, False), ("invoice_id", S, True), ("amount_cents", I, False),
                  ("status", S, False), ("error", S, True), ("trigger", S, False), ("created_at", TS, False)),
}

# Synced documents (the JSON in ``_raw_data``). Nested objects that are read by path later
# (metadata, card details) are kept as their JSON text.
CHARGE_DOC = _st(("id", S, True), ("customer", S, True), ("payment_method", S, True), ("payment_method_details", S, True),
                 ("amount", L, True), ("amount_refunded", L, True), ("currency", S, True), ("status", S, True), ("paid", B, True),
                 ("refunded", B, True), ("disputed", B, True), ("receipt_url", S, True), ("metadata", S, True), ("created", L, True))
PRICE_DOC = _st(("id", S, True), ("lookup_key", S, True), ("active", B, True), ("unit_amount", L, True), ("created", L, True))
SESSION_DOC = _st(("id", S, True), ("customer", S, True), ("mode", S, True), ("status", S, True), ("payment_status", S, True),
                  ("amount_total", L, True), ("metadata", S, True), ("created", L, True))
INVOICE_DOC = _st(("id", S, True), ("customer", S, True), ("status", S, True), ("total", L, True), ("amount_paid", L, True),
                  ("hosted_invoice_url", S, True), ("metadata", S, True), ("created", L, True))
PROMOTION_DOC = _st(("id", S, True), ("code", S, True), ("active", B, True), ("created", L, True))
SYNCED = {"charges": CHARGE_DOC, "prices": PRICE_DOC, "checkout_sessions": SESSION_DOC, "invoices": INVOICE_DOC,
          "promotion_codes": PROMOTION_DOC}
CUSTOMER_DOC = _st(("id", S, True), ("email", S, True), ("name", S, True),
                   ("metadata", T.MapType(S, S), True), ("created", L, True))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to a declared schema (a missing column is an error)."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_owned(spark, path: str, table: str) -> DataFrame:
    """S3: an owned table with its declared schema. A file without a declared column, or with
    one of another type, is an error: a read that trusts the declaration would return NULLs."""
    have = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    bad = [f"{f.name}: {have.get(f.name, 'missing')}" for f in OWNED[table].fields
           if have.get(f.name) != f.dataType and not (f.dataType == TS and have.get(f.name) == T.TimestampNTZType())]
    if bad:
        raise ValueError(f"{table} does not have its declared schema: {bad}")
    return spark.read.schema(OWNED[table]).parquet(path)
