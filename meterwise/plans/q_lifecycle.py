"""Lifecycle, corrections and audits: S1-S11, B1-B7, Q1-Q5, J12."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from meterwise.config import DEFAULT
from meterwise.operators import audit as AU
from meterwise.operators import backfill as BF
from meterwise.operators.usage import rate_impact_30d
from meterwise.plans import q_topups
from meterwise.plans.q_usage import RATE_IMPACT_SQL
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import PURCHASE_ENTRIES
from meterwise.schemas import OWNED, SYNCED, conform, read_owned
from meterwise.session import ensure_checkpoint_dir
from meterwise.sources import lifecycle as LC
from meterwise.sources import synced as SY

P = DEFAULT
PH = P.placeholder_domain
OLD_DOMAIN = f"users.{P.old_tag}.invalid"
SPLIT = datetime(2000, 1, 1)

_TYPED = """SELECT id, _account_id, _updated_at, json_extract_string(_raw_data, '$.email') AS email,
                   json_extract_string(_raw_data, '$.name') AS name,
                   json_extract_string(_raw_data, '$.metadata.app') AS meta_app,
                   json_extract_string(_raw_data, '$.metadata.account_id') AS meta_account_id,
                   CAST(json_extract(_raw_data, '$.created') AS BIGINT) AS created
            FROM {src}"""
_LATEST_RAW = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id, _account_id
                 ORDER BY _updated_at DESC, _raw_data DESC) AS rn FROM customers_raw) WHERE rn = 1"""


def _flat(df):
    return df.select("id", "_account_id", "_updated_at", "email", "name", F.col("metadata")["app"].alias("meta_app"),
                     F.col("metadata")["account_id"].alias("meta_account_id"), "created")


@register("synced_typed", "S1", _TYPED.format(src="customers_raw"))
def q_synced_typed(fx):
    return _flat(SY.synced_typed(fx.customers_raw))


@register("synced_latest", "S2", _TYPED.format(src="latest_raw"), {"latest_raw": _LATEST_RAW})
def q_synced_latest(fx):
    return _flat(fx.customers)


def _load(table, source=None):
    """Writes the table as its owner does (declared schema) and opens it through the checked read."""

    def build(fx):
        path = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/owned/{table}-{uuid.uuid4().hex}"
        conform(getattr(fx, source or table), OWNED[table]).write.parquet(path)
        return read_owned(fx.spark, path, table)

    return build


register("load_tables", "S3", "SELECT * FROM usage_events")(_load("usage_events"))
for _t in ("accounts", "api_keys", "simulated_spend", "topups"):
    register(f"load_{_t}", "S3", f"SELECT * FROM {_t}")(_load(_t))
register("load_service_prices", "S3", f"""
    SELECT 'service_' || p_partkey AS service, CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_micros, p_partkey % 3 <> 0 AS active,
           TIMESTAMP '{P.as_of_sql}' - to_days(CAST(p_partkey % 365 AS INTEGER)) AS updated_at FROM part""")(_load("service_prices", "service_catalog"))
register("load_model_costs", "S3", """
    SELECT 'model_' || s_suppkey AS model, CAST(CAST(s_suppkey * 7 % 9973 AS DOUBLE) / 100 AS DECIMAL(12,4)) AS input_usd_per_mtok,
           CAST(CAST(s_suppkey * 3 % 9973 AS DOUBLE) / 100 AS DECIMAL(12,4)) AS cached_input_usd_per_mtok,
           CAST(CAST(s_suppkey * 31 % 9973 AS DOUBLE) / 100 AS DECIMAL(12,4)) AS output_usd_per_mtok FROM supplier""")(_load("model_costs", "model_catalog"))


def _synced(table):
    def build(fx):
        return SY.synced_typed(SY.synced_latest(fx.synced_feed(table)), SYNCED[table]).drop("_account_id", "_updated_at")

    return build


# Through the change feed (S2, then S1) and back to the table it was made from.
for _t in SYNCED:
    register(f"synced_{_t}", "S1-S2", f"SELECT * FROM {_t}")(_synced(_t))


_LEDGER_COLS = ["id", "account_id", "api_key_id", "service", "units", "model", "input_tokens", "cached_input_tokens", "output_tokens",
                "reasoning_tokens", "price_micros", "cost_micros", "status", "latency_ms", "created_at"]
_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in ["created_at"] + [c for c in _LEDGER_COLS if c not in ("id", "created_at")])


@register(
    "ledger_append", "S4",
    f"""SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) AS rn
          FROM usage_events WHERE created_at >= TIMESTAMP '2000-01-01') b
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM usage_events e WHERE e.created_at < TIMESTAMP '2000-01-01' AND e.id = b.id)""",
)
def q_ledger_append(fx):
    old = fx.usage_events.filter(F.col("created_at") < F.lit(SPLIT).cast("timestamp"))
    new = fx.usage_events.filter(F.col("created_at") >= F.lit(SPLIT).cast("timestamp"))
    return LC.ledger_append(old, new)


def _topup_batch(fx):
    out = q_topups.q_topup_outcomes(fx).select("account_id", "invoice_id", "amount_cents", "status", "error")
    resent = fx.topups.filter(F.col("status") == "paid").select("account_id", "invoice_id", "amount_cents", "status", "error")
    return out.unionByName(resent)


@register(
    "topup_insert_if_absent", "S5",
    """SELECT account_id, invoice_id, amount_cents, status, error FROM (
         SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY account_id ASC NULLS FIRST, amount_cents ASC NULLS FIRST,
                                      status ASC NULLS FIRST, error ASC NULLS FIRST) AS rn
         FROM batch WHERE invoice_id IS NOT NULL) b
       WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM topups t WHERE t.invoice_id = b.invoice_id)
       UNION ALL SELECT account_id, invoice_id, amount_cents, status, error FROM batch WHERE invoice_id IS NULL""",
    {**q_topups.OUTCOME_CTES, "outcomes": q_topups.OUTCOMES_SQL,
     "batch": "SELECT account_id, invoice_id, amount_cents, status, error FROM outcomes "
              "UNION ALL SELECT account_id, invoice_id, amount_cents, status, error FROM topups WHERE status = 'paid'"},
)
def q_topup_insert_if_absent(fx):
    return LC.topup_insert_if_absent(fx.topups, _topup_batch(fx))


_REQ = ", ".join(f"('price', '{k}')" for k in P.lookup_keys) + f", ('promotion', '{P.promotion_code}')"


@register(
    "catalog_missing", "S6",
    f"""SELECT kind, key FROM (VALUES {_REQ}) AS r(kind, key)
        WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.active AND r.kind = 'price' AND p.lookup_key = r.key)
          AND NOT EXISTS (SELECT 1 FROM promotion_codes c WHERE c.active AND r.kind = 'promotion' AND c.code = r.key)""",
)
def q_catalog_missing(fx):
    return LC.catalog_missing(fx.prices, fx.promotion_codes, P.lookup_keys, P.promotion_code)


@register(
    "account_upsert", "S7",
    f"""SELECT a.account_id, coalesce(a.user_id, u.user_id) AS user_id, coalesce(u.new_label, a.label) AS label,
               CASE WHEN a.account_id IS NULL THEN 'insert' WHEN u.new_label IS NOT NULL THEN 'update' ELSE 'keep' END AS action
        FROM accounts a FULL OUTER JOIN (
          SELECT user_id, coalesce(CASE WHEN ends_with(lower(email), '@{PH}') THEN lower(split_part(email, '@', 1)) END, name) AS new_label
          FROM users) u ON u.user_id = a.user_id""",
)
def q_account_upsert(fx):
    return LC.account_upsert(fx.accounts, fx.users, PH)


_PRE = ["charges", "checkout_sessions", "invoices", "customers_raw", "prices", "promotion_codes"]


@register(
    "preflight_inputs", "S8",
    " UNION ALL ".join(f"SELECT '{t}' AS name, EXISTS (SELECT 1 FROM {t}) AS present, {len(_PRE)} AS required" for t in _PRE),
)
def q_preflight_inputs(fx):
    return LC.preflight_inputs({t: getattr(fx, t) for t in _PRE})


@register(
    "key_state", "S9",
    """SELECT c.key_id, c.account_id, c.name, substring(c.key_text, 1, 12) AS prefix, sha256(c.key_text) AS key_hash, c.created_at,
              u.last_used_at, r.revoked_at
       FROM api_key_creates c
       LEFT JOIN (SELECT api_key_id AS key_id, max(created_at) AS last_used_at FROM usage_events WHERE api_key_id IS NOT NULL GROUP BY 1) u
         ON u.key_id = c.key_id
       LEFT JOIN (SELECT v.key_id, min(v.at) AS revoked_at FROM key_revokes v
                  JOIN api_key_creates k ON k.key_id = v.key_id AND k.account_id = v.account_id GROUP BY v.key_id) r
         ON r.key_id = c.key_id""",
)
def q_key_state(fx):
    return LC.key_state(fx.api_key_creates, fx.key_revokes, fx.usage_events)


@register(
    "settings_state", "S10",
    """SELECT a.account_id,
              CASE WHEN f.f.ts IS NOT NULL AND (c.c.ts IS NULL OR f.f.ts > c.c.ts) THEN false
                   WHEN c.c.ts IS NOT NULL THEN c.c.enabled ELSE a.auto_topup_enabled END AS auto_topup_enabled,
              coalesce(CAST(c.c.threshold_cents AS BIGINT) * 10000, a.auto_topup_threshold_micros) AS auto_topup_threshold_micros,
              CAST(coalesce(c.c.amount_cents, a.auto_topup_amount_cents) AS INTEGER) AS auto_topup_amount_cents,
              CASE WHEN f.f.ts IS NOT NULL AND (c.last_enable_at IS NULL OR f.f.ts > c.last_enable_at) THEN f.f.message
                   WHEN c.last_enable_at IS NOT NULL THEN NULL ELSE a.auto_topup_error END AS auto_topup_error
       FROM accounts a
       LEFT JOIN (SELECT account_id, max({'ts': "at", 'enabled': enabled, 'threshold_cents': threshold_cents, 'amount_cents': amount_cents}) AS c,
                         max(CASE WHEN enabled THEN "at" END) AS last_enable_at
                  FROM settings_changes GROUP BY account_id) c ON c.account_id = a.account_id
       LEFT JOIN (SELECT account_id, max({'ts': created_at, 'message': coalesce(error, 'Auto top-up failed.')}) AS f
                  FROM topups WHERE status = 'failed' AND "trigger" = 'schedule' GROUP BY account_id) f ON f.account_id = a.account_id""",
)
def q_settings_state(fx):
    return LC.settings_state(fx.accounts, fx.settings_changes, LC.scheduled_failures(fx.topups))


@register(
    "customer_link", "S11",
    f"""SELECT a.account_id, a.stripe_customer_id, u.billing_email, c.email AS synced_email,
               CASE WHEN a.stripe_customer_id IS NULL OR c.id IS NULL THEN 'create'
                    WHEN u.billing_email IS NOT NULL AND u.billing_email IS DISTINCT FROM c.email THEN 'update_email'
                    ELSE 'keep' END AS action
        FROM accounts a
        LEFT JOIN (SELECT user_id, CASE WHEN NOT ends_with(lower(email), '@{PH}') THEN email END AS billing_email FROM users) u
          ON u.user_id = a.user_id
        LEFT JOIN customers c ON c.id = a.stripe_customer_id""",
    {"latest_raw": _LATEST_RAW, "customers": _TYPED.format(src="latest_raw")},
)
def q_customer_link(fx):
    return SY.customer_link(fx.accounts, fx.users, fx.customers, PH)


# -------------------------------------------------------------------- backfills
def _retag_sql(table: str, meta: str) -> str:
    return (f"SELECT '{table}' AS table_name, id, CASE WHEN json_extract_string({meta}, '$.app') = 'other' THEN 'changed' ELSE 'already' END AS status, "
            f"'{P.app_tag}' AS app, CAST(len(json_keys({meta})) AS INTEGER) AS n_keys, "
            f"""replace({meta}, '"app":"other"', '"app":"{P.app_tag}"') AS metadata """
            f"FROM {table}_m "
            f"WHERE json_extract_string({meta}, '$.app') IN ('other', '{P.app_tag}')")


@register(
    "retag", "B1",
    " UNION ALL ".join(_retag_sql(t, "metadata") for t in ["charges", "checkout_sessions", "invoices", "customers"]),
    {"charges_m": "SELECT id, metadata FROM charges", "checkout_sessions_m": "SELECT id, metadata FROM checkout_sessions",
     "invoices_m": "SELECT id, metadata FROM invoices", "latest_raw": _LATEST_RAW,
     "customers_m": "SELECT id, CAST(json_extract(_raw_data, '$.metadata') AS VARCHAR) AS metadata FROM latest_raw"},
)
def q_retag(fx):
    cust = SY.synced_latest(fx.customers_raw).select("id", F.get_json_object("_raw_data", "$.metadata").alias("metadata"))
    tables = {"charges": fx.charges, "checkout_sessions": fx.checkout_sessions, "invoices": fx.invoices, "customers": cust}
    return BF.retag(tables, "other", P.app_tag)


@register(
    "rename_text", "B2",
    """SELECT id, name AS old_text, 'Client account' AS new_text,
              CASE WHEN regexp_matches(name, '(?i)customer#0+1') THEN 'changed' ELSE 'already' END AS status
       FROM customers WHERE regexp_matches(name, '(?i)customer#0+1') OR name = 'Client account'""",
    {"latest_raw": _LATEST_RAW, "customers": _TYPED.format(src="latest_raw")},
)
def q_rename_text(fx):
    return BF.rename_text(fx.customers, "name", "customer#0+1", "Client account")


_OLD_KEYS = [k.replace(P.app_tag + "_", P.old_tag + "_", 1) for k in P.lookup_keys]
_OLD_CODE = P.old_tag.upper() + "100"


@register(
    "retire_prices", "B3",
    f"""SELECT 'price' AS kind, id, lookup_key AS key, CASE WHEN active THEN 'archive' ELSE 'skip' END AS action
        FROM prices WHERE lookup_key IN ({', '.join(f"'{k}'" for k in _OLD_KEYS)})
        UNION ALL
        SELECT 'promotion', id, code, CASE WHEN active THEN 'deactivate' ELSE 'skip' END FROM promotion_codes WHERE code = '{_OLD_CODE}'""",
)
def q_retire_prices(fx):
    return BF.retire_catalog(fx.prices, fx.promotion_codes, _OLD_KEYS, _OLD_CODE)


@register(
    "email_domain", "B4",
    f"""SELECT user_id, email AS old_email, replace(email, '@{OLD_DOMAIN}', '@{PH}') AS email
        FROM users WHERE ends_with(email, '@{OLD_DOMAIN}')""",
)
def q_email_domain(fx):
    return BF.email_domain(fx.users, OLD_DOMAIN, PH)


@register(
    "label_services", "B5",
    """SELECT id, account_id, CASE WHEN created_at < TIMESTAMP '2000-01-01' THEN 'chat' ELSE service END AS service,
              CAST(CASE WHEN created_at < TIMESTAMP '2000-01-01' THEN 0 ELSE units END AS INTEGER) AS units, created_at
       FROM usage_events""",
)
def q_label_services(fx):
    split = F.lit(SPLIT).cast("timestamp")
    legacy = fx.usage_events.filter(F.col("created_at") < split).drop("service", "units")
    current = fx.usage_events.filter(F.col("created_at") >= split)
    return BF.label_services(legacy, current)


@register(
    "rate_floor", "B6",
    RATE_IMPACT_SQL.replace("LEFT JOIN model_rates r", "LEFT JOIN floored_rates r"),
    {"floored_rates": "SELECT model, input_usd_per_mtok, cached_input_usd_per_mtok, output_usd_per_mtok, "
                      "greatest(reasoning_usd_per_mtok, output_usd_per_mtok) AS reasoning_usd_per_mtok FROM model_rates"},
)
def q_rate_floor(fx):
    return rate_impact_30d(fx.usage_events, BF.rate_floor(fx.model_rates), fx.p.as_of)


@register("purge_accounts", "B7", "SELECT * FROM accounts WHERE user_id IS NOT NULL")
def q_purge_accounts(fx):
    return BF.purge_accounts(fx.accounts)[0]


@register(
    "purge_semi", "J12",
    """SELECT u.* FROM usage_events u
       WHERE EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = u.account_id AND a.user_id IS NOT NULL)""",
)
def q_purge_semi(fx):
    return BF.keep_children(fx.usage_events, BF.purge_accounts(fx.accounts)[0])


def _purged(table):
    def build(fx):
        return BF.keep_children(getattr(fx, table), BF.purge_accounts(fx.accounts)[0])

    return build


# The purge reaches every child of an account, not only the ledger.
for _t in ("api_keys", "simulated_spend", "topups"):
    register(f"purge_{_t}", "J12",
             f"SELECT * FROM {_t} WHERE account_id IN (SELECT account_id FROM accounts WHERE user_id IS NOT NULL)")(_purged(_t))


# ---------------------------------------------------------------------- audits
_DUPS = {"usage_events": "id", "topups": "invoice_id", "accounts": "user_id", "api_keys": "key_hash", "charges": "id"}


@register(
    "dup_keys", "Q1",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{k}' AS key_column, CAST({k} AS VARCHAR) AS key, count(*) AS n "
                       f"FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1" for t, k in _DUPS.items()),
)
def q_dup_keys(fx):
    return AU.dup_keys({t: (getattr(fx, t), k) for t, k in _DUPS.items()})


_CHILDREN = {"usage_events": "account_id", "simulated_spend": "account_id", "topups": "account_id", "api_keys": "account_id"}


def _orphan_sql(t, ref, parent, pkey):
    return (f"SELECT '{t}' AS table_name, '{ref}' AS ref_column, CAST(c.{ref} AS VARCHAR) AS ref, count(*) AS n FROM {t} c "
            f"WHERE c.{ref} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pkey} = c.{ref}) GROUP BY c.{ref}")


@register(
    "orphans", "Q2",
    " UNION ALL ".join([_orphan_sql(t, r, "accounts", "account_id") for t, r in _CHILDREN.items()]
                       + [_orphan_sql("usage_events", "api_key_id", "api_keys", "key_id")]),
)
def q_orphans(fx):
    a = AU.orphans({t: (getattr(fx, t), r) for t, r in _CHILDREN.items()}, fx.accounts, "account_id")
    k = AU.orphans({"usage_events": (fx.usage_events, "api_key_id")}, fx.api_keys, "key_id")
    return a.unionByName(k)


@register(
    "check_violations", "Q3",
    """SELECT 'topups' AS table_name, CAST(id AS VARCHAR) AS id, 'amount_cents >= 500' AS rule FROM topups WHERE NOT coalesce(amount_cents >= 500, true)
       UNION ALL SELECT 'simulated_spend', CAST(id AS VARCHAR), 'amount_micros > 0' FROM simulated_spend WHERE NOT coalesce(amount_micros > 0, true)
       UNION ALL SELECT 'service_prices', service, 'unit_price_micros >= 0' FROM service_prices WHERE NOT coalesce(unit_price_micros >= 0, true)
       UNION ALL SELECT 'usage_events', CAST(id AS VARCHAR), 'price_micros >= 0 and cost_micros >= 0' FROM usage_events
                 WHERE NOT coalesce(price_micros >= 0 AND cost_micros >= 0, true)""",
)
def q_check_violations(fx):
    return AU.check_violations(fx.topups, fx.simulated_spend, fx.service_prices, fx.usage_events)


@register(
    "set_null_refs", "Q4",
    """SELECT u.id, u.account_id, CASE WHEN k.key_id IS NOT NULL THEN u.api_key_id END AS api_key_id, u.created_at
       FROM usage_events u LEFT JOIN api_keys k ON k.key_id = u.api_key_id""",
)
def q_set_null_refs(fx):
    return AU.set_null_refs(fx.usage_events, fx.api_keys)


@register(
    "no_double_count", "Q5",
    f"""SELECT order_key, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
               CAST(sum(micros) - max(micros) AS BIGINT) AS extra_micros
        FROM (SELECT e.*, coalesce(json_extract_string(o.metadata, '$.order'), e.id) AS order_key FROM ({PURCHASE_ENTRIES}) e
              JOIN (SELECT id, metadata FROM charges UNION ALL SELECT id, metadata FROM checkout_sessions UNION ALL SELECT id, metadata FROM invoices) o USING (id)) k
        GROUP BY order_key HAVING count(*) > 1""",
)
def q_no_double_count(fx):
    return AU.no_double_count(AU.order_entries(fx.charges, fx.checkout_sessions, fx.invoices, P.app_tag))
