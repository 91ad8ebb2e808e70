"""Feeds, top-k lists and logs: T1-T5, E2, F5-F8, F11, J3, J4."""

from __future__ import annotations

from meterwise.operators import logs as L
from meterwise.operators import purchases as PU
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import FREE_INVOICE, FREE_SESSION, cents_sql, money_sql

_RECENT_CHARGES = """
    SELECT customer, id, amount, amount_refunded, refunded, disputed, status, receipt_url,
           json_extract_string(metadata, '$.kind') AS kind,
           json_extract_string(payment_method_details, '$.card.brand') AS card_brand,
           json_extract_string(payment_method_details, '$.card.last4') AS card_last4,
           payment_method, created,
           row_number() OVER (PARTITION BY customer ORDER BY created DESC, id ASC) AS rn
    FROM charges"""


@register("recent_charges", "T1", "SELECT * EXCLUDE (rn) FROM rc WHERE rn <= 10", {"rc": _RECENT_CHARGES})
def q_recent_charges(fx):
    return PU.recent_charges(fx.charges)


_PURCHASES = f"""
    SELECT a.account_id, p.* EXCLUDE (customer)
    FROM accounts a JOIN (
      SELECT customer, id, amount AS amount_cents, amount_refunded AS refunded_cents, coalesce(status, 'unknown') AS status,
             coalesce(disputed, false) AS disputed, receipt_url,
             coalesce(json_extract_string(metadata, '$.kind') = 'auto_topup', false) AS auto, created, 0 AS source_rank
      FROM charges
      UNION ALL
      SELECT customer, id, coalesce(CAST(json_extract_string(metadata, '$.credits_cents') AS BIGINT), 0), CAST(0 AS BIGINT), 'succeeded',
             false, CAST(NULL AS VARCHAR), false, created, 1
      FROM checkout_sessions WHERE {FREE_SESSION}
      UNION ALL
      SELECT customer, id, coalesce(CAST(json_extract_string(metadata, '$.credits_cents') AS BIGINT), 0), CAST(0 AS BIGINT), 'succeeded',
             false, hosted_invoice_url, coalesce(json_extract_string(metadata, '$.kind') = 'auto_topup', false), created, 2
      FROM invoices WHERE {FREE_INVOICE}
    ) p ON p.customer = a.stripe_customer_id"""


@register("all_purchases", "E2", "SELECT * FROM purchases", {"purchases": _PURCHASES})
def q_all_purchases(fx):
    return PU.all_purchases(fx.accounts, fx.charges, fx.checkout_sessions, fx.invoices, fx.p.app_tag)


@register(
    "purchases_top10", "T2",
    """SELECT * EXCLUDE (rn) FROM (
         SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created DESC, source_rank ASC, id ASC) AS rn
         FROM purchases) WHERE rn <= 10""",
    {"purchases": _PURCHASES},
)
def q_purchases_top10(fx):
    return PU.purchases_top10(PU.all_purchases(fx.accounts, fx.charges, fx.checkout_sessions, fx.invoices, fx.p.app_tag))


@register(
    "purchase_feed", "F7",
    f"""SELECT account_id, id, CASE WHEN disputed THEN 'error' ELSE 'success' END AS status_line,
               {cents_sql('amount_cents')} || CASE WHEN auto THEN ' auto top-up' ELSE ' of credits' END AS title,
               CASE WHEN disputed THEN 'Disputed: not counted'
                    WHEN refunded_cents > 0 THEN 'Refunded ' || {cents_sql('refunded_cents')} END AS detail
        FROM purchases""",
    {"purchases": _PURCHASES},
)
def q_purchase_feed(fx):
    return PU.purchase_feed(PU.all_purchases(fx.accounts, fx.charges, fx.checkout_sessions, fx.invoices, fx.p.app_tag))


_LINES = """
    SELECT account_id, id, service, units, status, price_micros, latency_ms, created_at, false AS simulated FROM usage_events
    UNION ALL
    SELECT account_id, id, 'simulated', 0, CAST(200 AS SMALLINT), amount_micros, CAST(NULL AS INTEGER), created_at, true FROM simulated_spend"""


@register(
    "recent_ledger", "T3",
    """SELECT * EXCLUDE (rn) FROM (
         SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, simulated ASC, id ASC, units ASC,
                                      price_micros ASC, latency_ms ASC NULLS FIRST, status ASC) AS rn
         FROM lines) WHERE rn <= 15""",
    {"lines": _LINES},
)
def q_recent_ledger(fx):
    return PU.recent_ledger(fx.usage_events, fx.simulated_spend)


_LAT = "CASE WHEN latency_ms IS NOT NULL AND latency_ms <> 0 THEN ' · ' || CAST(latency_ms AS VARCHAR) || ' ms' ELSE '' END"


@register(
    "ledger_lines", "F6",
    f"""SELECT account_id, id, created_at,
               CASE WHEN simulated THEN 'warn' WHEN status >= 400 THEN 'error' ELSE 'info' END AS level,
               CASE WHEN simulated THEN 'simulated' WHEN service <> 'moderate' THEN 'earlier' WHEN status >= 400 THEN 'failed'
                    ELSE 'charged' END AS kind,
               CASE WHEN simulated THEN 'simulated usage · ' || {money_sql('price_micros')} || ' · no moderation behind it'
                    WHEN service <> 'moderate' THEN 'earlier API call · ' || {money_sql('price_micros')}
                    WHEN status >= 400 THEN 'scoring failed · not charged' || {_LAT}
                    ELSE CAST(units AS VARCHAR) || CASE WHEN units = 1 THEN ' unit · ' ELSE ' units · ' END
                         || {money_sql('price_micros')} || {_LAT} END AS message
        FROM lines""",
    {"lines": _LINES},
)
def q_ledger_lines(fx):
    return PU.ledger_lines(PU.ledger_and_simulated(fx.usage_events, fx.simulated_spend))


@register(
    "recent_topups", "T4",
    """SELECT account_id, id, amount_cents, status, error, created_at, rn = 1 AS is_last FROM (
         SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS rn FROM topups)
       WHERE rn <= 5""",
)
def q_recent_topups(fx):
    return PU.recent_topups(fx.topups)


@register(
    "latest_card", "J3",
    """SELECT a.account_id, c.payment_method
       FROM accounts a LEFT JOIN (
         SELECT customer, payment_method, row_number() OVER (PARTITION BY customer ORDER BY created DESC, id DESC) AS k
         FROM charges WHERE status = 'succeeded' AND payment_method IS NOT NULL) c
       ON c.customer = a.stripe_customer_id AND c.k = 1""",
)
def q_latest_card(fx):
    return PU.latest_card(fx.accounts, fx.charges)


@register(
    "card_on_file", "J4",
    """SELECT a.account_id, f.id AS charge_id,
              CASE WHEN f.card_last4 IS NOT NULL THEN coalesce(f.card_brand, 'card') END AS card_brand,
              CASE WHEN f.card_last4 IS NOT NULL THEN f.card_last4 END AS card_last4
       FROM accounts a LEFT JOIN (
         SELECT customer, id, card_brand, card_last4,
                row_number() OVER (PARTITION BY customer ORDER BY created DESC, id ASC) AS k
         FROM rc WHERE rn <= 10 AND status = 'succeeded' AND payment_method IS NOT NULL) f
       ON f.customer = a.stripe_customer_id AND f.k = 1""",
    {"rc": _RECENT_CHARGES},
)
def q_card_on_file(fx):
    return PU.card_on_file(fx.accounts, fx.charges)


@register(
    "active_keys", "F5",
    """SELECT key_id, account_id, name, prefix, created_at, last_used_at,
              CAST(row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, key_id DESC) AS INTEGER) AS newest_rank
       FROM api_keys WHERE revoked_at IS NULL""",
)
def q_active_keys(fx):
    return PU.active_keys(fx.api_keys)


@register(
    "active_price", "F11",
    """SELECT key, id, 'price' AS kind FROM (
         SELECT lookup_key AS key, id, row_number() OVER (PARTITION BY lookup_key ORDER BY created DESC, id DESC) AS k
         FROM prices WHERE active) WHERE k = 1
       UNION ALL
       SELECT key, id, 'promotion' AS kind FROM (
         SELECT code AS key, id, row_number() OVER (PARTITION BY code ORDER BY created DESC, id DESC) AS k
         FROM promotion_codes WHERE active) WHERE k = 1""",
)
def q_active_price(fx):
    return PU.active_price(fx.prices, fx.promotion_codes)


@register(
    "log_tail", "T5",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id DESC) AS rn FROM log_lines)
       WHERE rn <= 5000""",
)
def q_log_tail(fx):
    return L.log_tail(fx.log_lines)


@register(
    "log_search", "F8",
    """SELECT t.id, t.stream, t."at", t.timestamp, t.level, t.source, t.message
       FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id DESC) AS rn FROM log_lines) t
       LEFT JOIN (SELECT stream, max("at") AS newest FROM log_lines GROUP BY stream) n ON n.stream = t.stream
       WHERE t.rn <= 5000
         AND (t.level IS NULL OR t.level IN ('error', 'warn', 'info'))
         AND (t."at" IS NULL OR n.newest IS NULL OR t."at" >= n.newest - INTERVAL 1440 MINUTE)
         AND contains(lower(coalesce(t.timestamp, '') || ' ' || coalesce(t.source, '') || ' '
                           || regexp_replace(t.message, chr(27) || '\\[[0-9;]*m', '', 'g')), 'k=1')""",
)
def q_log_search(fx):
    return L.log_search(fx.log_lines, levels=("error", "warn", "info"), time_range="24h", query="  K=1 ")
