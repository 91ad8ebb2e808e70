"""Pricing and usage queries: U1-U3, J5-J7, J11, A1-A9, T6, T7."""

from __future__ import annotations

from meterwise.operators import pricing as PR
from meterwise.operators import usage as U
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import AS_OF, BALANCE_CTES, TAG

DAY = "strftime(date_trunc('day', {c}), '%Y-%m-%d')"
D30 = f"created_at > {AS_OF} - INTERVAL 30 DAY"
H24 = f"created_at > {AS_OF} - INTERVAL 24 HOUR"


@register(
    "price_micros", "U1",
    """SELECT u.id, u.account_id, u.service, u.units, u.created_at,
              CAST(coalesce(greatest(CAST(u.units AS BIGINT), 0) * p.unit_price_micros, 0) AS BIGINT) AS price_micros_now
       FROM usage_events u LEFT JOIN service_prices p ON p.service = u.service""",
)
def q_price_micros(fx):
    return PR.price_micros(fx.usage_events, fx.service_prices, out="price_micros_now").select(
        "id", "account_id", "service", "units", "created_at", "price_micros_now")


_U2 = """CAST(coalesce(round(greatest(CAST({i} AS DECIMAL(20,0)) - CAST({c} AS DECIMAL(20,0)), 0) * r.input_usd_per_mtok
                    + CAST({c} AS DECIMAL(20,0)) * r.cached_input_usd_per_mtok
                    + greatest(CAST({o} AS DECIMAL(20,0)) - CAST({r} AS DECIMAL(20,0)), 0) * r.output_usd_per_mtok
                    + CAST({r} AS DECIMAL(20,0)) * r.reasoning_usd_per_mtok), 0) AS BIGINT)"""
_U2_COLS = dict(i="u.input_tokens", c="u.cached_input_tokens", o="u.output_tokens", r="u.reasoning_tokens")


@register(
    "price_micros_tokens", "U2",
    f"""SELECT u.id, u.account_id, u.model, u.created_at, {_U2.format(**_U2_COLS)} AS repriced_micros
        FROM usage_events u LEFT JOIN model_rates r ON r.model = u.model""",
)
def q_price_micros_tokens(fx):
    return PR.price_micros_tokens(fx.usage_events, fx.model_rates).select("id", "account_id", "model", "created_at", "repriced_micros")


@register(
    "cost_micros", "U3",
    """SELECT u.id, u.account_id, u.model, u.created_at, u.cost_micros,
              CAST(coalesce(round(greatest(CAST(u.input_tokens AS DECIMAL(20,0)) - CAST(u.cached_input_tokens AS DECIMAL(20,0)), 0) * c.input_usd_per_mtok
                             + CAST(u.cached_input_tokens AS DECIMAL(20,0)) * c.cached_input_usd_per_mtok
                             + CAST(u.output_tokens AS DECIMAL(20,0)) * c.output_usd_per_mtok), 0) AS BIGINT) AS cost_micros_now
       FROM usage_events u LEFT JOIN model_costs c ON c.model = u.model""",
)
def q_cost_micros(fx):
    return PR.cost_micros(fx.usage_events, fx.model_costs).select("id", "account_id", "model", "created_at", "cost_micros", "cost_micros_now")


@register(
    "price_lookup", "J6",
    """SELECT a.account_id, CAST(coalesce(b.balance_micros, 0) AS BIGINT) AS balance_micros,
              (SELECT p.unit_price_micros FROM service_prices p WHERE p.service = 'moderate' AND p.active) AS unit_price_micros
       FROM accounts a LEFT JOIN balances b ON b.account_id = a.account_id""",
    BALANCE_CTES,
)
def q_price_lookup(fx):
    return PR.price_lookup(fx.accounts, fx.balances, fx.service_prices, fx.p.service)


@register(
    "price_asof", "J7",
    """SELECT u.id, u.account_id, u.service, u.units, u.created_at, u.price_micros, r.unit_price_asof
       FROM usage_events u LEFT JOIN (
         SELECT service, unit_price_micros AS unit_price_asof, valid_from,
                lead(valid_from) OVER (PARTITION BY service ORDER BY valid_from) AS valid_to
         FROM price_history) r
       ON r.service = u.service AND u.created_at >= r.valid_from AND (r.valid_to IS NULL OR u.created_at < r.valid_to)""",
)
def q_price_asof(fx):
    return PR.price_asof(fx.usage_events, fx.price_history).select(
        "id", "account_id", "service", "units", "created_at", "price_micros", "unit_price_asof")


@register(
    "daily_usage", "A1",
    f"""SELECT account_id, {DAY.format(c='created_at')} AS day, CAST(count(*) AS INTEGER) AS requests,
               CAST(sum(units) AS BIGINT) AS units, CAST(sum(price_micros) AS BIGINT) AS spent_micros
        FROM usage_events WHERE {D30} GROUP BY 1, 2""",
)
def q_daily_usage(fx):
    return U.daily_usage(fx.usage_events, fx.p.as_of)


_DAILY_SIM = f"""SELECT account_id, {DAY.format(c='created_at')} AS day, CAST(sum(amount_micros) AS BIGINT) AS spent_micros
                 FROM simulated_spend WHERE {D30} GROUP BY 1, 2"""


@register("daily_simulated", "A2", _DAILY_SIM)
def q_daily_simulated(fx):
    return U.daily_simulated(fx.simulated_spend, fx.p.as_of)


_MERGED = f"""
    SELECT coalesce(r.account_id, s.account_id) AS account_id, coalesce(r.day, s.day) AS day,
           CAST(coalesce(r.requests, 0) AS INTEGER) AS requests, CAST(coalesce(r.units, 0) AS BIGINT) AS units,
           CAST(coalesce(r.spent_micros, 0) AS BIGINT) AS spent_micros, CAST(coalesce(s.spent_micros, 0) AS BIGINT) AS simulated_micros
    FROM (SELECT account_id, {DAY.format(c='created_at')} AS day, count(*) AS requests, sum(units) AS units, sum(price_micros) AS spent_micros
          FROM usage_events WHERE {D30} GROUP BY 1, 2) r
    FULL OUTER JOIN ({_DAILY_SIM}) s ON r.account_id = s.account_id AND r.day = s.day"""


@register("daily_merged", "A3", _MERGED)
def q_daily_merged(fx):
    return U.daily_merged(fx.usage_events, fx.simulated_spend, fx.p.as_of)


@register(
    "daily_totals", "J11",
    f"""SELECT coalesce(r.day, s.day) AS day,
               CAST(coalesce(r.requests, 0) AS INTEGER) AS requests, CAST(coalesce(r.units, 0) AS BIGINT) AS units,
               CAST(coalesce(r.spent_micros, 0) AS BIGINT) AS spent_micros, CAST(coalesce(s.spent_micros, 0) AS BIGINT) AS simulated_micros
        FROM (SELECT {DAY.format(c='created_at')} AS day, count(*) AS requests, sum(units) AS units, sum(price_micros) AS spent_micros
              FROM usage_events WHERE {D30} GROUP BY 1) r
        FULL OUTER JOIN (SELECT {DAY.format(c='created_at')} AS day, sum(amount_micros) AS spent_micros
                         FROM simulated_spend WHERE {D30} GROUP BY 1) s ON r.day = s.day""",
)
def q_daily_totals(fx):
    return U.daily_totals(fx.usage_events, fx.simulated_spend, fx.p.as_of)


@register(
    "limit_status", "A4",
    f"""SELECT a.account_id, CAST(coalesce(w.used, 0) AS INTEGER) AS used,
               CAST(greatest(0, 2 - coalesce(w.used, 0)) AS INTEGER) AS remaining,
               w.oldest_at + INTERVAL 24 HOUR AS next_slot_at
        FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS used, min(created_at) AS oldest_at
                                   FROM usage_events WHERE {H24} GROUP BY 1) w ON w.account_id = a.account_id""",
)
def q_limit_status(fx):
    return U.limit_status(fx.accounts, fx.usage_events, fx.p.as_of)


@register(
    "key_usage_24h", "J5",
    f"""SELECT k.key_id, k.account_id, CAST(coalesce(w.used, 0) AS INTEGER) AS used_24h, w.oldest_at,
               w.oldest_at + INTERVAL 24 HOUR AS next_slot_at
        FROM api_keys k LEFT JOIN (SELECT account_id, count(*) AS used, min(created_at) AS oldest_at
                                   FROM usage_events WHERE {H24} GROUP BY 1) w ON w.account_id = k.account_id
        WHERE k.revoked_at IS NULL""",
)
def q_key_usage_24h(fx):
    return U.key_usage_24h(fx.api_keys, fx.usage_events, fx.p.as_of)


@register(
    "kpi_30d", "A5",
    f"""SELECT account_id, CAST(sum(spent_micros) + sum(simulated_micros) AS BIGINT) AS spend_micros,
               CAST(sum(simulated_micros) AS BIGINT) AS simulated_micros, CAST(sum(units) AS BIGINT) AS items
        FROM ({_MERGED}) m GROUP BY account_id""",
)
def q_kpi_30d(fx):
    return U.kpi_30d(fx.usage_events, fx.simulated_spend, fx.p.as_of)


RATE_IMPACT_SQL = f"""SELECT u.*, {_U2.format(i='u.input_tokens', c='u.cached_input_tokens', o='u.output_tokens', r='u.reasoning_tokens')} AS repriced_micros
        FROM (SELECT account_id, model, CAST(count(*) AS INTEGER) AS requests,
                     CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
                     CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
                     CAST(sum(price_micros) AS BIGINT) AS charged_micros, CAST(sum(cost_micros) AS BIGINT) AS cost_micros
              FROM usage_events WHERE {D30} GROUP BY account_id, model) u
        LEFT JOIN model_rates r ON r.model = u.model"""


@register(
    "rate_impact_30d", "A6",
    RATE_IMPACT_SQL,
)
def q_rate_impact(fx):
    return U.rate_impact_30d(fx.usage_events, fx.model_rates, fx.p.as_of)


@register(
    "margin", "A7",
    f"""SELECT account_id, model, day, revenue_micros, cost_micros,
               CASE WHEN revenue_micros > 0 THEN CAST(revenue_micros - cost_micros AS DOUBLE) / CAST(revenue_micros AS DOUBLE) * 100.0 END AS margin_pct
        FROM (SELECT account_id, model, {DAY.format(c='created_at')} AS day, CAST(sum(price_micros) AS BIGINT) AS revenue_micros,
                     CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM usage_events GROUP BY 1, 2, 3) g""",
)
def q_margin(fx):
    return U.margin(fx.usage_events)


_SERIES = """
    SELECT account_id, 'spend' AS series_id, 'micros' AS unit, CAST(price_micros AS BIGINT) AS value FROM usage_events
    UNION ALL SELECT account_id, 'items', 'units', CAST(units AS BIGINT) FROM usage_events
    UNION ALL SELECT account_id, 'latency', 'ms', CAST(latency_ms AS BIGINT) FROM usage_events
    UNION ALL SELECT account_id, 'tokens', NULL, CAST(input_tokens + output_tokens AS BIGINT) FROM usage_events"""


@register(
    "series_totals", "A8",
    """SELECT p.account_id, p.unit, p.total, p.series, u.n > 1 AS mixed_units
       FROM (SELECT account_id, unit, CAST(sum(value) AS BIGINT) AS total, CAST(count(DISTINCT series_id) AS INTEGER) AS series
             FROM series GROUP BY account_id, unit) p
       JOIN (SELECT account_id, count(DISTINCT unit) + max(CASE WHEN unit IS NULL THEN 1 ELSE 0 END) AS n
             FROM series GROUP BY account_id) u ON u.account_id = p.account_id""",
    {"series": _SERIES},
)
def q_series_totals(fx):
    return U.series_totals(U.ledger_series(fx.usage_events))


@register(
    "series_sums", "A8",
    "SELECT account_id, unit, series_id, CAST(sum(value) AS BIGINT) AS total FROM series GROUP BY account_id, unit, series_id",
    {"series": _SERIES},
)
def q_series_sums(fx):
    return U.ledger_series(fx.usage_events)


@register(
    "usage_rollup", "A9",
    """SELECT account_id, g AS granularity, date_trunc(g, created_at) AS bucket, CAST(count(*) AS INTEGER) AS requests,
              CAST(sum(units) AS BIGINT) AS units, CAST(sum(price_micros) AS BIGINT) AS spent_micros
       FROM usage_events CROSS JOIN (VALUES ('hour'), ('day'), ('month')) AS t(g)
       GROUP BY 1, 2, 3""",
)
def q_usage_rollup(fx):
    return U.usage_rollup(fx.usage_events)


@register(
    "rolling_24h", "T6",
    """SELECT id, account_id, created_at,
              CAST(count(*) OVER w AS INTEGER) AS used_24h, min(created_at) OVER w + INTERVAL 24 HOUR AS slot_at
       FROM usage_events
       WINDOW w AS (PARTITION BY account_id ORDER BY epoch_us(created_at) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
)
def q_rolling_24h(fx):
    return U.rolling_24h(fx.usage_events)


@register(
    "running_balance", "T7",
    f"""SELECT account_id, entry_id, entry_at, delta_micros,
               CAST(sum(delta_micros) OVER (PARTITION BY account_id ORDER BY entry_at, entry_rank, entry_id, delta_micros
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance_micros
        FROM (
          SELECT a.account_id, e.id AS entry_id, make_timestamp(e.created * 1000000) AS entry_at, e.micros AS delta_micros, 0 AS entry_rank
          FROM accounts a JOIN (
            SELECT customer, id, (amount - amount_refunded) * 10000 AS micros, created FROM charges
            WHERE status = 'succeeded' AND paid AND NOT disputed AND currency = 'usd'
            UNION ALL SELECT customer, id, CAST(coalesce(json_extract_string(metadata, '$.credits_cents'), '0') AS BIGINT) * 10000, created
            FROM checkout_sessions WHERE mode = 'payment' AND status = 'complete' AND payment_status IN ('paid', 'no_payment_required') AND amount_total = 0
            UNION ALL SELECT customer, id, CAST(coalesce(json_extract_string(metadata, '$.credits_cents'), '0') AS BIGINT) * 10000, created
            FROM invoices WHERE status = 'paid' AND total = 0 AND json_extract_string(metadata, '$.app') = '{TAG}'
          ) e ON e.customer = a.stripe_customer_id
          UNION ALL SELECT account_id, 'u' || CAST(id AS VARCHAR), created_at, -price_micros, 1 FROM usage_events
          UNION ALL SELECT account_id, 's' || CAST(id AS VARCHAR), created_at, -amount_micros, 2 FROM simulated_spend
        ) entries""",
)
def q_running_balance(fx):
    return U.running_balance(U.wallet_entries(fx.accounts, fx.charges, fx.checkout_sessions, fx.invoices,
                                              fx.usage_events, fx.simulated_spend, fx.p.app_tag))

