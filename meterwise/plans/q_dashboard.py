"""A10, field by field: the twin reads each part as its own query does and joins them by account."""

from __future__ import annotations

from meterwise.plans import dashboard as D
from meterwise.plans import q_moderation, q_purchases, q_topups, q_usage, q_wallet  # noqa: F401  the parts' twins
from meterwise.plans.registry import REGISTRY, register


def _line(*cols: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in cols) + ")"


def _list(source: str, order: str, *cols: str) -> str:
    return f"SELECT account_id, list({_line(*cols)} ORDER BY {order}) AS l FROM {source} GROUP BY account_id"


_PARTS = ("balances", "limit_status", "card_on_file", "topup_available", "purchases_top10", "recent_topups", "daily_merged", "recent_ledger")
_CTES: dict[str, str] = {}
for _n in _PARTS:
    _CTES |= REGISTRY[_n].oracle_ctes or {}
    if _n not in _CTES:
        _CTES[f"own_{_n}"] = REGISTRY[_n].oracle
_LIVE = f"""(SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, key_id DESC) AS k FROM api_keys WHERE revoked_at IS NULL)"""
_CTES |= {
    "l_purchases": _list("own_purchases_top10", "created DESC, source_rank, id", "id", "amount_cents", "refunded_cents", "status", "disputed", "receipt_url", "auto", "created"),
    "l_topups": _list("own_recent_topups", "created_at DESC, id DESC", "id", "amount_cents", "status", "error", "epoch_us(created_at)"),
    "l_keys": _list(f"{_LIVE} WHERE k <= {D.KEYS_SHOWN}", "k", "key_id", "name", "prefix", "epoch_us(created_at)", "epoch_us(last_used_at)"),
    "l_daily": _list("own_daily_merged", "day", "day", "requests", "units", "spent_micros", "simulated_micros"),
    "l_recent": _list("own_recent_ledger", "created_at DESC, simulated, id, units, price_micros, latency_ms NULLS FIRST, status",
                      "id", "service", "units", "status", "price_micros", "latency_ms", "epoch_us(created_at)", "simulated"),
}
_SQL = """
    SELECT a.account_id, b.purchased_micros, b.spent_micros, b.balance_micros,
           coalesce((SELECT unit_price_micros FROM service_prices WHERE service = 'moderate' AND active), 0) AS unit_price_micros, 2000 AS chars_per_unit,
           c.card_brand, c.card_last4, v.available_free AS available, a.auto_topup_enabled AS enabled,
           CAST(round(a.auto_topup_threshold_micros / 10000) AS BIGINT) AS threshold_cents, a.auto_topup_amount_cents AS topup_cents, a.auto_topup_error AS error,
           2 AS per_day, s.used, s.remaining, s.next_slot_at,
           (SELECT CAST(count(*) AS INTEGER) FROM api_keys k WHERE k.account_id = a.account_id AND k.revoked_at IS NULL) AS n_keys,
           coalesce(p.l, []) AS purchases, coalesce(t.l, []) AS recent_topups, coalesce(k.l, []) AS keys, coalesce(d.l, []) AS daily, coalesce(r.l, []) AS recent
    FROM accounts a JOIN balances b USING (account_id) JOIN own_limit_status s USING (account_id) JOIN own_card_on_file c USING (account_id)
    JOIN own_topup_available v USING (account_id) LEFT JOIN l_purchases p USING (account_id) LEFT JOIN l_topups t USING (account_id)
    LEFT JOIN l_keys k USING (account_id) LEFT JOIN l_daily d USING (account_id) LEFT JOIN l_recent r USING (account_id)"""


@register("dashboard", "A10", _SQL, _CTES)
def q_dashboard(fx):
    return D.flat(D.dashboard(fx))
