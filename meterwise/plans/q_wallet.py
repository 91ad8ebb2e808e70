"""Wallet queries: F1-F4, J1, J2, E1, W1-W5."""

from __future__ import annotations

from meterwise.operators import wallet as W
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import BALANCE_CTES, FACE, FREE_INVOICE, FREE_SESSION, MOVEMENT_CTES, SETTLED, moved


@register("settled_charges", "F1", f"SELECT * FROM charges WHERE {SETTLED}")
def q_settled_charges(fx):
    return W.settled_charges(fx.charges)


@register("free_sessions", "F2", f"SELECT * FROM checkout_sessions WHERE {FREE_SESSION}")
def q_free_sessions(fx):
    return W.free_sessions(fx.checkout_sessions)


@register("free_invoices", "F3", f"SELECT * FROM invoices WHERE {FREE_INVOICE}")
def q_free_invoices(fx):
    return W.free_invoices(fx.invoices, fx.p.app_tag)


@register(
    "face_value", "F4",
    f"SELECT id, customer, {FACE.format(m='metadata')} AS face_micros FROM checkout_sessions "
    f"UNION ALL SELECT id, customer, {FACE.format(m='metadata')} AS face_micros FROM invoices",
)
def q_face_value(fx):
    return W.face_values(fx.checkout_sessions, fx.invoices)


@register(
    "account_charges", "J1",
    """SELECT a.account_id, ch.id AS charge_id, ch.amount, ch.amount_refunded, ch.status, ch.created
       FROM accounts a JOIN charges ch ON ch.customer = a.stripe_customer_id""",
)
def q_account_charges(fx):
    return W.account_charges(fx.accounts, fx.charges)


@register("purchased_charges", "W1", moved("charge"), MOVEMENT_CTES)
def q_purchased_charges(fx):
    return W.purchased_charges(fx.accounts, fx.charges)


@register("purchased_sessions", "W2", moved("session"), MOVEMENT_CTES)
def q_purchased_sessions(fx):
    return W.purchased_sessions(fx.accounts, fx.checkout_sessions)


@register("purchased_invoices", "W3", moved("invoice"), MOVEMENT_CTES)
def q_purchased_invoices(fx):
    return W.purchased_invoices(fx.accounts, fx.invoices, fx.p.app_tag)


@register("all_spend", "E1",
          "SELECT account_id, price_micros AS micros, 'usage' AS source FROM usage_events "
          "UNION ALL SELECT account_id, amount_micros AS micros, 'simulated' AS source FROM simulated_spend")
def q_all_spend(fx):
    return W.all_spend(fx.usage_events, fx.simulated_spend)


@register("spent", "W4", moved("usage", "simulated"), MOVEMENT_CTES)
def q_spent(fx):
    return W.spent(fx.usage_events, fx.simulated_spend)


@register(
    "wallet_assembly", "J2",
    """SELECT account_id, CAST(coalesce(sum(delta) FILTER (kind = 'charge'), 0) AS BIGINT) AS charges_micros,
              CAST(coalesce(sum(delta) FILTER (kind = 'session'), 0) AS BIGINT) AS sessions_micros,
              CAST(coalesce(sum(delta) FILTER (kind = 'invoice'), 0) AS BIGINT) AS invoices_micros,
              CAST(coalesce(-sum(delta) FILTER (kind IN ('usage', 'simulated')), 0) AS BIGINT) AS spent_micros
       FROM movements GROUP BY account_id HAVING bool_or(kind = 'opening')""",
    MOVEMENT_CTES,
)
def q_wallet_assembly(fx):
    return W.wallet_parts(fx.accounts, fx.charges, fx.checkout_sessions, fx.invoices, fx.usage_events, fx.simulated_spend, fx.p.app_tag)


@register("balances", "W5", "SELECT * FROM balances", BALANCE_CTES)
def q_balances(fx):
    return fx.balances
