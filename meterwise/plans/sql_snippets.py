"""DuckDB SQL pieces reused by several oracle queries."""

from meterwise.config import DEFAULT

TAG = DEFAULT.app_tag
AS_OF = f"TIMESTAMP '{DEFAULT.as_of_sql}'"

FACE = "CAST(coalesce(json_extract_string({m}, '$.credits_cents'), '0') AS BIGINT) * 10000"

SETTLED = "status = 'succeeded' AND paid AND NOT disputed AND currency = 'usd'"
FREE_SESSION = ("mode = 'payment' AND status = 'complete' AND payment_status IN ('paid', 'no_payment_required') "
                "AND amount_total = 0")
FREE_INVOICE = f"status = 'paid' AND total = 0 AND json_extract_string(metadata, '$.app') = '{TAG}'"

PURCHASE_ENTRIES = f"""
    SELECT customer, id, 'charge' AS source, (amount - amount_refunded) * 10000 AS micros, created FROM charges
    WHERE status = 'succeeded' AND paid AND NOT disputed AND currency = 'usd'
    UNION ALL SELECT customer, id, 'session', CAST(coalesce(json_extract_string(metadata, '$.credits_cents'), '0') AS BIGINT) * 10000, created
    FROM checkout_sessions WHERE mode = 'payment' AND status = 'complete' AND payment_status IN ('paid', 'no_payment_required') AND amount_total = 0
    UNION ALL SELECT customer, id, 'invoice', CAST(coalesce(json_extract_string(metadata, '$.credits_cents'), '0') AS BIGINT) * 10000, created
    FROM invoices WHERE status = 'paid' AND total = 0 AND json_extract_string(metadata, '$.app') = '{TAG}'"""

# One signed list of every movement of money on an account (credits up, spend down) and a
# zero opening row per account: the wallet is one grouping of it, with no join per source.
MOVEMENTS = f"""
    SELECT account_id, 'opening' AS kind, CAST(0 AS BIGINT) AS delta FROM accounts
    UNION ALL SELECT account_id, 'usage', -price_micros FROM usage_events
    UNION ALL SELECT account_id, 'simulated', -amount_micros FROM simulated_spend
    UNION ALL SELECT owner.account_id, entry.source, entry.micros
    FROM ({PURCHASE_ENTRIES}) entry JOIN accounts owner ON owner.stripe_customer_id = entry.customer"""


def moved(*kinds: str) -> str:
    """Per account, the size of its movements of the given kinds (accounts without any are absent)."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"SELECT account_id, CAST(abs(sum(delta)) AS BIGINT) AS micros FROM movements WHERE kind IN ({names}) GROUP BY account_id"


BALANCES = """
    SELECT account_id, CAST(balance + down AS BIGINT) AS purchased_micros, CAST(down AS BIGINT) AS spent_micros,
           CAST(balance AS BIGINT) AS balance_micros
    FROM (SELECT account_id, sum(delta) AS balance,
                 coalesce(-sum(delta) FILTER (kind IN ('usage', 'simulated')), 0) AS down
          FROM movements GROUP BY account_id HAVING bool_or(kind = 'opening'))"""

BALANCE_CTES = {"movements": MOVEMENTS, "balances": BALANCES}
MOVEMENT_CTES = {"movements": MOVEMENTS}


def money_sql(m: str) -> str:
    """DuckDB twin of ``scalars.money_text``."""
    a = f"abs(CAST({m} AS BIGINT))"
    two, four = f"(({a} + 5000) // 10000)", f"(({a} + 50) // 100)"
    return (f"(CASE WHEN {m} < 0 THEN '-' ELSE '' END || '$' || CASE "
            f"WHEN {a} >= 1000000 THEN format('{{:,}}', {two} // 100) || '.' || lpad(CAST({two} % 100 AS VARCHAR), 2, '0') "
            f"WHEN {a} >= 10000 THEN format('{{:,}}', {four} // 10000) || '.' || lpad(CAST({four} % 10000 AS VARCHAR), 4, '0') "
            f"ELSE format('{{:,}}', {a} // 1000000) || '.' || lpad(CAST({a} % 1000000 AS VARCHAR), 6, '0') END)")


def cents_sql(c: str) -> str:
    """DuckDB twin of ``scalars.cents_text``."""
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', (abs(CAST({c} AS BIGINT)) + 50) // 100))"
