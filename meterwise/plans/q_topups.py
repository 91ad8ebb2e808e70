"""Top-up and debit queries: J8-J10, U-T1..U-T6, U-D1, U-D2."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterwise.operators import topups as TU
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import AS_OF, BALANCE_CTES
from meterwise.config import DEFAULT

SLOT = TU.cooldown_slot(DEFAULT.as_of)
TAG = DEFAULT.app_tag
CODE = DEFAULT.promotion_code

_CARDS = """SELECT customer AS stripe_customer_id, last(payment_method ORDER BY created, id) AS payment_method
            FROM charges WHERE status = 'succeeded' AND payment_method IS NOT NULL GROUP BY customer"""
# What an account's top-up rows say about it: how many, whether one is recent, whether a
# recent one still waits for its paid invoice.
_HISTORY = f"""SELECT account_id, CAST(count(t.id) AS INTEGER) AS attempts, coalesce(bool_or(recent), false) AS cooling,
                      coalesce(bool_or(recent AND t.status <> 'failed'
                                       AND (t.invoice_id IS NULL OR t.invoice_id NOT IN (FROM paid_invoices))), false) AS waiting
               FROM accounts LEFT JOIN (SELECT *, created_at > {AS_OF} - INTERVAL 15 MINUTE AS recent FROM topups) t USING (account_id)
               GROUP BY account_id"""
_PAID = "SELECT DISTINCT id FROM invoices WHERE status = 'paid' AND id IS NOT NULL"


def _due(rule: str) -> str:
    """Accounts under their threshold that also meet ``rule``, in the columns of a candidate."""
    return f"""SELECT account_id, stripe_customer_id AS customer, payment_method, auto_topup_amount_cents AS amount_cents, purchased_micros, attempts
               FROM accounts JOIN history USING (account_id) JOIN balances USING (account_id) LEFT JOIN cards USING (stripe_customer_id)
               WHERE stripe_customer_id IS NOT NULL AND auto_topup_threshold_micros > balance_micros AND {rule}"""


_SCHEDULED = _due("auto_topup_enabled AND NOT cooling")
_MANUAL = _due("NOT waiting")
_HAS_CARD = " AND payment_method IS NOT NULL"

HISTORY_CTES = {"paid_invoices": _PAID, "history": _HISTORY}
CTES = {**BALANCE_CTES, **HISTORY_CTES, "cards": _CARDS}
CAND_CTES = {**CTES, "scheduled": _SCHEDULED, "manual": _MANUAL}


@register("topup_attempts", "J8", "SELECT account_id, attempts FROM history", HISTORY_CTES)
def q_topup_attempts(fx):
    return TU.topup_attempts(fx.accounts, fx.topups)


@register("cooldown_anti", "J9", "SELECT a.* FROM accounts a JOIN history USING (account_id) WHERE NOT cooling", HISTORY_CTES)
def q_cooldown_anti(fx):
    return TU.cooldown_clear(fx.accounts, fx.topups, fx.p.as_of)


@register("pending_anti", "J10", "SELECT a.* FROM accounts a JOIN history USING (account_id) WHERE NOT waiting", HISTORY_CTES)
def q_pending_anti(fx):
    return TU.pending_clear(fx.accounts, fx.topups, fx.invoices, fx.p.as_of)


def _scheduled(fx, balances=None, free_mode=True):
    b = fx.balances if balances is None else balances
    return TU.topup_scheduled(fx.accounts, b, fx.charges, fx.topups, fx.p.as_of, free_mode)


def _manual(fx, balances=None, free_mode=True):
    b = fx.balances if balances is None else balances
    return TU.topup_manual(fx.accounts, b, fx.charges, fx.topups, fx.invoices, fx.p.as_of, free_mode)


@register("topup_scheduled", "U-T1", _SCHEDULED, CTES)
def q_topup_scheduled(fx):
    return _scheduled(fx)


@register("topup_manual", "U-T2", _MANUAL, CTES)
def q_topup_manual(fx):
    return _manual(fx)


@register("topup_scheduled_paid", "U-T1", _SCHEDULED + _HAS_CARD, CTES)
def q_topup_scheduled_paid(fx):
    return _scheduled(fx, free_mode=False)


@register("topup_manual_paid", "U-T2", _MANUAL + _HAS_CARD, CTES)
def q_topup_manual_paid(fx):
    return _manual(fx, free_mode=False)


_KEYS = f"""SELECT account_id, 'schedule' AS trigger, 'topup:' || CAST(account_id AS VARCHAR) || ':{SLOT}' AS idempotency_key FROM scheduled
            UNION
            SELECT account_id, 'manual', 'topup:' || CAST(account_id AS VARCHAR) || ':manual:' || CAST(purchased_micros AS VARCHAR)
                   || ':' || CAST(attempts AS VARCHAR) FROM manual"""


@register("topup_keys", "U-T3", _KEYS, CAND_CTES)
def q_topup_keys(fx):
    snap = fx.wallet_snapshot
    return TU.topup_keys(_scheduled(fx, snap), _manual(fx, snap), fx.p.as_of)


def _commands_sql(src: str, trigger: str) -> str:
    key = (f"'topup:' || CAST(c.account_id AS VARCHAR) || ':{SLOT}'" if trigger == "schedule" else
           "'topup:' || CAST(c.account_id AS VARCHAR) || ':manual:' || CAST(c.purchased_micros AS VARCHAR) || ':' || CAST(c.attempts AS VARCHAR)")
    return f"""SELECT c.account_id, c.customer, c.amount_cents, p.promotion_id, CAST(NULL AS VARCHAR) AS payment_method,
                      {key} AS idempotency_key,
                      json_object('app', '{TAG}', 'account_id', CAST(c.account_id AS VARCHAR), 'kind', 'auto_topup',
                                  'trigger', '{trigger}', 'credits_cents', CAST(c.amount_cents AS VARCHAR))::VARCHAR AS metadata,
                      '{trigger}' AS trigger,
                      CASE WHEN p.promotion_id IS NULL THEN 'failed' ELSE 'send' END AS action,
                      CASE WHEN p.promotion_id IS NULL THEN 'Promotion code {CODE} isn''t synced yet.' END AS error
               FROM {src} c LEFT JOIN promo p ON true"""


_PROMO = f"""SELECT id AS promotion_id FROM (
               SELECT id, row_number() OVER (ORDER BY created DESC, id DESC) AS k FROM promotion_codes
               WHERE code = '{CODE}' AND active) WHERE k = 1"""
CMD_CTES = {**CAND_CTES, "promo": _PROMO,
            "commands": _commands_sql("scheduled", "schedule") + " UNION ALL " + _commands_sql("manual", "manual")}


def _commands(fx, free_mode=True):
    p = fx.p
    snap = fx.wallet_snapshot  # both candidate sets read the same wallet once
    s = TU.topup_commands(_scheduled(fx, snap, free_mode), fx.promotion_codes, p.promotion_code, p.app_tag, free_mode, "schedule", p.as_of)
    m = TU.topup_commands(_manual(fx, snap, free_mode), fx.promotion_codes, p.promotion_code, p.app_tag, free_mode, "manual", p.as_of)
    return s.unionByName(m)


@register("topup_commands", "U-T4", "SELECT * FROM commands", CMD_CTES)
def q_topup_commands(fx):
    return _commands(fx)


_PAID_COMMANDS = f"""SELECT account_id, customer, amount_cents, CAST(NULL AS VARCHAR) AS promotion_id, payment_method,
              concat_ws(':', 'topup', account_id, CASE trigger WHEN 'schedule' THEN '{SLOT}' ELSE concat_ws(':', 'manual', purchased_micros, attempts) END) AS idempotency_key,
              json_object('app', '{TAG}', 'account_id', CAST(account_id AS VARCHAR), 'kind', 'auto_topup',
                          'trigger', trigger, 'credits_cents', CAST(amount_cents AS VARCHAR))::VARCHAR AS metadata,
              trigger, 'send' AS action, CAST(NULL AS VARCHAR) AS error
       FROM (SELECT *, 'schedule' AS trigger FROM scheduled UNION ALL SELECT *, 'manual' FROM manual)
       WHERE payment_method IS NOT NULL"""


@register("topup_commands_paid", "U-T4", _PAID_COMMANDS, CAND_CTES)
def q_topup_commands_paid(fx):
    return _commands(fx, free_mode=False)


def payment_replies(commands):
    """Stand-in for the payment service's replies, derived from the commands (tests only)."""
    a = F.col("account_id")
    declined = F.pmod(a, F.lit(7)) == 3
    return commands.select(
        "idempotency_key",
        F.when(~declined, F.concat(F.lit("in_new_"), a.cast("string"), F.lit("_"), F.col("trigger"))).alias("invoice_id"),
        F.when(~declined & (F.pmod(a, F.lit(2)) == 1), F.lit("paid")).alias("invoice_status"),
        F.when(declined, F.lit("Your card was declined.")).alias("reply_error"),
    )


_REPLIES = """SELECT idempotency_key,
                     CASE WHEN account_id % 7 <> 3 THEN 'in_new_' || CAST(account_id AS VARCHAR) || '_' || trigger END AS invoice_id,
                     CASE WHEN account_id % 7 <> 3 AND account_id % 2 = 1 THEN 'paid' END AS invoice_status,
                     CASE WHEN account_id % 7 = 3 THEN 'Your card was declined.' END AS reply_error
              FROM commands"""


OUTCOMES_SQL = """SELECT c.account_id, CASE WHEN ok THEN r.invoice_id END AS invoice_id, c.amount_cents,
              CASE WHEN ok THEN coalesce(r.invoice_status, 'open') ELSE 'failed' END AS status,
              CASE WHEN ok THEN NULL ELSE coalesce(c.error, r.reply_error, 'Auto top-up failed.') END AS error,
              (NOT ok) AND c.trigger = 'schedule' AS disable_auto_topup
       FROM commands c LEFT JOIN replies r ON r.idempotency_key = c.idempotency_key,
            LATERAL (SELECT c.action = 'send' AND r.invoice_id IS NOT NULL AS ok)"""
OUTCOME_CTES = {**CMD_CTES, "replies": _REPLIES}


@register(
    "topup_outcomes", "U-T5",
    OUTCOMES_SQL,
    {**CMD_CTES, "replies": _REPLIES},
)
def q_topup_outcomes(fx):
    c = _commands(fx)
    return TU.topup_outcomes(c, payment_replies(c))


@register(
    "topup_available", "U-T6",
    """SELECT a.account_id, a.stripe_customer_id IS NOT NULL AND coalesce(b.purchased_micros, 0) > 0 AS available_free,
              f.id IS NOT NULL AS available_paid
       FROM accounts a LEFT JOIN balances b ON b.account_id = a.account_id
       LEFT JOIN (SELECT customer, id, row_number() OVER (PARTITION BY customer ORDER BY created DESC, id ASC) AS k
                  FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY created DESC, id ASC) AS rn FROM charges)
                  WHERE rn <= 10 AND status = 'succeeded' AND payment_method IS NOT NULL) f
         ON f.customer = a.stripe_customer_id AND f.k = 1""",
    BALANCE_CTES,
)
def q_topup_available(fx):
    return TU.topup_available(fx.accounts, fx.balances, fx.charges)


@register("debit_capped", "U-D1",
          "SELECT account_id, amount_micros FROM (SELECT account_id, CAST(least(5000000, balance_micros) AS BIGINT) AS amount_micros FROM balances) WHERE amount_micros > 0",
          BALANCE_CTES)
def q_debit_capped(fx):
    return TU.debit_amount(fx.balances, 500)


@register(
    "debit_below_threshold", "U-D2",
    """SELECT account_id, amount_micros FROM (
         SELECT b.account_id, CAST(least(b.balance_micros - a.auto_topup_threshold_micros + 10000, b.balance_micros) AS BIGINT) AS amount_micros
         FROM balances b JOIN accounts a ON a.account_id = b.account_id) WHERE amount_micros > 0""",
    BALANCE_CTES,
)
def q_debit_below_threshold(fx):
    return TU.debit_below_threshold(fx.accounts, fx.balances)
