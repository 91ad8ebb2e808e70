"""Streaming twins: ST1-ST7 and ST9. Each runs the stream to completion over the available
input, then returns its final state; the oracle is the batch answer."""

from __future__ import annotations

from meterwise.operators import admission as AD
from meterwise.plans import q_lifecycle, q_moderation, q_topups
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import AS_OF, BALANCE_CTES, PURCHASE_ENTRIES
from meterwise.streaming import jobs as J


def _sfx(fx):
    return J.StreamFixtures(fx.spark, fx.sf_dir, params=fx.p)


@register("stream_synced", "ST1", q_lifecycle._TYPED.format(src="latest_raw"), {"latest_raw": q_lifecycle._LATEST_RAW})
def q_stream_synced(fx):
    return q_lifecycle._flat(J.stream_synced(_sfx(fx)))


# Of the rows of an id the first by time, then by the other columns.
_FIRST_WRITES = """SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, account_id, api_key_id NULLS FIRST, service, units, model, input_tokens, cached_input_tokens,
    output_tokens, reasoning_tokens, price_micros, cost_micros, status, latency_ms NULLS FIRST) AS k FROM usage_events) t WHERE k = 1"""


@register("stream_ledger", "ST2", _FIRST_WRITES)
def q_stream_ledger(fx):
    return J.stream_ledger(_sfx(fx))


@register(
    "stream_usage", "ST3",
    """SELECT account_id, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, CAST(count(*) AS INTEGER) AS requests,
              CAST(sum(units) AS BIGINT) AS units, CAST(sum(price_micros) AS BIGINT) AS spent_micros
       FROM usage_events GROUP BY 1, 2""",
)
def q_stream_usage(fx):
    return J.stream_usage(_sfx(fx))


@register("stream_balance", "ST5", "SELECT * FROM balances", BALANCE_CTES)
def q_stream_balance(fx):
    return J.stream_balance(_sfx(fx))


@register(
    "stream_sliding_24h", "ST9",
    f"""SELECT account_id, ws AS window_start, ws + INTERVAL 24 HOUR AS window_end, CAST(count(*) AS INTEGER) AS requests
        FROM (SELECT account_id, date_trunc('hour', created_at) - to_hours(CAST(t.k AS INTEGER)) AS ws
              FROM usage_events CROSS JOIN range(24) AS t(k) WHERE created_at > {AS_OF} - INTERVAL 30 DAY) w
        GROUP BY 1, 2""",
)
def q_stream_sliding(fx):
    return J.stream_sliding_24h(_sfx(fx))


@register(
    "stream_credit_watch", "ST7",
    """SELECT w.watch_id, w.account_id, w.requested_at, min(c.credit_at) AS landed_at,
              CASE WHEN min(c.credit_at) IS NOT NULL THEN 'landed' ELSE 'timed_out' END AS status
       FROM watches w LEFT JOIN credits c
         ON c.account_id = w.account_id AND c.credit_at > w.requested_at AND c.credit_at <= w.requested_at + to_minutes(w.timeout_min)
       GROUP BY 1, 2, 3""",
    {"watches": """SELECT s.id AS watch_id, a.account_id,
                          make_timestamp(s.created * 1000000) - to_minutes(CAST(CAST(split_part(s.id, '_', 2) AS BIGINT) % 15 AS INTEGER)) AS requested_at,
                          10 AS timeout_min
                   FROM checkout_sessions s JOIN accounts a ON a.stripe_customer_id = s.customer WHERE s.mode = 'payment'
                   UNION ALL SELECT 't' || CAST(id AS VARCHAR), account_id, created_at, 7 FROM topups WHERE status <> 'failed'""",
     "entries": PURCHASE_ENTRIES,
     "credits": """SELECT a.account_id, make_timestamp(e.created * 1000000) AS credit_at
                   FROM accounts a JOIN entries e ON e.customer = a.stripe_customer_id
                   WHERE e.micros > 0"""},
)
def q_stream_credit_watch(fx):
    s = _sfx(fx)
    accounts = J._static(s).accounts
    return J.stream_credit_watch(J.watches(s, accounts), J.credits(s, accounts))


_FIRST_TICK = f"SELECT *, {AS_OF} AS commanded_at FROM commands WHERE trigger = 'schedule'"


@register("stream_topups", "ST6", _FIRST_TICK, q_topups.CMD_CTES)
def q_stream_topups(fx):
    s = _sfx(fx)
    return J.stream_topups(s, J.clock(fx.spark, fx.p.as_of), lambda: J.stream_balance(s)).drop("_batch")


@register("stream_admission", "ST4", q_moderation.FOLD_SQL, q_moderation.FOLD_CTES)
def q_stream_admission(fx):
    admitted, outcomes, requests, snap = q_moderation.replay_parts(fx)
    rows = AD.replay_input(admitted, outcomes, requests, fx.usage_events, snap, fx.p.as_of)
    return J.stream_admission(J.staged_stream(rows, "attempts"))
