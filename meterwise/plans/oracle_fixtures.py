"""The fixture tables of ``meterwise.sources.fixtures`` written as DuckDB CTEs.

Each oracle query names the fixture tables it reads; ``with_fixtures`` prepends
exactly those CTEs (and what they read) in dependency order. The driver's
tables (customer, orders, lineitem, events, ...) are views on the DuckDB side.
"""

from __future__ import annotations

import re

from meterwise.config import DEFAULT

P = DEFAULT
AS_OF = f"TIMESTAMP '{P.as_of_sql}'"
TAG = P.app_tag
KEY = P.key_prefix
OLD = P.old_tag
PH = P.placeholder_domain


def _pack(k: str) -> str:
    return f"(CASE ({k} // 3) % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2500 ELSE 10000 END)"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _ledger(k: str, units: str, status: str, price: str) -> str:
    return f"""'moderate' AS service, CAST({units} AS INTEGER) AS units, 'gpt-oss-20b' AS model,
      CAST(100 + 10 * {k} AS INTEGER) AS input_tokens, CAST({k} AS INTEGER) AS cached_input_tokens,
      CAST(50 + 3 * {k} AS INTEGER) AS output_tokens, CAST({k} AS INTEGER) AS reasoning_tokens,
      CAST({price} AS BIGINT) AS price_micros,
      CAST((7 * CAST(100 + 10 * {k} AS BIGINT) + 30 * CAST(50 + 3 * {k} AS BIGINT) + 50) // 100 AS BIGINT) AS cost_micros,
      CAST({status} AS SMALLINT) AS status,
      CAST(CASE WHEN {k} % 10 = 0 THEN NULL ELSE 200 + {k} END AS INTEGER) AS latency_ms"""

JS_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def items_sql(t: str) -> str:
    """DuckDB twin of ``moderation.item_array``: non-empty trimmed lines."""
    return ("list_filter(list_transform(string_split(" + t + ", chr(10)), lambda x: regexp_replace(x, '^" + JS_SPACE + "+|"
            + JS_SPACE + "+$', '', 'g')), lambda x: x <> '')")


def _base(i: int) -> str:
    return f"'0.' || lpad(CAST(((i.request_id * 7 + i.idx * 13 + {i} * 29) % 1000) * 5 AS VARCHAR), 4, '0')"


_BRK, _EDGE, _FIRST = "i.request_id % 17", "(i.request_id + i.idx) % 50", "i.idx = 0"
_SC = {
    "harassment": f"CASE WHEN {_BRK} = 3 AND {_FIRST} THEN '1.2' WHEN l.toxic = 1 THEN '0.9' ELSE {_base(0)} END",
    "hate": f"""CASE WHEN {_BRK} = 5 AND {_FIRST} THEN '"0.5"' WHEN {_EDGE} = 0 THEN '0.3995' ELSE {_base(1)} END""",
    "sexual": f"CASE WHEN {_EDGE} = 2 THEN '0.4' ELSE {_base(2)} END",
    "violence": f"CASE WHEN {_EDGE} = 1 THEN '0.5005' ELSE {_base(3)} END",
    "self_harm": f"CASE WHEN {_EDGE} = 3 THEN '0.8' ELSE {_base(4)} END",
    "illicit": _base(5),
    "spam": f"CASE WHEN {_BRK} = 8 AND {_FIRST} THEN 'NaN' ELSE {_base(6)} END",
}
_INDEX = (f"CASE WHEN {_BRK} = 4 AND i.idx = c.n - 1 THEN (CASE WHEN c.n > 1 THEN '0' ELSE '1' END) "
          f"WHEN {_BRK} = 6 AND i.idx = 1 THEN '1.0' ELSE CAST(i.idx AS VARCHAR) END")
_REASON = ("""CASE WHEN i.request_id % 13 = 0 THEN '42' WHEN l.toxic = 1 THEN '"harassing language"' """
           """WHEN i.request_id % 11 = 0 THEN '"' || repeat('long reason ', 30) || '"' ELSE '""' END""")
ENTRY_SQL = ("""'{"index":' || """ + _INDEX + """ || ',"scores":{' || """
             + " || ',' || ".join(f"""'"{c}":' || ({e})""" for c, e in _SC.items())
             + """ || '},"reason":' || """ + _REASON + " || '}'")


ORDER_REF = f"CASE WHEN (o_orderkey // 3) % 5 = 0 THEN 'o' || {_s('o_orderkey // 3')} ELSE 'k' || {_s('o_orderkey')} END"

FIXTURE_CTES: dict[str, str] = {
    "accounts": f"""
    SELECT c_custkey AS account_id,
           CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE c_custkey + 1000000 END AS user_id,
           c_name AS label,
           CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'cus_' || {_s('c_custkey')} END AS stripe_customer_id,
           c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS auto_topup_enabled,
           CAST(CASE c_custkey % 3 WHEN 0 THEN 2000000 WHEN 1 THEN 5000000 ELSE 10000000 END AS BIGINT) AS auto_topup_threshold_micros,
           CAST(CASE c_custkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2500 ELSE 10000 END AS INTEGER) AS auto_topup_amount_cents,
           CAST(NULL AS VARCHAR) AS auto_topup_error,
           TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
    FROM customer""",
    "users": f"""
    SELECT c_custkey + 1000000 AS user_id,
           CASE WHEN c_custkey % 8 = 0 THEN 'user' || {_s('c_custkey')} || '@users.{OLD}.invalid'
                WHEN c_custkey % 4 = 0 THEN 'user' || {_s('c_custkey')} || '@{PH}'
                ELSE 'c' || {_s('c_custkey')} || '@example.com' END AS email,
           c_name AS name
    FROM customer""",
    "api_key_creates": f"""
    SELECT c_custkey AS key_id, c_custkey AS account_id, 'default' AS name,
           '{KEY}' || lpad({_s('c_custkey')}, 12, '0') AS key_text,
           TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
    FROM customer WHERE c_custkey % 3 <> 1""",
    "api_keys": f"""
    SELECT key_id, account_id, name, substring(key_text, 1, 12) AS prefix, sha256(key_text) AS key_hash, created_at,
           CAST(NULL AS TIMESTAMP) AS last_used_at,
           CASE WHEN key_id % 7 = 0 THEN {AS_OF} - INTERVAL 1 DAY ELSE CAST(NULL AS TIMESTAMP) END AS revoked_at
    FROM api_key_creates""",
    "service_prices": """
    SELECT * FROM (VALUES ('moderate', CAST(300000 AS BIGINT), true, TIMESTAMP '2024-01-01 00:00:00'),
                          ('chat', CAST(500 AS BIGINT), false, TIMESTAMP '2024-01-01 00:00:00'))
           AS t(service, unit_price_micros, active, updated_at)""",
    "price_history": """
    SELECT * FROM (VALUES ('moderate', CAST(250000 AS BIGINT), TIMESTAMP '2023-01-01 00:00:00'),
                          ('moderate', CAST(300000 AS BIGINT), TIMESTAMP '2024-01-10 00:00:00'),
                          ('moderate', CAST(400000 AS BIGINT), TIMESTAMP '2024-01-25 00:00:00'))
           AS t(service, unit_price_micros, valid_from)""",
    "model_costs": """
    SELECT 'gpt-oss-20b' AS model, CAST(0.07 AS DECIMAL(12,4)) AS input_usd_per_mtok,
           CAST(0.07 AS DECIMAL(12,4)) AS cached_input_usd_per_mtok, CAST(0.30 AS DECIMAL(12,4)) AS output_usd_per_mtok""",
    "model_rates": """
    SELECT 'gpt-oss-20b' AS model, CAST(0.21 AS DECIMAL(12,4)) AS input_usd_per_mtok,
           CAST(0.21 AS DECIMAL(12,4)) AS cached_input_usd_per_mtok, CAST(0.90 AS DECIMAL(12,4)) AS output_usd_per_mtok,
           CAST(0.15 AS DECIMAL(12,4)) AS reasoning_usd_per_mtok""",
    "usage_events": f"""
    SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS account_id,
           CASE WHEN o_custkey % 3 <> 1 THEN o_custkey END AS api_key_id,
           {_ledger('(l_partkey % 100)', 'l_quantity', '200', 'CAST(CAST(l_quantity AS INTEGER) AS BIGINT) * 300000')},
           l_shipdate AS created_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL
    SELECT event_id * 8 AS id, user_id AS account_id,
           CASE WHEN user_id % 3 <> 1 THEN user_id END AS api_key_id,
           {_ledger("CAST(json_extract_string(props, '$.k') AS INTEGER)",
                    "CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 END",
                    "CASE WHEN event_type = 'error' THEN 502 ELSE 200 END",
                    "CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 END AS BIGINT)"
                    " * CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 400000 WHEN ts >= TIMESTAMP '2024-01-10' THEN 300000 ELSE 250000 END")},
           ts AS created_at
    FROM events WHERE event_type <> 'signup'""",
    "simulated_spend": """
    SELECT event_id AS id, user_id AS account_id,
           (1 + CAST(json_extract_string(props, '$.k') AS BIGINT)) * 10000 AS amount_micros, ts AS created_at
    FROM events WHERE event_type = 'signup'""",
    "topups": f"""
    SELECT o_orderkey AS id, o_custkey AS account_id,
           CASE WHEN o_orderkey % 3 = 2 THEN 'in_' || {_s('o_orderkey')} END AS invoice_id,
           CAST({_pack('o_orderkey')} AS INTEGER) AS amount_cents,
           CASE WHEN o_orderkey % 3 <> 2 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'open' ELSE 'paid' END AS status,
           CASE WHEN o_orderkey % 3 <> 2 THEN 'card_declined' END AS error,
           CASE WHEN o_orderkey % 4 = 1 THEN 'manual' ELSE 'schedule' END AS "trigger",
           {AS_OF} - to_minutes(CAST(o_orderkey % 601 AS INTEGER)) AS created_at
    FROM orders""",
    "charges": f"""
    SELECT 'ch_' || {_s('o_orderkey')} AS id, 'cus_' || {_s('o_custkey')} AS customer,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'pm_' || {_s('o_orderkey % 97')} END AS payment_method,
           CASE WHEN o_orderkey % 7 = 0 THEN '{{"type":"card","card":{{"brand":"mastercard"}}}}'
                WHEN o_orderkey % 13 = 0 THEN '{{"type":"card","card":{{"last4":"' || lpad({_s('o_orderkey % 10000')}, 4, '0') || '"}}}}'
                ELSE '{{"type":"card","card":{{"brand":"visa","last4":"' || lpad({_s('o_orderkey % 10000')}, 4, '0') || '"}}}}' END
             AS payment_method_details,
           CAST({_pack('o_orderkey')} AS BIGINT) AS amount,
           CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 500 ELSE 0 END AS BIGINT) AS amount_refunded,
           CASE WHEN o_orderkey % 31 = 0 THEN 'eur' ELSE 'usd' END AS currency,
           CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
           NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS paid,
           o_orderpriority = '1-URGENT' AS refunded,
           CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey % 23 = 0 END AS disputed,
           'https://pay.example/receipts/ch_' || {_s('o_orderkey')} AS receipt_url,
           '{{"app":"{TAG}","kind":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'auto_topup' ELSE 'checkout' END || '","order":"' || {ORDER_REF} || '"}}' AS metadata,
           CAST(epoch(o_orderdate) AS BIGINT) AS created
    FROM orders WHERE o_orderkey % 3 = 0""",
    "checkout_sessions": f"""
    SELECT 'cs_' || {_s('o_orderkey')} AS id, 'cus_' || {_s('o_custkey')} AS customer,
           CASE WHEN o_orderkey % 13 = 0 THEN 'subscription' ELSE 'payment' END AS mode,
           CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'complete' END AS status,
           CASE WHEN o_orderkey % 11 = 0 THEN 'unpaid' ELSE 'no_payment_required' END AS payment_status,
           CAST(CASE WHEN o_orderkey % 29 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS amount_total,
           CASE WHEN o_orderkey % 41 = 0 THEN '{{"app":"{TAG}"'
                ELSE '{{"app":"{TAG}","credits_cents":"' || {_s(_pack('o_orderkey'))} || '"' END || ',"order":"' || {ORDER_REF} || '"}}' AS metadata,
           CAST(epoch(o_orderdate) AS BIGINT) AS created
    FROM orders WHERE o_orderkey % 3 = 1""",
    "invoices": f"""
    SELECT 'in_' || {_s('o_orderkey')} AS id, 'cus_' || {_s('o_custkey')} AS customer,
           CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'paid' END AS status,
           CAST(CASE WHEN o_orderkey % 29 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS total,
           CAST(CASE WHEN o_orderkey % 29 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS amount_paid,
           'https://pay.example/invoices/in_' || {_s('o_orderkey')} AS hosted_invoice_url,
           '{{"app":"' || CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE '{TAG}' END
             || '","kind":"auto_topup","credits_cents":"' || {_s(_pack('o_orderkey'))} || '","order":"' || {ORDER_REF} || '"}}' AS metadata,
           CAST(epoch(o_orderdate) AS BIGINT) AS created
    FROM orders WHERE o_orderkey % 3 = 2""",
    "customers_raw": f"""
    SELECT 'cus_' || {_s('c_custkey')} AS id, 'acct_main' AS _account_id,
           TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(version AS INTEGER)) AS _updated_at,
           '{{"id":"cus_' || {_s('c_custkey')} || '","object":"customer","email":'
             || CASE WHEN version = 2 THEN '"c' || {_s('c_custkey')} || '@new.example.com"'
                     WHEN c_custkey % 11 = 0 THEN 'null'
                     WHEN c_custkey % 4 = 0 THEN '"user' || {_s('c_custkey')} || '@{PH}"'
                     ELSE '"c' || {_s('c_custkey')} || '@example.com"' END
             || ',"name":"' || c_name || '","metadata":{{"app":"{TAG}","account_id":"' || {_s('c_custkey')}
             || '"}},"created":' || {_s('1690000000 + c_custkey')} || '}}' AS _raw_data
    FROM (SELECT c_custkey, c_name, unnest(CASE WHEN c_custkey % 5 = 0 THEN [1, 2] ELSE [1] END) AS version
          FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0) v""",
    "prices": f"""
    SELECT 'price_' || {_s('p_partkey')} AS id,
           CASE p_partkey % 4 WHEN 0 THEN '{TAG}_credits_10' WHEN 1 THEN '{TAG}_credits_25'
                              WHEN 2 THEN '{TAG}_credits_100' ELSE '{OLD}_credits_10' END AS lookup_key,
           (p_partkey % 3 <> 0) AND (p_partkey % 4 <> 2) AS active,
           CAST(CASE p_partkey % 4 WHEN 1 THEN 2500 WHEN 2 THEN 10000 ELSE 1000 END AS BIGINT) AS unit_amount,
           CAST(1700000000 + p_partkey * 60 AS BIGINT) AS created
    FROM part""",
    "promotion_codes": f"""
    SELECT 'promo_' || {_s('s_suppkey')} AS id,
           CASE WHEN s_suppkey % 3 = 2 THEN '{OLD.upper()}100' ELSE '{P.promotion_code}' END AS code,
           s_suppkey % 4 <> 0 AS active,
           CAST(1700000000 + s_suppkey * 60 AS BIGINT) AS created
    FROM supplier""",
    "moderation_requests": f"""
    SELECT doc_id AS request_id,
           CASE WHEN doc_id % 31 = 0 THEN NULL
                WHEN doc_id % 23 = 0 THEN 'Basic {KEY}' || lpad(CAST(doc_id // 4 AS VARCHAR), 12, '0')
                WHEN doc_id % 29 = 0 THEN 'bearer  {KEY}' || lpad(CAST(doc_id // 4 AS VARCHAR), 12, '0')
                ELSE 'Bearer {KEY}' || lpad(CAST(doc_id // 4 AS VARCHAR), 12, '0') END AS authorization,
           text,
           {AS_OF} + to_minutes(CAST(doc_id % 2880 AS INTEGER)) AS at
    FROM documents""",
    "mod_items": f"""
    SELECT request_id, CAST(unnest(range(len(items))) AS INTEGER) AS idx, unnest(items) AS item
    FROM (SELECT request_id, {items_sql('text')} AS items FROM moderation_requests) r""",
    "score_answers": f"""
    SELECT request_id,
           CASE WHEN request_id % 17 = 7 THEN '{{"results":{{"index":0}}}}'
                WHEN request_id % 17 = 1 THEN body || ' trailing' ELSE body END AS answer,
           CASE WHEN request_id % 19 = 0 THEN 500 ELSE 200 END AS upstream_status,
           CAST(CASE WHEN request_id % 37 = 0 THEN NULL ELSE 100 + 50 * n END AS INTEGER) AS prompt_tokens,
           CAST(CASE WHEN request_id % 3 = 0 THEN 10 * n END AS INTEGER) AS cached_tokens,
           CAST(CASE WHEN request_id % 37 = 0 THEN NULL ELSE 40 * n END AS INTEGER) AS completion_tokens,
           CAST(CASE WHEN request_id % 2 = 1 THEN 5 * n END AS INTEGER) AS reported_reasoning_tokens,
           CAST((request_id * 37) % 500 AS INTEGER) AS reasoning_chars
    FROM (
      SELECT request_id, n,
             '{{"results":[' || coalesce(string_agg(entry, ',' ORDER BY idx) FILTER (WHERE keep), '') || ']}}' AS body
      FROM (
        SELECT i.request_id, i.idx, c.n, {ENTRY_SQL} AS entry,
               NOT (i.request_id % 17 = 2 AND i.idx = c.n - 1) AS keep
        FROM mod_items i
        JOIN (SELECT request_id, count(*) AS n FROM mod_items GROUP BY request_id) c
          ON c.request_id = i.request_id
        LEFT JOIN labels l ON l.doc_id = i.request_id) e
      GROUP BY request_id, n) g""",
    "key_revokes": f"""
    SELECT key_id, account_id, {AS_OF} - INTERVAL 1 DAY AS at FROM api_key_creates WHERE key_id % 7 = 0
    UNION ALL SELECT key_id, account_id, {AS_OF} - INTERVAL 1 HOUR FROM api_key_creates WHERE key_id % 7 = 0
    UNION ALL SELECT key_id, account_id + 1, {AS_OF} - INTERVAL 2 DAY FROM api_key_creates WHERE key_id % 11 = 0""",
    "settings_changes": f"""
    SELECT c_custkey AS account_id, {AS_OF} - INTERVAL 3 DAY AS at, true AS enabled, 500 AS threshold_cents, 2500 AS amount_cents
    FROM customer WHERE c_custkey % 5 IN (1, 3)
    UNION ALL
    SELECT c_custkey, {AS_OF} - INTERVAL 1 HOUR, false, 1000, 10000 FROM customer WHERE c_custkey % 5 IN (2, 3)""",
    "log_lines": """
    SELECT event_id AS id, user_id AS stream,
           CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE ts END AS at,
           strftime(ts, '%H:%M:%S') AS timestamp,
           CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug'
                           WHEN 'click' THEN 'info' END AS level,
           event_type AS source,
           CASE WHEN event_type = 'error'
                THEN chr(27) || '[31m' || 'user ' || CAST(user_id AS VARCHAR) || ' event ' || CAST(event_id AS VARCHAR) || ' k=' || json_extract_string(props, '$.k') || chr(27) || '[0m'
                ELSE 'user ' || CAST(user_id AS VARCHAR) || ' event ' || CAST(event_id AS VARCHAR) || ' k=' || json_extract_string(props, '$.k') END AS message
    FROM events""",
}


def _deps(text: str) -> list[str]:
    return [n for n in FIXTURE_CTES if re.search(rf"\b{n}\b", text)]


def with_fixtures(sql: str, extra_ctes: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the fixture CTEs it reads (and their inputs), in order.

    ``extra_ctes`` are query-specific CTEs placed after the fixtures.
    """
    extra_ctes = extra_ctes or {}
    body = sql + " ".join(extra_ctes.values())
    needed: set[str] = set()
    todo = _deps(body)
    while todo:
        n = todo.pop()
        if n in needed:
            continue
        needed.add(n)
        todo.extend(d for d in _deps(FIXTURE_CTES[n]) if d != n)
    parts = [f"{n} AS ({FIXTURE_CTES[n]})" for n in FIXTURE_CTES if n in needed]
    parts += [f"{n} AS ({q})" for n, q in extra_ctes.items()]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
