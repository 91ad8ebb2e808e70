"""Moderation and admission queries: F9, F10, M1-M9, P1-P5."""

from __future__ import annotations

from meterwise.config import CATEGORIES, DEFAULT
from meterwise.operators import admission as AD
from meterwise.operators import moderation as MO
from meterwise.plans.oracle_fixtures import items_sql
from meterwise.plans.registry import register
from meterwise.plans.sql_snippets import AS_OF, BALANCE_CTES
from meterwise.sources.tables import materialized

U16 = "(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def u16(x: str) -> str:
    return U16.format(x=x)


_VAL = f"""
    SELECT request_id, CAST(len(items) AS INTEGER) AS n_items,
           CAST(coalesce(list_sum(list_transform(items, lambda x: greatest(1, ceil({u16('x')} / 2000)))), 0) AS INTEGER) AS units,
           CASE WHEN len(items) = 0 THEN 'empty_input' WHEN len(items) > 20 THEN 'too_many_items'
                WHEN coalesce(list_position(list_transform(items, lambda x: {u16('x')} > 8000), true), 0) > 0 THEN 'item_too_long'
                ELSE 'ok' END AS validation,
           CASE WHEN len(items) > 0 AND len(items) <= 20
                THEN CAST(list_position(list_transform(items, lambda x: {u16('x')} > 8000), true) - 1 AS INTEGER) END AS bad_index
    FROM (SELECT request_id, {items_sql('text')} AS items FROM moderation_requests) r"""

_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
_IDX_BAD = (f"NOT (coalesce(json_type(e, '$.index') IN {_NUM}, false) AND CAST(json_extract(e, '$.index') AS DOUBLE) = "
            "floor(CAST(json_extract(e, '$.index') AS DOUBLE)) AND CAST(json_extract(e, '$.index') AS DOUBLE) >= 0 "
            "AND CAST(json_extract(e, '$.index') AS DOUBLE) < n)")
_SC_BAD = ("NOT (coalesce(json_type(e, '$.scores') = 'OBJECT', false) AND "
           + " AND ".join(f"coalesce(json_type(e, '$.scores.{c}') IN {_NUM}, false) AND CAST(json_extract(e, '$.scores.{c}') AS DOUBLE) "
                          f"BETWEEN 0 AND 1" for c in CATEGORIES) + ")")
_CHECK = f"""
    SELECT request_id, n, es,
           CASE WHEN NOT doc_ok THEN 'invalid_json'
                WHEN rtype IS DISTINCT FROM 'ARRAY' OR len(list_filter(es, lambda e: json_type(e) <> 'OBJECT')) > 0 THEN 'bad_results'
                WHEN len(list_filter(es, lambda e: {_IDX_BAD})) > 0 THEN 'bad_index'
                WHEN len(list_filter(es, lambda e: {_SC_BAD})) > 0 THEN 'bad_score'
                WHEN len(list_distinct(list_transform(es, lambda e: CAST(json_extract(e, '$.index') AS DOUBLE)))) < len(es) THEN 'duplicate_index'
                WHEN len(es) < n THEN 'missing_results'
                ELSE 'ok' END AS outcome_check
    FROM (SELECT request_id, n, doc_ok, rtype,
                 CASE WHEN rtype = 'ARRAY' THEN CAST(json_extract(answer, '$.results') AS JSON[]) END AS es
          FROM (SELECT a.request_id, v.n_items AS n, a.answer,
                       coalesce(json_valid(a.answer), false)
                         AND NOT regexp_matches(a.answer, '[:\\[,]\\s*-?(NaN|Infinity)\\s*[,\\]}}]') AS doc_ok,
                       CASE WHEN coalesce(json_valid(a.answer), false) THEN json_type(a.answer, '$.results') END AS rtype
                FROM score_answers a JOIN val v ON v.request_id = a.request_id
                WHERE a.upstream_status = 200) x) y"""
_RESULTS = ("SELECT request_id, CAST(CAST(json_extract(e, '$.index') AS DOUBLE) AS INTEGER) AS idx, "
            + ", ".join(f"CAST(json_extract(e, '$.scores.{c}') AS DOUBLE) AS {c}" for c in CATEGORIES)
            + ", CASE WHEN coalesce(json_type(e, '$.reason') = 'VARCHAR', false) THEN json_extract_string(e, '$.reason') ELSE '' END AS reason"
            " FROM (SELECT request_id, unnest(es) AS e FROM checked WHERE outcome_check = 'ok') z")
_R3 = {c: f"floor({c} * 1000.0 + 0.5) / 1000.0" for c in CATEGORIES}
_TOP = "greatest(" + ", ".join(CATEGORIES) + ")"
_VERDICTS = ("SELECT request_id, idx, " + ", ".join(CATEGORIES) + f", {_TOP} AS top_score, "
             f"CASE WHEN {_TOP} >= 0.8 THEN 'block' WHEN {_TOP} >= 0.4 THEN 'review' ELSE 'allow' END AS verdict, "
             "list_filter([" + ", ".join(f"CASE WHEN {c} >= 0.4 THEN '{c}' END" for c in CATEGORIES) + "], lambda x: x IS NOT NULL) AS flagged, "
             f"CASE WHEN {u16('substring(reason, 1, 300)')} <= 300 THEN substring(reason, 1, 300) ELSE "
             "array_to_string(list_filter(string_split(substring(reason, 1, 300), ''), "
             f"lambda c, i: {u16('substring(reason, 1, i)')} <= 300), '') END AS reason FROM (SELECT request_id, idx, "
             + ", ".join(f"{e} AS {c}" for c, e in _R3.items()) + ", reason FROM results) r")
_TOPCAT = "CASE " + " ".join(f"WHEN {c} = {_TOP} THEN '{c}'" for c in CATEGORIES) + " END"

MOD_CTES = {"val": _VAL, "checked": _CHECK, "results": _RESULTS, "verdicts": _VERDICTS}


def _fixed2(x: str) -> str:
    """Two decimals of the exact double, ties upwards; only odd eighths are ties."""
    tie = f"{x} * 8 = floor({x} * 8) AND {x} * 4 <> floor({x} * 4)"
    return f"format('{{:.2f}}', CASE WHEN {tie} THEN {x} + CAST(0.001 AS DOUBLE) ELSE {x} END)"


def _score_of(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{x}' THEN {x}" for x in CATEGORIES) + " END"


def _label(c: str) -> str:
    return f"regexp_replace({c}, '^([^_]*)_', '\\1 ')"


_HEAD = (f"CASE WHEN len(flagged) > 0 THEN array_to_string(list_transform(flagged, lambda c: {_label('c')} || ' ' || "
         f"{_fixed2(_score_of('c'))}), ' · ') ELSE 'highest: ' || {_label('top_category')} || ' ' || "
         f"{_fixed2(_score_of('top_category'))} END")


def _val(fx):
    return MO.request_validation(fx.moderation_requests)


def _ingest(fx):
    return MO.ingest_scores(fx.score_answers, _val(fx))


@register("request_items", "F9",
          f"SELECT request_id, CAST(unnest(range(len(items))) AS INTEGER) AS idx, unnest(items) AS item "
          f"FROM (SELECT request_id, {items_sql('text')} AS items FROM moderation_requests) r")
def q_request_items(fx):
    return MO.request_items(fx.moderation_requests)


@register("request_validation", "F10", "SELECT * FROM val", {"val": _VAL})
def q_request_validation(fx):
    return _val(fx)


@register("item_units", "M1",
          f"SELECT request_id, idx, CAST({u16('item')} AS INTEGER) AS length, CAST(greatest(1, ceil({u16('item')} / 2000)) AS INTEGER) AS units "
          "FROM mod_items")
def q_item_units(fx):
    return MO.item_units_df(MO.request_items(fx.moderation_requests))


@register("request_batches", "M2",
          f"""SELECT request_id, CAST(idx // 20 AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n_items,
                     CAST(sum(greatest(1, ceil({u16('item')} / 2000))) AS INTEGER) AS units,
                     CAST(1024 + 192 * count(*) AS INTEGER) AS max_tokens, list(item ORDER BY idx) AS items
              FROM mod_items GROUP BY request_id, idx // 20""")
def q_request_batches(fx):
    return MO.request_batches(MO.request_items(fx.moderation_requests))


def _hits(word: str) -> str:
    return f"((length(lower(item)) - length(replace(lower(item), '{word}', ''))) // {len(word)})"


_LEXICON_SCORES = ("SELECT request_id, idx, " + ", ".join(
    f"least(({' + '.join(_hits(w) for w in MO.LEXICON[c])}) * CAST(0.3 AS DOUBLE), 1) AS {c}" for c in CATEGORIES) + " FROM mod_items")


@register("score_items", "M3", _LEXICON_SCORES)
def q_score_items(fx):
    return MO.score_items(MO.request_items(fx.moderation_requests))


@register("text_verdicts", "M3-M5", "SELECT * FROM verdicts",
          {"val": _VAL, "results": f"SELECT *, '' AS reason FROM ({_LEXICON_SCORES}) s WHERE request_id IN (SELECT request_id FROM val WHERE validation = 'ok')",
           "verdicts": _VERDICTS})
def q_text_verdicts(fx):
    return MO.text_verdicts(fx.moderation_requests)


# API bodies of the documents: the whole text as one string, or its lines as an array (a blank
# line there is an empty string, which the API refuses).
_BODY = """SELECT request_id, json_object('input', CASE WHEN request_id % 2 = 0 THEN to_json("text") ELSE to_json(string_split("text", chr(10))) END) AS body
           FROM moderation_requests"""
_BODY_VAL = f"""
    SELECT request_id, items, n_items,
           CAST(coalesce(list_sum(list_transform(items, lambda x: greatest(1, ceil({u16('x')} / 2000)))), 0) AS INTEGER) AS units,
           CASE WHEN items IS NULL THEN 'invalid_input' WHEN n_items > 20 THEN 'too_many_items' WHEN long_at > 0 THEN 'item_too_long' ELSE 'ok' END AS validation,
           CASE WHEN n_items BETWEEN 1 AND 20 AND long_at > 0 THEN CAST(long_at - 1 AS INTEGER) END AS bad_index
    FROM (SELECT request_id, items, CAST(coalesce(len(items), 0) AS INTEGER) AS n_items,
                 coalesce(list_position(list_transform(items, lambda x: {u16('x')} > 8000), true), 0) AS long_at
          FROM (SELECT request_id, CASE WHEN len(parts) > 0 AND NOT list_contains(parts, '') THEN parts END AS items
                FROM (SELECT request_id, CASE json_type(body, '$.input') WHEN 'VARCHAR' THEN [json_extract_string(body, '$.input')]
                                              WHEN 'ARRAY' THEN from_json(json_extract(body, '$.input'), '["VARCHAR"]') END AS parts
                      FROM bodies) p) i) v"""


@register("body_validation", "F9-F10", _BODY_VAL, {"bodies": _BODY})
def q_body_validation(fx):
    from pyspark.sql import functions as F

    whole = F.to_json(F.struct(F.col("text").alias("input")))
    lines = F.to_json(F.struct(F.split("text", "\n").alias("input")))
    return MO.body_validation(fx.moderation_requests.select("request_id", F.when(F.col("request_id") % 2 == 0, whole).otherwise(lines).alias("body")))


@register("ingest_scores", "M4", "SELECT * FROM results", MOD_CTES)
def q_ingest_scores(fx):
    return _ingest(fx)[0]


@register("ingest_rejects", "M4", "SELECT request_id, outcome_check AS reason FROM checked WHERE outcome_check <> 'ok'", MOD_CTES)
def q_ingest_rejects(fx):
    return _ingest(fx)[1]


@register("verdicts", "M5", "SELECT * FROM verdicts", MOD_CTES)
def q_verdicts(fx):
    return MO.verdicts(_ingest(fx)[0])


@register("top_category", "M6",
          f"SELECT request_id, idx, {_TOPCAT} AS top_category, {_TOP} AS top_category_score FROM verdicts", MOD_CTES)
def q_top_category(fx):
    return MO.top_category(MO.verdicts(_ingest(fx)[0]))


@register("verdict_detail", "M7",
          f"""SELECT request_id, idx, verdict,
                     CASE WHEN reason <> '' THEN head || ' · ' || reason ELSE head END AS detail
              FROM (SELECT *, {_HEAD} AS head FROM (SELECT *, {_TOPCAT} AS top_category FROM verdicts) t) h""",
          MOD_CTES)
def q_verdict_detail(fx):
    return MO.verdict_detail(MO.verdicts(_ingest(fx)[0]))


_M8 = f"""SELECT request_id, CAST(coalesce(CAST(reported_reasoning_tokens AS BIGINT),
                 CASE WHEN a + r > 0 THEN floor(CAST(comp * r AS DOUBLE) / (a + r) + 0.5) ELSE 0 END) AS BIGINT) AS reasoning_tokens
          FROM (SELECT request_id, reported_reasoning_tokens, CAST(coalesce({u16('answer')}, 0) AS BIGINT) AS a,
                       CAST(coalesce(reasoning_chars, 0) AS BIGINT) AS r, CAST(coalesce(completion_tokens, 0) AS BIGINT) AS comp
                FROM score_answers) s"""


@register("reasoning_estimate", "M8", _M8)
def q_reasoning_estimate(fx):
    return MO.reasoning_estimate(fx.score_answers)


# ------------------------------------------------------------------ admission
_AUTH = """SELECT r.request_id, k.key_id, k.account_id
           FROM (SELECT request_id, CASE WHEN regexp_extract("authorization", '(?i)^Bearer\\s+(\\S+)$', 1) <> ''
                                         THEN sha256(regexp_extract("authorization", '(?i)^Bearer\\s+(\\S+)$', 1)) END AS key_hash
                 FROM moderation_requests) r
           LEFT JOIN (SELECT key_hash, key_id, account_id FROM api_keys WHERE revoked_at IS NULL) k ON k.key_hash = r.key_hash"""
_USED = f"SELECT account_id, count(*) AS used, min(created_at) AS oldest_at FROM usage_events WHERE created_at > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1"
_PRICE = f"SELECT unit_price_micros FROM service_prices WHERE service = '{DEFAULT.service}' AND active"
AS_OF_MS = AD._epoch_ms(DEFAULT.as_of)
_STATUS = """CASE WHEN v.validation <> 'ok' THEN 400 WHEN a.key_id IS NULL THEN 401 WHEN p.unit_price_micros IS NULL THEN 503
                  WHEN coalesce(u.used, 0) >= 2 THEN 429 WHEN coalesce(b.balance_micros, 0) < CAST(v.units AS BIGINT) * p.unit_price_micros THEN 402
                  ELSE 200 END"""
_ADMISSION = f"""
    SELECT r.request_id, a.account_id, a.key_id, {_STATUS} AS status_code, v.units,
           CAST(v.units AS BIGINT) * p.unit_price_micros AS quote_micros,
           CASE WHEN {_STATUS} = 429 THEN CAST(coalesce(greatest(1, ceil((floor(epoch_us(u.oldest_at + INTERVAL 24 HOUR) / 1000) - {AS_OF_MS}) / 1000)), 3600) AS BIGINT) END AS retry_after_s
    FROM moderation_requests r JOIN val v ON v.request_id = r.request_id
    LEFT JOIN auth a ON a.request_id = r.request_id
    LEFT JOIN used u ON u.account_id = a.account_id
    LEFT JOIN balances b ON b.account_id = a.account_id
    LEFT JOIN price p ON true"""
ADM_CTES = {**BALANCE_CTES, "val": _VAL, "auth": _AUTH, "used": _USED, "price": _PRICE, "admitted": _ADMISSION}


def _auth(fx):
    return AD.key_auth(fx.moderation_requests, fx.api_keys)


def _admission(fx, balances=None):
    b = fx.balances if balances is None else balances
    return AD.admission(fx.moderation_requests, _val(fx), _auth(fx), fx.usage_events, b, fx.service_prices,
                        fx.p.service, fx.p.as_of)


def replay_parts(fx):
    """(P2's answers, outcomes, requests, wallet) for the replay. The texts are read and checked
    once: what remains of a request is a row of its header, time, item count, units and verdict."""
    facts = materialized(MO.request_validation(fx.moderation_requests, keep=("authorization", "at")), "request-facts")
    outcomes = AD.answer_outcomes_of(MO.check_answers(fx.answers_to(facts), facts))
    snap = fx.wallet_snapshot  # read by the snapshot check and by the fold
    admitted = AD.admission(facts, facts, AD.key_auth(facts, fx.api_keys), fx.usage_events, snap, fx.service_prices, fx.p.service, fx.p.as_of)
    return materialized(admitted, "admitted"), outcomes, facts, snap


@register("key_auth", "P1", "SELECT * FROM auth", {"auth": _AUTH})
def q_key_auth(fx):
    return _auth(fx)


@register("admission", "P2", "SELECT * FROM admitted", ADM_CTES)
def q_admission(fx):
    return _admission(fx)


@register("retry_after", "P3",
          "SELECT request_id, account_id, retry_after_s, CAST(ceil(retry_after_s / 3600) AS BIGINT) AS retry_after_h "
          "FROM admitted WHERE status_code = 429", ADM_CTES)
def q_retry_after(fx):
    from pyspark.sql import functions as F

    a = _admission(fx).filter(F.col("status_code") == 429)
    return a.select("request_id", "account_id", "retry_after_s", F.ceil(F.col("retry_after_s") / 3600).cast("long").alias("retry_after_h"))


@register("quote", "P5",
          f"""SELECT v.request_id, a.account_id, v.units, CAST(v.units AS BIGINT) * p.unit_price_micros AS quote_micros,
                     coalesce(b.balance_micros, 0) >= CAST(v.units AS BIGINT) * p.unit_price_micros AS affordable,
                     CAST(coalesce(b.balance_micros, 0) - CAST(v.units AS BIGINT) * p.unit_price_micros AS BIGINT) AS balance_after_micros,
                     CAST(floor(10000000 / p.unit_price_micros) AS BIGINT) AS items_per_pack_1000,
                     CAST(floor(25000000 / p.unit_price_micros) AS BIGINT) AS items_per_pack_2500,
                     CAST(floor(100000000 / p.unit_price_micros) AS BIGINT) AS items_per_pack_10000
              FROM val v JOIN auth a ON a.request_id = v.request_id AND a.account_id IS NOT NULL
              LEFT JOIN balances b ON b.account_id = a.account_id
              JOIN price p ON true
              WHERE v.validation = 'ok'""",
          ADM_CTES)
def q_quote(fx):
    return AD.quote(fx.moderation_requests, _val(fx), _auth(fx), fx.balances, fx.service_prices, fx.p.service)


# The replay as a recursion: step k judges every account's k-th attempt with what the first
# k - 1 left of its balance and added to its calls.
_ATTEMPTS = """
    SELECT ad.request_id, ad.account_id, r."at" AS tried_at, ad.quote_micros,
           CASE WHEN coalesce(s.upstream_status, 0) <> 200 THEN 'upstream' WHEN c.outcome_check <> 'ok' THEN 'invalid' ELSE 'ok' END AS outcome,
           row_number() OVER (PARTITION BY ad.account_id ORDER BY r."at", ad.request_id) AS k
    FROM admitted ad JOIN moderation_requests r USING (request_id)
    LEFT JOIN score_answers s USING (request_id) LEFT JOIN checked c USING (request_id)
    WHERE ad.status_code NOT IN (400, 401, 503)"""
_REPLAY = f"""
    WITH RECURSIVE fold AS (
      SELECT a.account_id, CAST(0 AS BIGINT) AS k, CAST(coalesce(b.balance_micros, 0) AS BIGINT) AS left_micros,
             coalesce(p.calls, CAST([] AS TIMESTAMP[])) AS calls, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS TIMESTAMP) AS tried_at,
             0 AS status_code, CAST(0 AS BIGINT) AS charged_micros, false AS counted
      FROM (SELECT DISTINCT account_id FROM attempts) a LEFT JOIN balances b USING (account_id)
      LEFT JOIN (SELECT account_id, list(created_at) AS calls FROM usage_events
                 WHERE created_at > {AS_OF} - INTERVAL 24 HOUR AND created_at <= {AS_OF} GROUP BY account_id) p USING (account_id)
      UNION ALL
      SELECT account_id, k, left_micros - CASE WHEN st = 200 THEN quote_micros ELSE 0 END,
             CASE WHEN st = 200 OR (st = 502 AND outcome = 'invalid') THEN list_append(calls, tried_at) ELSE calls END,
             request_id, tried_at, st, CASE WHEN st = 200 THEN quote_micros ELSE 0 END, st = 200 OR (st = 502 AND outcome = 'invalid')
      FROM (SELECT f.left_micros, f.calls, t.*,
                   CASE WHEN len(list_filter(f.calls, lambda c: c > t.tried_at - INTERVAL 24 HOUR)) >= 2 THEN 429
                        WHEN f.left_micros < t.quote_micros THEN 402 WHEN t.outcome = 'ok' THEN 200 ELSE 502 END AS st
            FROM fold f JOIN attempts t ON t.account_id = f.account_id AND t.k = f.k + 1) step)
    SELECT request_id, account_id, tried_at AS "at", status_code, charged_micros, counted, left_micros AS balance_after_micros
    FROM fold WHERE k > 0"""
FOLD_SQL = "SELECT * FROM replayed"
FOLD_CTES = {**ADM_CTES, **MOD_CTES, "attempts": _ATTEMPTS, "replayed": _REPLAY}
_REFUSED = """SELECT request_id, account_id, r."at", status_code, CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT)
              FROM admitted JOIN moderation_requests r USING (request_id) WHERE status_code IN (400, 401, 503)"""


@register("admission_replay", "P4", f"{FOLD_SQL} UNION ALL {_REFUSED}", FOLD_CTES)
def q_admission_replay(fx):
    admitted, outcomes, requests, snap = replay_parts(fx)
    return AD.admission_replay(admitted, outcomes, requests, fx.usage_events, snap, fx.p.as_of)


_M9 = f"""
    SELECT ad.request_id AS id, ad.account_id, ad.key_id AS api_key_id, 'moderate' AS service,
           CAST(CASE WHEN c.outcome_check <> 'ok' THEN 0 ELSE ad.units END AS INTEGER) AS units, 'gpt-oss-20b' AS model,
           CAST(coalesce(s.prompt_tokens, 0) AS INTEGER) AS input_tokens, CAST(coalesce(s.cached_tokens, 0) AS INTEGER) AS cached_input_tokens,
           CAST(coalesce(s.completion_tokens, 0) AS INTEGER) AS output_tokens, CAST(coalesce(m8.reasoning_tokens, 0) AS INTEGER) AS reasoning_tokens,
           CAST(coalesce(greatest(CAST(CASE WHEN c.outcome_check <> 'ok' THEN 0 ELSE ad.units END AS BIGINT), 0) * sp.unit_price_micros, 0) AS BIGINT) AS price_micros,
           CAST(coalesce(round(greatest(CAST(coalesce(s.prompt_tokens, 0) AS DECIMAL(20,0)) - CAST(coalesce(s.cached_tokens, 0) AS DECIMAL(20,0)), 0) * mc.input_usd_per_mtok
                + CAST(coalesce(s.cached_tokens, 0) AS DECIMAL(20,0)) * mc.cached_input_usd_per_mtok
                + CAST(coalesce(s.completion_tokens, 0) AS DECIMAL(20,0)) * mc.output_usd_per_mtok), 0) AS BIGINT) AS cost_micros,
           CAST(CASE WHEN c.outcome_check <> 'ok' THEN 502 ELSE 200 END AS SMALLINT) AS status,
           CAST(NULL AS INTEGER) AS latency_ms, r.at AS created_at
    FROM admitted ad
    JOIN score_answers s ON s.request_id = ad.request_id AND s.upstream_status = 200
    JOIN checked c ON c.request_id = ad.request_id
    JOIN moderation_requests r ON r.request_id = ad.request_id
    LEFT JOIN m8 ON m8.request_id = ad.request_id
    LEFT JOIN service_prices sp ON sp.service = 'moderate'
    LEFT JOIN model_costs mc ON mc.model = 'gpt-oss-20b'
    WHERE ad.status_code = 200"""


@register("metering", "M9", _M9, {**ADM_CTES, **MOD_CTES, "m8": _M8})
def q_metering(fx):
    rejects = _ingest(fx)[1]
    return AD.metering(_admission(fx), fx.score_answers, rejects, MO.reasoning_estimate(fx.score_answers), fx.moderation_requests,
                       fx.service_prices, fx.model_costs, fx.p.service, fx.p.model)


# The path from text to ledger: the lexicon's scores never fail the strict check, so every admitted
# request is charged, unless the ledger has its id.
_TOKENS = "SELECT request_id, sum(length(item)) // 4 AS input, 24 * count(*) AS output FROM mod_items GROUP BY request_id"
_PATH_LEDGER = f"""
    SELECT ad.request_id AS id, ad.account_id, ad.key_id AS api_key_id, 'moderate' AS service, ad.units, 'gpt-oss-20b' AS model,
           CAST(t.input AS INTEGER) AS input_tokens, 0 AS cached_input_tokens, CAST(t.output AS INTEGER) AS output_tokens, 0 AS reasoning_tokens,
           CAST(ad.quote_micros AS BIGINT) AS price_micros,
           CAST(round(CAST(t.input AS DECIMAL(20,0)) * mc.input_usd_per_mtok + CAST(t.output AS DECIMAL(20,0)) * mc.output_usd_per_mtok) AS BIGINT) AS cost_micros,
           CAST(200 AS SMALLINT) AS status, CAST(NULL AS INTEGER) AS latency_ms, r."at" AS created_at
    FROM admitted ad JOIN tokens t USING (request_id) JOIN moderation_requests r USING (request_id) JOIN model_costs mc ON mc.model = 'gpt-oss-20b'
    WHERE ad.status_code = 200 AND ad.request_id NOT IN (SELECT id FROM usage_events)"""
_PATH_VERDICTS = {"results": f"SELECT *, '' AS reason FROM ({_LEXICON_SCORES}) s WHERE request_id IN (SELECT request_id FROM admitted WHERE status_code = 200)",
                  "verdicts": _VERDICTS}


def _path(fx):
    facts = materialized(MO.request_validation(fx.moderation_requests, keep=("authorization", "at", "text")), "requests")
    return AD.text_to_ledger(facts, facts, fx.api_keys, fx.usage_events, fx.balances, fx.service_prices, fx.model_costs, fx.p.service, fx.p.model, fx.p.as_of)


@register("path_verdicts", "P1-M5", "SELECT * FROM verdicts", {**ADM_CTES, **_PATH_VERDICTS})
def q_path_verdicts(fx):
    return _path(fx)[0]


@register("path_ledger", "P1-S4", _PATH_LEDGER, {**ADM_CTES, "tokens": _TOKENS})
def q_path_ledger(fx):
    return _path(fx)[1]
