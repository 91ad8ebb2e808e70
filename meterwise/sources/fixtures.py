"""Domain tables derived from the driver's Parquet tables by fixed expressions.

The reference ships no data, so its tables (accounts, the usage ledger, the
synced payment tables, ...) are derived row by row from the TPC-H-ish inputs
(see FIXTURES.md). The same expressions exist as DuckDB CTEs in
``meterwise.plans.oracle_fixtures``; both sides must agree column for column.

Every table here is a lazy DataFrame over the inputs, so its size grows with
them; only the three price/rate configuration tables are literal rows.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.config import CATEGORIES as CATEGORIES_FX
from meterwise.config import DEFAULT, Params
from meterwise.schemas import SYNCED
from meterwise.sources.tables import read_table

# Fixed fixture values (FIXTURES.md).
FIXTURE_PRICE_MICROS = 300_000
PRICE_HISTORY = (  # service, micros per unit, valid from
    ("moderate", 250_000, datetime(2023, 1, 1)),
    ("moderate", 300_000, datetime(2024, 1, 10)),
    ("moderate", 400_000, datetime(2024, 1, 25)),
)
SERVICE_PRICES = (  # service, micros per unit, active
    ("moderate", 300_000, True),
    ("chat", 500, False),
)
MODEL_COSTS = (("gpt-oss-20b", "0.07", "0.07", "0.30"),)
MODEL_RATES = (("gpt-oss-20b", "0.21", "0.21", "0.90", "0.15"),)
CATALOG_EPOCH = 1_700_000_000  # created (unix s) of the first catalog object
CUSTOMER_EPOCH = 1_690_000_000


def pack(k: Column) -> Column:
    """Credit pack in cents picked by a key: 1000 / 2500 / 10000."""
    r = F.pmod(F.floor(k / 3), F.lit(3))
    return F.when(r == 0, 1000).when(r == 1, 2500).otherwise(10000)


# What the objects of one order have in common: every fifth order has a charge, a session and an
# invoice of its own (if their keys exist), which the audit has to find.
ORDER_REF_SQL = "CASE WHEN pmod(floor(o_orderkey / 3), 5) = 0 THEN concat('o', CAST(floor(o_orderkey / 3) AS STRING)) ELSE concat('k', CAST(o_orderkey AS STRING)) END"


def epoch_s(ts: Column) -> Column:
    return F.unix_seconds(ts)


def ts_lit(dt: datetime) -> Column:
    return F.lit(dt).cast("timestamp")


# The row expressions below are SQL text (``selectExpr``): one projection is one call to
# the JVM, where the same expression assembled from Column objects costs one per node.
def sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_ts(dt: datetime) -> str:
    """A Spark SQL timestamp literal (read in the session time zone, UTC)."""
    return f"TIMESTAMP '{dt.strftime('%Y-%m-%d %H:%M:%S.%f')}'"


def pack_sql(k: str) -> str:
    """``pack`` as SQL text."""
    return f"CASE pmod(floor({k} / 3), 3) WHEN 0 THEN 1000 WHEN 1 THEN 2500 ELSE 10000 END"


def ledger_sql(k: str, units: str, status: str, price: str) -> list[str]:
    """Ledger columns from service to latency: tokens from ``k``, cost at the fixture's model
    cost (0.07 in, 0.07 cached, 0.30 out per Mtok) rounded half up."""
    input_t = f"CAST(100 + 10 * {k} AS INT)"
    output_t = f"CAST(50 + 3 * {k} AS INT)"
    cost = f"CAST(floor((7 * CAST({input_t} AS BIGINT) + 30 * CAST({output_t} AS BIGINT) + 50) / 100) AS BIGINT)"
    return [
        "'moderate' AS service", f"CAST({units} AS INT) AS units", "'gpt-oss-20b' AS model",
        f"{input_t} AS input_tokens", f"CAST({k} AS INT) AS cached_input_tokens", f"{output_t} AS output_tokens",
        f"CAST({k} AS INT) AS reasoning_tokens", f"CAST({price} AS BIGINT) AS price_micros", f"{cost} AS cost_micros",
        f"CAST({status} AS SMALLINT) AS status",
        f"CASE WHEN pmod({k}, 10) = 0 THEN CAST(NULL AS INT) ELSE CAST(200 + {k} AS INT) END AS latency_ms",
    ]


class Fixtures:
    """Lazy domain tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT):
        self.spark = spark
        self.sf_dir = sf_dir
        self.p = params

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def orders_dim(self) -> DataFrame:
        """Orders as the dimension the ledger is joined to (always a table, never a stream)."""
        return read_table(self.spark, self.sf_dir, "orders")

    @property
    def as_of(self) -> Column:
        return ts_lit(self.p.as_of)

    # ------------------------------------------------------------------ app.*
    @cached_property
    def accounts(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS account_id",
            "CASE WHEN pmod(c_custkey, 43) = 0 THEN CAST(NULL AS BIGINT) ELSE c_custkey + 1000000 END AS user_id",
            "c_name AS label",
            "CASE WHEN pmod(c_custkey, 17) = 0 THEN CAST(NULL AS STRING) ELSE concat('cus_', CAST(c_custkey AS STRING)) END AS stripe_customer_id",
            "c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS auto_topup_enabled",
            "CAST(CASE pmod(c_custkey, 3) WHEN 0 THEN 2000000 WHEN 1 THEN 5000000 ELSE 10000000 END AS BIGINT) AS auto_topup_threshold_micros",
            "CAST(CASE pmod(c_custkey, 3) WHEN 0 THEN 1000 WHEN 1 THEN 2500 ELSE 10000 END AS INT) AS auto_topup_amount_cents",
            "CAST(NULL AS STRING) AS auto_topup_error",
            f"{sql_ts(datetime(2023, 1, 1))} + make_dt_interval(CAST(pmod(c_custkey, 365) AS INT)) AS created_at",
        )

    @cached_property
    def users(self) -> DataFrame:
        """Signed-in users (auth side): one per customer; some use a placeholder email."""
        old_domain = sql_str(f"@users.{self.p.old_tag}.invalid")
        placeholder = sql_str("@" + self.p.placeholder_domain)
        return self.raw("customer").selectExpr(
            "c_custkey + 1000000 AS user_id",
            f"CASE WHEN pmod(c_custkey, 8) = 0 THEN concat('user', CAST(c_custkey AS STRING), {old_domain}) "
            f"WHEN pmod(c_custkey, 4) = 0 THEN concat('user', CAST(c_custkey AS STRING), {placeholder}) "
            "ELSE concat('c', CAST(c_custkey AS STRING), '@example.com') END AS email",
            "c_name AS name",
        )

    @cached_property
    def api_key_creates(self) -> DataFrame:
        """Key creation events: the key text exists only here (never stored)."""
        return self.raw("customer").filter("pmod(c_custkey, 3) <> 1").selectExpr(
            "c_custkey AS key_id",
            "c_custkey AS account_id",
            "'default' AS name",
            f"concat({sql_str(self.p.key_prefix)}, lpad(CAST(c_custkey AS STRING), 12, '0')) AS key_text",
            f"{sql_ts(datetime(2023, 1, 1))} + make_dt_interval(CAST(pmod(c_custkey, 365) AS INT)) AS created_at",
        )

    @cached_property
    def api_keys(self) -> DataFrame:
        return self.api_key_creates.selectExpr(
            "key_id", "account_id", "name",
            "substring(key_text, 1, 12) AS prefix",
            "sha2(key_text, 256) AS key_hash",
            "created_at",
            "CAST(NULL AS TIMESTAMP) AS last_used_at",
            f"CASE WHEN pmod(key_id, 7) = 0 THEN {sql_ts(self.p.as_of)} - INTERVAL 1 DAY ELSE CAST(NULL AS TIMESTAMP) END AS revoked_at",
        )

    @cached_property
    def service_prices(self) -> DataFrame:
        schema = "service string, unit_price_micros long, active boolean, updated_at timestamp"
        rows = [(s, p, a, datetime(2024, 1, 1)) for s, p, a in SERVICE_PRICES]
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def price_history(self) -> DataFrame:
        return self.spark.createDataFrame(list(PRICE_HISTORY), "service string, unit_price_micros long, valid_from timestamp")

    @cached_property
    def model_costs(self) -> DataFrame:
        rows = [(m, *[float(x) for x in r]) for m, *r in MODEL_COSTS]
        df = self.spark.createDataFrame(rows, "model string, input_usd_per_mtok double, cached_input_usd_per_mtok double, output_usd_per_mtok double")
        return df.select("model", *[F.col(c).cast("decimal(12,4)").alias(c) for c in df.columns[1:]])

    @cached_property
    def service_catalog(self) -> DataFrame:
        """A price list as long as ``part``, as files of the service_prices table hold it."""
        return self.raw("part").selectExpr(
            "concat('service_', CAST(p_partkey AS STRING)) AS service",
            "CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_micros",
            "pmod(p_partkey, 3) <> 0 AS active",
            f"{sql_ts(self.p.as_of)} - make_dt_interval(CAST(pmod(p_partkey, 365) AS INT)) AS updated_at",
        )

    @cached_property
    def model_catalog(self) -> DataFrame:
        """Model costs, one per supplier, in dollars per million tokens."""
        rate = lambda k: f"CAST(pmod(s_suppkey * {k}, 9973) AS DECIMAL(12,4)) / 100"
        return self.raw("supplier").selectExpr(
            "concat('model_', CAST(s_suppkey AS STRING)) AS model", f"CAST({rate(7)} AS DECIMAL(12,4)) AS input_usd_per_mtok",
            f"CAST({rate(3)} AS DECIMAL(12,4)) AS cached_input_usd_per_mtok", f"CAST({rate(31)} AS DECIMAL(12,4)) AS output_usd_per_mtok")

    @cached_property
    def model_rates(self) -> DataFrame:
        rows = [(m, *[float(x) for x in r]) for m, *r in MODEL_RATES]
        df = self.spark.createDataFrame(
            rows, "model string, input_usd_per_mtok double, cached_input_usd_per_mtok double, output_usd_per_mtok double, reasoning_usd_per_mtok double"
        )
        return df.select("model", *[F.col(c).cast("decimal(12,4)").alias(c) for c in df.columns[1:]])

    @cached_property
    def usage_events(self) -> DataFrame:
        """The usage ledger: old calls from lineitem (1992-1998) and recent calls from events.

        Ids from lineitem are ``orderkey*8 + linenumber`` and repeat where the input repeats
        (retried writes, caught by the audits); ids from events are ``event_id*8``.
        """
        li = self.raw("lineitem")
        o = self.orders_dim().select("o_orderkey", "o_custkey")
        return self.line_calls(li.join(o, li.l_orderkey == o.o_orderkey, "inner")).unionByName(self.event_calls)

    @staticmethod
    def line_calls(lines: DataFrame) -> DataFrame:
        """Ledger rows of line items that know their order's customer (``o_custkey``)."""
        units_old = "CAST(l_quantity AS INT)"
        return lines.selectExpr(
            "l_orderkey * 8 + l_linenumber AS id",
            "o_custkey AS account_id",
            "CASE WHEN pmod(o_custkey, 3) <> 1 THEN o_custkey END AS api_key_id",
            *ledger_sql("pmod(l_partkey, 100)", units_old, "200", f"CAST({units_old} AS BIGINT) * {FIXTURE_PRICE_MICROS}"),
            "l_shipdate AS created_at",
        )

    @cached_property
    def event_calls(self) -> DataFrame:
        """Ledger rows of events (all but sign-ups)."""
        units_new = "CASE WHEN event_type = 'error' THEN 0 ELSE 1 + pmod(_k, 20) END"
        price_now = (f"CASE WHEN ts >= {sql_ts(datetime(2024, 1, 25))} THEN 400000 "
                     f"WHEN ts >= {sql_ts(datetime(2024, 1, 10))} THEN 300000 ELSE 250000 END")
        return (self.raw("events").filter("event_type <> 'signup'")
                .selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS _k")
                .selectExpr(
                    "event_id * 8 AS id",
                    "user_id AS account_id",
                    "CASE WHEN pmod(user_id, 3) <> 1 THEN user_id END AS api_key_id",
                    *ledger_sql("_k", units_new, "CASE WHEN event_type = 'error' THEN 502 ELSE 200 END",
                                f"CAST({units_new} AS BIGINT) * {price_now}"),
                    "ts AS created_at",
                ))

    @cached_property
    def simulated_spend(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'signup'").selectExpr(
            "event_id AS id",
            "user_id AS account_id",
            "(1 + CAST(get_json_object(props, '$.k') AS BIGINT)) * 10000 AS amount_micros",
            "ts AS created_at",
        )

    @cached_property
    def topups(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS account_id",
            "CASE WHEN pmod(o_orderkey, 3) = 2 THEN concat('in_', CAST(o_orderkey AS STRING)) END AS invoice_id",
            f"CAST({pack_sql('o_orderkey')} AS INT) AS amount_cents",
            "CASE WHEN pmod(o_orderkey, 3) <> 2 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'open' ELSE 'paid' END AS status",
            "CASE WHEN pmod(o_orderkey, 3) <> 2 THEN 'card_declined' END AS error",
            "CASE WHEN pmod(o_orderkey, 4) = 1 THEN 'manual' ELSE 'schedule' END AS trigger",
            f"{sql_ts(self.p.as_of)} - make_dt_interval(0, 0, CAST(pmod(o_orderkey, 601) AS INT)) AS created_at",
        )

    # --------------------------------------------------------------- stripe.*
    def _orders_slice(self, r: int) -> DataFrame:
        return self.raw("orders").filter(f"pmod(o_orderkey, 3) = {r}")

    @cached_property
    def charges(self) -> DataFrame:
        failed = "(o_orderstatus = 'P' AND pmod(o_orderkey, 2) = 0)"
        refunded = "CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 500 ELSE 0 END AS BIGINT)"
        last4 = "lpad(CAST(pmod(o_orderkey, 10000) AS STRING), 4, '0')"
        details = ("""CASE WHEN pmod(o_orderkey, 7) = 0 THEN '{"type":"card","card":{"brand":"mastercard"}}' """
                   f"""WHEN pmod(o_orderkey, 13) = 0 THEN concat('{{"type":"card","card":{{"last4":"', {last4}, '"}}}}') """
                   f"""ELSE concat('{{"type":"card","card":{{"brand":"visa","last4":"', {last4}, '"}}}}') END""")
        kind = "CASE WHEN pmod(o_orderkey, 4) = 0 THEN 'auto_topup' ELSE 'checkout' END"
        return self._orders_slice(0).selectExpr(
            "concat('ch_', CAST(o_orderkey AS STRING)) AS id",
            "concat('cus_', CAST(o_custkey AS STRING)) AS customer",
            "CASE WHEN pmod(o_orderkey, 5) = 0 THEN CAST(NULL AS STRING) ELSE concat('pm_', CAST(pmod(o_orderkey, 97) AS STRING)) END AS payment_method",
            f"{details} AS payment_method_details",
            f"CAST({pack_sql('o_orderkey')} AS BIGINT) AS amount",
            f"{refunded} AS amount_refunded",
            "CASE WHEN pmod(o_orderkey, 31) = 0 THEN 'eur' ELSE 'usd' END AS currency",
            f"CASE WHEN {failed} THEN 'failed' ELSE 'succeeded' END AS status",
            f"NOT {failed} AS paid",
            f"{refunded} > 0 AS refunded",
            "CASE WHEN pmod(o_orderkey, 37) = 0 THEN CAST(NULL AS BOOLEAN) ELSE pmod(o_orderkey, 23) = 0 END AS disputed",
            "concat('https://pay.example/receipts/ch_', CAST(o_orderkey AS STRING)) AS receipt_url",
            f"""concat({sql_str('{"app":"' + self.p.app_tag + '","kind":"')}, {kind}, '","order":"', {ORDER_REF_SQL}, '"}}') AS metadata""",
            "unix_seconds(o_orderdate) AS created",
        )

    @cached_property
    def checkout_sessions(self) -> DataFrame:
        tag = self.p.app_tag
        meta = (f"""concat(CASE WHEN pmod(o_orderkey, 41) = 0 THEN {sql_str('{"app":"' + tag + '"')} """
                f"""ELSE concat({sql_str('{"app":"' + tag + '","credits_cents":"')}, CAST({pack_sql('o_orderkey')} AS STRING), '"') END, """
                f"""',"order":"', {ORDER_REF_SQL}, '"}}')""")
        return self._orders_slice(1).selectExpr(
            "concat('cs_', CAST(o_orderkey AS STRING)) AS id",
            "concat('cus_', CAST(o_custkey AS STRING)) AS customer",
            "CASE WHEN pmod(o_orderkey, 13) = 0 THEN 'subscription' ELSE 'payment' END AS mode",
            "CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'complete' END AS status",
            "CASE WHEN pmod(o_orderkey, 11) = 0 THEN 'unpaid' ELSE 'no_payment_required' END AS payment_status",
            "CAST(CASE WHEN pmod(o_orderkey, 29) = 0 THEN 1000 ELSE 0 END AS BIGINT) AS amount_total",
            f"{meta} AS metadata",
            "unix_seconds(o_orderdate) AS created",
        )

    @cached_property
    def invoices(self) -> DataFrame:
        total = "CAST(CASE WHEN pmod(o_orderkey, 29) = 0 THEN 1000 ELSE 0 END AS BIGINT)"
        tag = f"CASE WHEN pmod(o_orderkey, 19) = 0 THEN 'other' ELSE {sql_str(self.p.app_tag)} END"
        return self._orders_slice(2).selectExpr(
            "concat('in_', CAST(o_orderkey AS STRING)) AS id",
            "concat('cus_', CAST(o_custkey AS STRING)) AS customer",
            "CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'paid' END AS status",
            f"{total} AS total",
            f"{total} AS amount_paid",
            "concat('https://pay.example/invoices/in_', CAST(o_orderkey AS STRING)) AS hosted_invoice_url",
            f"""concat('{{"app":"', {tag}, '","kind":"auto_topup","credits_cents":"', CAST({pack_sql('o_orderkey')} AS STRING), '","order":"', {ORDER_REF_SQL}, '"}}') AS metadata""",
            "unix_seconds(o_orderdate) AS created",
        )

    @cached_property
    def customers_raw(self) -> DataFrame:
        """Change feed of synced customers: JSON documents with key and version columns.

        One version per synced customer (none when ``c_custkey % 19 = 0``); customers with
        ``c_custkey % 5 = 0`` get a second, newer version with another email.
        """
        c = self.raw("customer").filter("pmod(c_custkey, 17) <> 0 AND pmod(c_custkey, 19) <> 0")
        versions = c.selectExpr("*", "explode(CASE WHEN pmod(c_custkey, 5) = 0 THEN array(1, 2) ELSE array(1) END) AS version")
        k = "CAST(c_custkey AS STRING)"
        email = (f"""CASE WHEN version = 2 THEN concat('"c', {k}, '@new.example.com"') """
                 "WHEN pmod(c_custkey, 11) = 0 THEN 'null' "
                 f"""WHEN pmod(c_custkey, 4) = 0 THEN concat('"user', {k}, {sql_str("@" + self.p.placeholder_domain + '"')}) """
                 f"""ELSE concat('"c', {k}, '@example.com"') END""")
        cid = f"concat('cus_', {k})"
        doc = (f"""concat('{{"id":"', {cid}, '","object":"customer","email":', {email}, ',"name":"', c_name, """
               f"""{sql_str('","metadata":{"app":"' + self.p.app_tag + '","account_id":"')}, {k}, """
               f"""'"}},"created":', CAST({CUSTOMER_EPOCH} + c_custkey AS STRING), '}}')""")
        return versions.selectExpr(
            f"{cid} AS id",
            "'acct_main' AS _account_id",
            f"{sql_ts(datetime(2024, 1, 1))} + make_dt_interval(0, CAST(version AS INT)) AS _updated_at",
            f"{doc} AS _raw_data",
        )

    def synced_feed(self, table: str) -> DataFrame:
        """Change feed of a synced table: every object as a JSON document in an old version
        (another ``created``) and the current one, which arrives twice."""
        doc_schema = SYNCED[table]
        nested = {"metadata": "map<string,string>", "payment_method_details": "type string, card struct<brand:string, last4:string>"}
        doc = [F.from_json(f.name, nested[f.name]).alias(f.name) if f.name in nested else F.col(f.name) for f in doc_schema.fields]
        versions = getattr(self, table).withColumn("_v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))))
        versions = versions.withColumn("created", F.when(F.col("_v") == 1, 0).otherwise(F.col("created")))
        return versions.select("id", F.lit("acct_main").alias("_account_id"),
                               (ts_lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), "_v")).alias("_updated_at"),
                               F.to_json(F.struct(*doc)).alias("_raw_data"))

    @cached_property
    def prices(self) -> DataFrame:
        """Synced catalog prices (from ``part``): many versions per lookup key."""
        tag, old = self.p.app_tag, self.p.old_tag
        return self.raw("part").selectExpr(
            "concat('price_', CAST(p_partkey AS STRING)) AS id",
            f"CASE pmod(p_partkey, 4) WHEN 0 THEN {sql_str(tag + '_credits_10')} WHEN 1 THEN {sql_str(tag + '_credits_25')} "
            f"WHEN 2 THEN {sql_str(tag + '_credits_100')} ELSE {sql_str(old + '_credits_10')} END AS lookup_key",
            "(pmod(p_partkey, 3) <> 0 AND pmod(p_partkey, 4) <> 2) AS active",
            "CAST(CASE pmod(p_partkey, 4) WHEN 1 THEN 2500 WHEN 2 THEN 10000 ELSE 1000 END AS BIGINT) AS unit_amount",
            f"CAST({CATALOG_EPOCH} + p_partkey * 60 AS BIGINT) AS created",
        )

    @cached_property
    def promotion_codes(self) -> DataFrame:
        """Synced promotion codes (from ``supplier``)."""
        return self.raw("supplier").selectExpr(
            "concat('promo_', CAST(s_suppkey AS STRING)) AS id",
            f"CASE WHEN pmod(s_suppkey, 3) = 2 THEN {sql_str(self.p.old_tag.upper() + '100')} ELSE {sql_str(self.p.promotion_code)} END AS code",
            "pmod(s_suppkey, 4) <> 0 AS active",
            f"CAST({CATALOG_EPOCH} + s_suppkey * 60 AS BIGINT) AS created",
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        """One log stream per account (from ``events``); errors are wrapped in ANSI red."""
        msg = ("concat('user ', CAST(user_id AS STRING), ' event ', CAST(event_id AS STRING), ' k=', "
               "get_json_object(props, '$.k'))")
        return self.raw("events").selectExpr(
            "event_id AS id",
            "user_id AS stream",
            "CASE WHEN pmod(event_id, 97) = 0 THEN CAST(NULL AS TIMESTAMP) ELSE ts END AS at",
            "date_format(ts, 'HH:mm:ss') AS `timestamp`",
            "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' "
            "WHEN 'click' THEN 'info' END AS level",
            "event_type AS source",
            f"CASE WHEN event_type = 'error' THEN concat(chr(27), '[31m', {msg}, chr(27), '[0m') ELSE {msg} END AS message",
        )

    @cached_property
    def moderation_requests(self) -> DataFrame:
        """Attempted moderation calls: one per document, raw text in, four per account,
        arriving one minute apart over the two days after ``as_of``."""
        key = f"concat({sql_str(self.p.key_prefix)}, lpad(CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING), 12, '0'))"
        auth = (f"CASE WHEN pmod(doc_id, 31) = 0 THEN CAST(NULL AS STRING) WHEN pmod(doc_id, 23) = 0 THEN concat('Basic ', {key}) "
                f"WHEN pmod(doc_id, 29) = 0 THEN concat('bearer  ', {key}) ELSE concat('Bearer ', {key}) END")
        return self.raw("documents").selectExpr(
            "doc_id AS request_id",
            f"{auth} AS authorization",
            "text",
            f"{sql_ts(self.p.as_of)} + make_dt_interval(0, 0, CAST(pmod(doc_id, 2880) AS INT)) AS at",
        )

    @cached_property
    def score_answers(self) -> DataFrame:
        """The scoring model's raw answers (JSON text), one per request with items,
        however many (an oversized request is refused by F10, not by the scorer).

        Scores are derived from ids (harassment 0.9 for documents labelled toxic); some
        answers are broken on purpose by ``request_id % 17``: 1 trailing text, 2 a missing
        item, 3 a score of 1.2, 4 a repeated index, 5 a score given as text, 6 index 1.0
        (valid), 7 ``results`` as an object, 8 NaN.
        """
        from meterwise.operators.moderation import request_validation

        return self.answers_to(request_validation(self.moderation_requests))

    def answers_to(self, validation: DataFrame) -> DataFrame:
        """``score_answers`` from the item counts alone (``request_id``, ``n_items``)."""
        counted = validation.filter(F.col("n_items") > 0).select("request_id", F.col("n_items").alias("n"))
        items = counted.select("request_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
        lab = self.raw("labels").select(F.col("doc_id").alias("request_id"), "toxic")
        it = items.join(lab, "request_id", "left")
        brk = "pmod(request_id, 17)"
        edge = "pmod(request_id + idx, 50)"

        def base(i: int) -> str:
            return f"concat('0.', lpad(CAST(pmod(request_id * 7 + idx * 13 + {i * 29}, 1000) * 5 AS STRING), 4, '0'))"

        sc = {c: base(i) for i, c in enumerate(CATEGORIES_FX)}
        sc["harassment"] = f"CASE WHEN {brk} = 3 AND idx = 0 THEN '1.2' WHEN toxic = 1 THEN '0.9' ELSE {sc['harassment']} END"
        sc["hate"] = f"""CASE WHEN {brk} = 5 AND idx = 0 THEN '"0.5"' WHEN {edge} = 0 THEN '0.3995' ELSE {sc['hate']} END"""
        sc["violence"] = f"CASE WHEN {edge} = 1 THEN '0.5005' ELSE {sc['violence']} END"
        sc["sexual"] = f"CASE WHEN {edge} = 2 THEN '0.4' ELSE {sc['sexual']} END"
        sc["self_harm"] = f"CASE WHEN {edge} = 3 THEN '0.8' ELSE {sc['self_harm']} END"
        sc["spam"] = f"CASE WHEN {brk} = 8 AND idx = 0 THEN 'NaN' ELSE {sc['spam']} END"
        index_txt = (f"CASE WHEN {brk} = 4 AND idx = n - 1 THEN (CASE WHEN n > 1 THEN '0' ELSE '1' END) "
                     f"WHEN {brk} = 6 AND idx = 1 THEN '1.0' ELSE CAST(idx AS STRING) END")
        reason = ("""CASE WHEN pmod(request_id, 13) = 0 THEN '42' WHEN toxic = 1 THEN '"harassing language"' """
                  """WHEN pmod(request_id, 11) = 0 THEN concat('"', repeat('long reason ', 30), '"') ELSE '""' END""")
        parts = ["""'{"index":'""", index_txt, """',"scores":{'"""]
        for i, c in enumerate(CATEGORIES_FX):
            parts += [sql_str(("," if i else "") + f'"{c}":'), sc[c]]
        parts += ["""'},"reason":'""", reason, "'}'"]
        entry = f"concat({', '.join(parts)})"
        keep = f"NOT ({brk} = 2 AND idx = n - 1)"
        g = it.groupBy("request_id", "n").agg(
            F.expr(f"sort_array(collect_list(CASE WHEN {keep} THEN struct(idx AS i, {entry} AS e) END))").alias("es"))
        body = """concat('{"results":[', array_join(es.e, ','), ']}')"""
        answer = (f"""CASE WHEN {brk} = 7 THEN '{{"results":{{"index":0}}}}' """
                  f"WHEN {brk} = 1 THEN concat({body}, ' trailing') ELSE {body} END")
        no_usage = "pmod(request_id, 37) = 0"
        return g.selectExpr(
            "request_id",
            f"{answer} AS answer",
            "CASE WHEN pmod(request_id, 19) = 0 THEN 500 ELSE 200 END AS upstream_status",
            f"CAST(CASE WHEN {no_usage} THEN NULL ELSE 100 + 50 * n END AS INT) AS prompt_tokens",
            "CAST(CASE WHEN pmod(request_id, 3) = 0 THEN 10 * n END AS INT) AS cached_tokens",
            f"CAST(CASE WHEN {no_usage} THEN NULL ELSE 40 * n END AS INT) AS completion_tokens",
            "CAST(CASE WHEN pmod(request_id, 2) = 1 THEN 5 * n END AS INT) AS reported_reasoning_tokens",
            "CAST(pmod(request_id * 37, 500) AS INT) AS reasoning_chars",
        )

    @cached_property
    def key_revokes(self) -> DataFrame:
        """Revoke requests: by the owner (``key_id % 7 = 0``, twice), and by another account
        (``key_id % 11 = 0``), which must be ignored."""
        c = self.api_key_creates.select("key_id", "account_id")
        k = F.col("key_id")
        own = c.filter(F.pmod(k, F.lit(7)) == 0)
        first = own.select("key_id", "account_id", (self.as_of - F.expr("INTERVAL 1 DAY")).alias("at"))
        again = own.select("key_id", "account_id", (self.as_of - F.expr("INTERVAL 1 HOUR")).alias("at"))
        other = c.filter(F.pmod(k, F.lit(11)) == 0).select("key_id", (F.col("account_id") + 1).alias("account_id"),
                                                            (self.as_of - F.expr("INTERVAL 2 DAYS")).alias("at"))
        return first.unionByName(again).unionByName(other)

    @cached_property
    def settings_changes(self) -> DataFrame:
        """Auto top-up settings saved from the dashboard (cents), one or two per account."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        r = F.pmod(k, F.lit(5))
        on = c.filter(r.isin(1, 3)).select(k.alias("account_id"), (self.as_of - F.expr("INTERVAL 3 DAYS")).alias("at"),
                                           F.lit(True).alias("enabled"), F.lit(500).alias("threshold_cents"),
                                           F.lit(2500).alias("amount_cents"))
        off = c.filter(r.isin(2, 3)).select(k.alias("account_id"), (self.as_of - F.expr("INTERVAL 1 HOUR")).alias("at"),
                                            F.lit(False).alias("enabled"), F.lit(1000).alias("threshold_cents"),
                                            F.lit(10000).alias("amount_cents"))
        return on.unionByName(off)

    # ------------------------------------------------------------- derived
    @cached_property
    def customers(self) -> DataFrame:
        """Typed, latest version of every synced customer (S2 on the feed, then S1)."""
        from meterwise.sources.synced import synced_latest, synced_typed

        return synced_typed(synced_latest(self.customers_raw))

    @cached_property
    def wallet_snapshot(self) -> DataFrame:
        """W5 computed once and cut from its lineage (a reliable checkpoint in the shared
        ``spark.checkpoint.dir``), for jobs that read the wallet more than once."""
        from meterwise.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(self.spark)
        return self.balances.checkpoint(eager=True)

    @cached_property
    def balances(self) -> DataFrame:
        from meterwise.operators.wallet import balances

        return balances(self.accounts, self.charges, self.checkout_sessions, self.invoices,
                        self.usage_events, self.simulated_spend, self.p.app_tag)
