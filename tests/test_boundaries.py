"""Boundary cases on hand-made rows (the reference's own edge rules)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterwise.config import CATEGORIES
from meterwise.operators import moderation as MO
from meterwise.operators import topups as TU
from meterwise.operators import usage as U
from meterwise.operators import wallet as W
from meterwise.functions.scalars import cents_text, money_text, utf16_length

AS_OF = datetime(2024, 1, 31)


def test_null_paid_or_disputed_drops_charge(spark):
    rows = [("a", True, False), ("b", None, False), ("c", True, None), ("d", True, True)]
    df = spark.createDataFrame([(i, "succeeded", p, d, "usd") for i, p, d in rows], "id string, status string, paid boolean, disputed boolean, currency string")
    assert [r.id for r in W.settled_charges(df).collect()] == ["a"]


def test_utf16_length_counts_surrogate_pairs(spark):
    df = spark.createDataFrame([("a\U0001F600b",), ("",), ("é",)], "t string")
    assert [r.n for r in df.select(utf16_length("t").alias("n")).collect()] == [4, 0, 1]


def test_item_units_edges(spark):
    texts = ["", "x" * 2000, "x" * 2001, "x" * 4000, "\U0001F600" * 1000, "\U0001F600" * 1001]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from meterwise.functions.scalars import item_units

    assert [r.u for r in df.select(item_units("t").alias("u")).collect()] == [1, 1, 2, 2, 1, 2]


def test_request_validation_order(spark):
    reqs = [(1, ""), (2, "\n".join(["x"] * 21)), (3, "ok\n" + "y" * 8001), (4, "a\n\n  b  \n" + "z" * 8000), (5, " \t\n")]
    df = spark.createDataFrame(reqs, "request_id long, text string")
    v = {r.request_id: (r.validation, r.bad_index, r.n_items) for r in MO.request_validation(df).collect()}
    assert v[1][0] == "empty_input" and v[5][0] == "empty_input"
    assert v[2][0] == "too_many_items"
    assert v[3] == ("item_too_long", 1, 2)
    assert v[4] == ("ok", None, 3)


def test_items_indexed_after_dropping_blanks(spark):
    df = spark.createDataFrame([(1, "\n first \n\n second　\n")], "request_id long, text string")
    assert [(r.idx, r.item) for r in MO.request_items(df).collect()] == [(0, "first"), (1, "second")]


def _answer(scores, index="0", reason='"r"', extra=""):
    s = ",".join(f'"{c}":{scores.get(c, "0")}' for c in CATEGORIES)
    return '{"results":[{"index":%s,"scores":{%s},"reason":%s}]%s}' % (index, s, reason, extra)


def _check(spark, answers):
    a = spark.createDataFrame([(i, t, 200) for i, t in enumerate(answers)], "request_id long, answer string, upstream_status int")
    v = spark.createDataFrame([(i, 1) for i in range(len(answers))], "request_id long, n_items int")
    res, rej = MO.ingest_scores(a, v)
    return {r.request_id: r.reason for r in rej.collect()}, {r.request_id: r for r in res.collect()}


def test_strict_answer_checks(spark):
    answers = [
        _answer({}),                                   # 0 ok
        _answer({}) + " trailing",                     # 1 trailing text
        _answer({"hate": '"0.5"'}),                    # 2 text score
        _answer({"hate": "1.2"}),                      # 3 out of range
        _answer({"hate": "NaN"}),                      # 4 NaN
        _answer({}, index="1.0"),                      # 5 index 1 of 1 item: out of range
        _answer({}, index="0.0"),                      # 6 index 0.0 is an integer in JS
        '{"results":{"index":0}}',                     # 7 results not an array
        "",                                            # 8 empty
        _answer({}, reason="42"),                      # 9 numeric reason -> ''
        _answer({"hate": "true"}),                     # 10 boolean score
    ]
    rejects, results = _check(spark, answers)
    assert 0 not in rejects and 6 not in rejects and 9 not in rejects
    assert rejects[1] == "invalid_json" and rejects[4] == "invalid_json" and rejects[8] == "invalid_json"
    assert rejects[2] == "bad_score" and rejects[3] == "bad_score" and rejects[10] == "bad_score"
    assert rejects[5] == "bad_index" and rejects[7] == "bad_results"
    assert results[9].reason == "" and results[0].reason == "r"


def test_verdict_rounding_and_thresholds(spark):
    rows = [(1, 0, 0.3995, 0.0), (2, 0, 0.4, 0.0), (3, 0, 0.5005, 0.0), (4, 0, 0.7995, 0.0), (5, 0, 0.8, 0.8)]
    cols = "request_id long, idx int, harassment double, hate double"
    df = spark.createDataFrame(rows, cols)
    for c in CATEGORIES[2:]:
        df = df.withColumn(c, F.lit(0.0))
    df = df.withColumn("reason", F.lit(""))
    v = {r.request_id: r for r in MO.verdicts(df).collect()}
    # 0.3995 * 1000 is exactly 399.5 in binary, so it rounds up (as in JavaScript)
    assert v[1].verdict == "review" and v[1].harassment == 0.4
    assert v[2].verdict == "review" and v[2].flagged == ["harassment"]
    assert v[3].harassment == 0.5
    assert v[4].verdict == "block" and v[4].harassment == 0.8
    assert v[5].flagged == ["harassment", "hate"]
    t = {r.request_id: r.top_category for r in MO.top_category(MO.verdicts(df)).collect()}
    assert t[5] == "harassment"  # tie goes to the earlier category


def test_fixed2_matches_javascript_tofixed(spark):
    from decimal import ROUND_HALF_UP, Decimal

    ks = list(range(0, 1001))
    df = spark.createDataFrame([(k / 1000,) for k in ks], "s double")
    got = [r.t for r in df.select(MO.fixed2(F.col("s")).alias("t")).collect()]
    want = [str(Decimal(k / 1000).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for k in ks]
    assert got == want


def test_money_and_cents_text(spark):
    df = spark.createDataFrame([(1_234_567_890,), (12_345,), (1_005,), (-2_500_000,), (0,), (125_000,)], "m long")
    assert [r.t for r in df.select(money_text("m").alias("t")).collect()] == [
        "$1,234.57", "$0.0123", "$0.001005", "-$2.50", "$0.000000", "$0.1250"]
    c = spark.createDataFrame([(1000,), (250,), (500,)], "c long")
    assert [r.t for r in c.select(cents_text("c").alias("t")).collect()] == ["$10", "$3", "$5"]


def test_cooldown_is_strict_at_15_minutes(spark):
    acc = spark.createDataFrame([(1,), (2,)], "account_id long")
    t = spark.createDataFrame([(1, AS_OF - timedelta(minutes=15)), (2, AS_OF - timedelta(minutes=14, seconds=59))],
                              "account_id long, created_at timestamp")
    assert [r.account_id for r in TU.cooldown_clear(acc, t, AS_OF).collect()] == [1]


def test_rolling_24h_is_strict(spark):
    base = datetime(2024, 1, 10)
    rows = [(1, 7, base), (2, 7, base + timedelta(hours=24)), (3, 7, base + timedelta(hours=24, microseconds=-1))]
    df = spark.createDataFrame(rows, "id long, account_id long, created_at timestamp")
    got = {r.id: r.used_24h for r in U.rolling_24h(df).collect()}
    assert got == {1: 1, 3: 2, 2: 2}


def test_debit_never_below_zero(spark):
    b = spark.createDataFrame([(1, 3_000_000), (2, -5), (3, 0), (4, 10_000_000)], "account_id long, balance_micros long")
    got = {r.account_id: r.amount_micros for r in TU.debit_amount(b, 500).collect()}
    assert got == {1: 3_000_000, 4: 5_000_000}


def test_cluster_conf_sizes_partitions():
    from meterwise.session import cluster_conf

    c = cluster_conf(20 * 1024**4)  # a 20 TB shuffle
    assert int(c["spark.sql.shuffle.partitions"]) == 20 * 1024**4 // (128 * 1024 * 1024)
    assert c["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == c["spark.sql.shuffle.partitions"]
    assert cluster_conf(1)["spark.sql.shuffle.partitions"] == "200"
