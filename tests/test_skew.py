"""A hot account: one key holds a third of all rows, spread over many days, with calls
exactly 24 h apart and ties in time. The day-split windows (T6, T7) and the wallet's
partial aggregation must give the same answers as a plain-Python pass over each account."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterwise.operators import usage as U
from meterwise.operators import wallet as W

DAY_US = 24 * 3600 * 1_000_000
HOT = 1


@pytest.fixture(scope="module")
def calls():
    rnd = random.Random(7)
    rows, next_id = [], 0
    base = 1_704_067_200 * 1_000_000  # 2024-01-01 UTC

    def add(acc, t):
        nonlocal next_id
        next_id += 1
        rows.append((next_id, acc, t, rnd.randint(-5, 40) * 1000))

    for _ in range(3000):  # the hot account: a third of the rows, over 12 days
        add(HOT, base + rnd.randrange(12 * DAY_US))
    for t in (base + 3 * DAY_US, base + 4 * DAY_US, base + 4 * DAY_US, base + 5 * DAY_US - 1):
        add(HOT, t)  # exactly 24 h apart (not in the window), a tie, and 1 us inside
    for acc in range(2, 62):
        for _ in range(100):
            add(acc, base + rnd.randrange(12 * DAY_US))
    return rows


@pytest.fixture(scope="module")
def usage(spark, calls):
    df = spark.createDataFrame(calls, "id long, account_id long, us long, price_micros long")
    return df.select("id", "account_id", F.timestamp_micros("us").alias("created_at"), "price_micros")


def test_hot_account_holds_a_third(calls):
    assert 3 * sum(1 for r in calls if r[1] == HOT) >= len(calls)


def test_rolling_24h_matches_brute_force(usage, calls):
    got = {r["id"]: (r["used_24h"], r["slot_us"]) for r in
           U.rolling_24h(usage).select("id", "used_24h", F.unix_micros("slot_at").alias("slot_us")).collect()}
    by = {}
    for i, acc, t, _ in calls:
        by.setdefault(acc, []).append(t)
    want = {}
    for i, acc, t, _ in calls:
        inside = [s for s in by[acc] if t - DAY_US < s <= t]
        want[i] = (len(inside), min(inside) + DAY_US)
    assert got == want


def test_running_balance_matches_brute_force(spark, usage, calls):
    entries = usage.select("account_id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("entry_id"),
                           F.col("created_at").alias("entry_at"), (-F.col("price_micros")).alias("delta_micros"),
                           F.lit(1).alias("entry_rank"))
    got = {r["entry_id"]: r["balance_micros"] for r in U.running_balance(entries).collect()}
    want, by = {}, {}
    for i, acc, t, p in calls:
        by.setdefault(acc, []).append((t, f"u{i}", -p))
    for acc, es in by.items():
        bal = 0
        for t, eid, d in sorted(es):
            bal += d
            want[eid] = bal
    assert got == want


def test_spend_per_account_matches_brute_force(spark, usage, calls):
    sim = spark.createDataFrame([], "account_id long, amount_micros long")
    got = {r["account_id"]: r["micros"] for r in W.spent(usage, sim).collect()}
    want = {}
    for _, acc, _, p in calls:
        want[acc] = want.get(acc, 0) + p
    assert got == want


def fold_rows(spark, seed=11, hot=2000, days=60):
    """A hot account that pauses now and then, and others that run dry, get credits, and go on."""
    rnd = random.Random(seed)
    base = 1_706_659_200 * 1_000_000  # 2024-01-31 UTC
    rows, rid = [], 0
    for acc, n in [(HOT, hot)] + [(a, 50) for a in range(2, 42)]:
        rows.append(("credit", None, acc, base, 5_000_000 if acc == HOT else rnd.randrange(0, 400_000), None))
        rows += [("prior", None, acc, base - rnd.randrange(DAY_US), 0, None) for _ in range(2)]
        rows += [("credit", None, acc, base + rnd.randrange(days * DAY_US), rnd.randrange(100_000), None) for _ in range(3)]
        for _ in range(n):
            rid += 1
            day = rnd.choice([d for d in range(days) if d % 7 < 4])  # three days of each week are quiet
            outcome = rnd.choices(["ok", "invalid", "upstream"], [70, 15, 15])[0]
            rows.append(("attempt", rid, acc, base + day * DAY_US + rnd.randrange(DAY_US), rnd.randrange(1000, 90_000), outcome))
    df = spark.createDataFrame(rows, "kind string, request_id long, account_id long, us long, micros long, outcome string")
    return df.select("kind", "request_id", "account_id", F.timestamp_micros("us").alias("at"), "micros", "outcome")


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_replay_fold_carries_a_hot_account_across_segments_and_arrow_batches(spark, limit):
    from test_properties import _answers, _brute_force_replay

    from meterwise.operators import admission as AD

    df = fold_rows(spark, seed=limit)
    want = _brute_force_replay([r.asDict() for r in df.collect()], limit)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "50")  # the hot account spans about 40 batches
    try:
        got = _answers(AD.replay_fold(df, limit))
    finally:
        spark.conf.set(key, old)
    assert got == want
    assert {s for _, s, _ in want} >= {200, 402, 429, 502}


def test_a_hot_account_is_folded_in_several_tasks(spark):
    from meterwise.operators import admission as AD

    segs = AD.segmented(fold_rows(spark)).filter(F.col("account_id") == HOT)
    sizes = {r.seg: r["count"] for r in segs.groupBy("seg").count().collect()}
    assert len(sizes) >= 8 and max(sizes.values()) < 400


def test_usage_rollup_holds_its_calls_once(spark):
    """One shuffle and one sort, no hash table of hours times granularities; weeks do not nest in months."""
    start = datetime(2024, 1, 29, 22)
    calls = [(a, n, 10 * n if n else None, start + timedelta(minutes=7 * n * a)) for a in (1, 2, 3) for n in range(400)]
    calls += [(None, 5, 1, start), (1, None, None, None), (1, None, 3, None), (2, 4, 4, start), (2, 4, 4, start)]
    usage = spark.createDataFrame(calls, "account_id long, units int, price_micros long, created_at timestamp")
    plan = U.usage_rollup(usage)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    for grains in (("hour", "day", "month"), ("month", "week", "day"), ("day",)):
        got = sorted(map(tuple, U.usage_rollup(usage, grains).collect()), key=str)
        want = [tuple(r) for g in grains for r in usage.groupBy("account_id", F.lit(g), F.date_trunc(g, "created_at")).agg(
            F.count(F.lit(1)).cast("int"), F.sum("units").cast("long"), F.sum("price_micros").cast("long")).collect()]
        assert got == sorted(want, key=str)
