"""Small cases: calls that arrive late, attempts spread over Arrow batches, text cuts, units, triggers."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meterwise.functions.scalars import utf16_prefix
from meterwise.operators import audit as AU
from meterwise.operators import moderation as MO
from meterwise.operators import purchases as PU
from meterwise.operators import usage as U
from meterwise.operators.admission import AccountFold
from meterwise.schemas import OWNED, read_owned
from meterwise.sources import lifecycle as LC
from meterwise.streaming.jobs import _rows_of
from meterwise.streaming.sinks import read_if_written, read_stream_table, run_available_now

T0 = pd.Timestamp("2024-01-10 00:00:00")
DAY = dt.datetime(2024, 1, 10)


def test_rows_of_a_micro_batch_are_put_in_order():
    frames = [pd.DataFrame({"at": [T0 + pd.Timedelta(hours=i) for i in ids], "request_id": ids}) for ids in ([3, 4], [1, 2])]
    assert _rows_of(iter(frames), ["at"])["request_id"].tolist() == [1, 2, 3, 4]


def test_admission_state_holds_the_whole_limit():
    hour = 3600 * 1_000_000
    fold = AccountFold(3, balance=100)
    assert [fold.step("attempt", i * hour, 1, "ok")[0] for i in (1, 2, 3)] == [200, 200, 200]
    again = AccountFold(3, fold.balance, list(fold.recorded))
    assert len(again.recorded) == 3 and again.balance == 97
    assert again.step("attempt", 4 * hour, 1, "ok") == (429, 0, False)
    assert again.step("attempt", 26 * hour, 1, "ok") == (200, 1, True)


def test_late_first_writes_reach_the_ledger(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    cols = "id long, account_id long, created_at timestamp"
    ledger = spark.createDataFrame([(1, 1, day(10)), (2, 1, day(12))], cols)
    batch = spark.createDataFrame([(2, 1, day(12)), (4, 1, day(1)), (4, 1, day(2)), (3, 1, day(11))], cols)
    got = sorted((r.id, r.created_at) for r in LC.ledger_append(ledger, batch).collect())
    assert got == [(3, day(11)), (4, day(1))]


def test_streams_see_files_that_land_later(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("event_id"))
    rows.toPandas().to_parquet(tmp_path / "events.parquet")
    rows.toPandas().to_parquet(tmp_path / "events_2.parquet")
    rows.toPandas().to_parquet(tmp_path / "eventsother.parquet")
    d = run_available_now(read_stream_table(spark, str(tmp_path), "events"), "later-files")
    assert spark.read.parquet(f"{d}/data").count() == 6


def test_only_a_missing_folder_counts_as_nothing_written(spark, tmp_path):
    assert read_if_written(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception) as failure:
        read_if_written(spark, str(tmp_path / "bad")).count()
    assert not isinstance(failure.value, AttributeError)
    assert not (isinstance(failure.value, AnalysisException) and failure.value.getCondition() == "PATH_NOT_FOUND")


@pytest.mark.parametrize("text", [None, "", "abc", "abcd", "abcde", "\U0001F600" * 3, "a" + "\U0001F600" * 3, "ab\U0001F600c"])
def test_utf16_prefix(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(utf16_prefix("t", 4)).first()[0]
    want = text if text is None else text.encode("utf-16-be")[:8].decode("utf-16-be", "ignore")
    assert got == want


def test_series_totals_join_null_and_empty_units(spark):
    big = 2**53
    s = spark.createDataFrame([(1, "a", "", big), (1, "a", "", 1), (1, "b", None, 1), (1, "c", "ms", 5), (2, "a", "", 7)],
                              "account_id long, series_id string, unit string, value long")
    got = {(r.account_id, r.unit): (r.total, r.series, r.mixed_units) for r in U.series_totals(U.series_sums(s)).collect()}
    assert got == {(1, None): (big + 2, 2, True), (1, "ms"): (5, 1, True), (2, None): (7, 1, False)}
    assert {(r.account_id, r.series_id): r.total for r in U.series_sums(s).collect()} == {
        (1, "a"): big + 1, (1, "b"): 1, (1, "c"): 5, (2, "a"): 7}


def test_only_scheduled_failures_switch_auto_topup_off(spark):
    t = spark.createDataFrame([(1, "failed", "no", "schedule", DAY), (2, "failed", "no", "manual", DAY), (3, "paid", None, "schedule", DAY)],
                              "account_id long, status string, error string, trigger string, created_at timestamp")
    assert [r.account_id for r in LC.scheduled_failures(t).collect()] == [1]


def test_active_keys_are_ranked_newest_first(spark):
    k = spark.createDataFrame([(1, 1, DAY), (2, 1, DAY), (3, 1, DAY + dt.timedelta(days=1)), (4, 2, DAY)],
                              "key_id long, account_id long, created_at timestamp")
    k = k.withColumns({"name": F.lit("k"), "prefix": F.lit("p"), "last_used_at": F.lit(None).cast("timestamp"),
                       "revoked_at": F.when(F.col("key_id") == 4, F.col("created_at"))})
    assert {r.key_id: r.newest_rank for r in PU.active_keys(k).collect()} == {3: 1, 2: 2, 1: 3}


def test_audits_fire(spark):
    t = spark.createDataFrame([(1, 499), (2, 500), (3, None)], "id long, amount_cents int")
    sim = spark.createDataFrame([(1, -5), (2, 5), (3, 0)], "id long, amount_micros long")
    prices = spark.createDataFrame([("a", -1), ("b", 0)], "service string, unit_price_micros long")
    calls = spark.createDataFrame([(1, 0, 0), (2, -1, 0), (3, 0, -1), (4, None, 1)], "id long, price_micros long, cost_micros long")
    got = sorted((r.table_name, r.id) for r in AU.check_violations(t, sim, prices, calls).collect())
    assert got == [("service_prices", "a"), ("simulated_spend", "1"), ("simulated_spend", "3"), ("topups", "1"),
                   ("usage_events", "2"), ("usage_events", "3")]
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "ref long")
    parent = spark.createDataFrame([(1,), (2,)], "key long")
    assert [(r.table_name, r.ref, r.n) for r in AU.orphans({"c": (child, "ref")}, parent, "key").collect()] == [("c", "9", 2)]
    entries = spark.createDataFrame([("o1", "charge", 30), ("o1", "session", 20), ("o1", "invoice", 5), ("o2", "charge", 7), (None, "charge", 1)],
                                    "order_key string, source string, micros long")
    assert [tuple(r) for r in AU.no_double_count(entries).collect()] == [("o1", 3, "charge,invoice,session", 25)]


def test_one_order_counted_twice_is_found_across_kinds(spark):
    """A paid charge and a free session of one order, told by the reference in their metadata."""
    meta = lambda o: '{"app":"appx","credits_cents":"100","order":"%s"}' % o if o else '{"app":"appx","credits_cents":"100"}'
    ch = spark.createDataFrame([("ch_1", "c", "succeeded", True, False, "usd", 500, 0, meta("A"), 1), ("ch_2", "c", "succeeded", True, False, "usd", 500, 0, meta(None), 1),
                                ("ch_3", "c", "failed", False, False, "usd", 500, 0, meta("B"), 1)],
                               "id string, customer string, status string, paid boolean, disputed boolean, currency string, amount long, amount_refunded long, metadata string, created long")
    cs = spark.createDataFrame([("cs_1", "c", "payment", "complete", "paid", 0, meta("A"), 1), ("cs_2", "c", "payment", "complete", "paid", 0, meta("B"), 1)],
                               "id string, customer string, mode string, status string, payment_status string, amount_total long, metadata string, created long")
    inv = spark.createDataFrame([("in_1", "c", "paid", 0, meta("C"), 1)], "id string, customer string, status string, total long, metadata string, created long")
    got = AU.no_double_count(AU.order_entries(ch, cs, inv, "appx")).collect()
    assert [tuple(r) for r in got] == [("A", 2, "charge,session", 100 * 10_000)]  # B's charge failed: not counted


def test_request_bodies(spark):
    bodies = {'{"input": "a"}': ["a"], '{"input": ["a", " b "]}': ["a", " b "], '{"input": ""}': None, '{"input": []}': None,
              '{"input": ["a", ""]}': None, '{"input": ["a", 1]}': None, '{"input": ["a", null]}': None, '{"input": 3}': None,
              '{"other": "a"}': None, "no json": None, None: None, '{"input": {"a": 1}}': None}
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "request_id long, body string")
    got = {r.request_id: r for r in MO.body_validation(df).collect()}
    assert [got[i].items for i in range(len(bodies))] == list(bodies.values())
    assert {got[i].validation for i, v in enumerate(bodies.values()) if v is None} == {"invalid_input"}
    assert got[1].validation == "ok" and got[1].n_items == 2 and got[1].units == 2 and got[2].units == 0


def test_verdicts_follow_the_text(spark):
    df = spark.createDataFrame([(1, "you stupid idiot loser\n\na nice day"), (2, "stupid idiot"), (3, ""), (4, None)],
                               "request_id long, text string")
    got = {(r.request_id, r.idx): (r.verdict, list(r.flagged)) for r in MO.text_verdicts(df).collect()}
    assert got == {(1, 0): ("block", ["harassment"]), (1, 1): ("allow", []), (2, 0): ("review", ["harassment"])}


def test_owned_tables_are_read_with_their_schema(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, DAY)], "id long, account_id long, amount_micros long, created_at timestamp")
    rows.withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "t"))
    got = read_owned(spark, str(tmp_path / "t"), "simulated_spend")
    assert [f.name for f in got.schema] == [f.name for f in OWNED["simulated_spend"]] and got.count() == 1
    for k, bad in enumerate((rows.drop("amount_micros"), rows.withColumn("amount_micros", F.col("amount_micros").cast("string")))):
        bad.write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError, match="amount_micros"):
            read_owned(spark, str(tmp_path / f"bad{k}"), "simulated_spend")


def test_scorer_is_made_once_and_called_once_a_batch(spark, tmp_path):
    """A counting scorer sees exactly M2's batches, with their budgets; a call that fails costs its own
    request alone."""
    log = str(tmp_path / "calls")
    texts = [(i, "\n".join(f"line {i} {k}" for k in range(n))) for i, n in enumerate([1, 20, 21, 45, 3])] + [(9, "boom\nx")]
    requests = spark.createDataFrame(texts, "request_id long, text string").repartition(2)

    def factory():
        import os
        import uuid

        os.makedirs(log, exist_ok=True)
        open(f"{log}/made-{uuid.uuid4().hex}", "w").close()
        inner = MO.lexicon_scorer()

        def score(items, max_tokens):
            if items[0] == "boom":
                raise RuntimeError("no model")
            with open(f"{log}/call-{uuid.uuid4().hex}", "w") as f:
                f.write(f"{len(items)} {max_tokens} {items[0]}")
            return inner(items, max_tokens)

        return score

    batches = MO.request_batches(MO.request_items(requests)).coalesce(2)
    out = MO.score_batches(batches, factory).collect()
    calls = sorted(f.read_text() for f in (tmp_path / "calls").glob("call-*"))
    want = sorted(f"{b.n_items} {b.max_tokens} {b['items'][0]}" for b in batches.collect() if b["items"][0] != "boom")
    assert calls == want and len(calls) == 1 + 1 + 2 + 3 + 1
    assert len(list((tmp_path / "calls").glob("made-*"))) <= 2
    assert sorted((r.request_id, r.idx) for r in out if r.failure is None) == sorted((i, k) for i, t in texts if i != 9 for k in range(len(t.split("\n"))))
    assert [(r.request_id, r.idx, r.failure) for r in out if r.failure] == [(9, None, "RuntimeError: no model")]
    answers = {r.request_id: (r.upstream_status, r.answer is None) for r in MO.score_answers_of(MO.score_batches(batches, factory)).collect()}
    assert answers[9] == (500, True) and answers[0] == (200, False)


@pytest.mark.parametrize("max_ids", [0, 1_000_000])
def test_batches_of_any_size_append_alike(spark, max_ids):
    """The ids of a large batch meet the ledger by a shuffle: the same rows."""
    ledger = spark.range(0, 1000, 3).withColumn("created_at", F.lit(DAY))
    batch = spark.range(0, 500).unionByName(spark.range(0, 50)).withColumn("created_at", F.lit(DAY))
    got = sorted(r.id for r in LC.ledger_append(ledger, batch, max_ids).collect())
    assert got == [i for i in range(500) if i % 3]


def test_a_failed_call_leaves_no_ledger_row(spark, fx):
    """From text to ledger with a scorer that fails on some texts: those requests have no verdict and no
    row, all others the same as without a failure."""
    from meterwise.operators import admission as AD

    requests = fx.moderation_requests
    facts = MO.request_validation(requests, keep=("authorization", "at", "text"))
    parts = (fx.api_keys, fx.usage_events, fx.balances, fx.service_prices, fx.model_costs, fx.p.service, fx.p.model, fx.p.as_of)

    def factory():
        inner = MO.lexicon_scorer()

        def score(items, max_tokens):
            if sum(map(len, items)) % 2:
                raise TimeoutError("no answer")
            return inner(items, max_tokens)

        return score

    verdicts, rows = AD.text_to_ledger(facts, facts, *parts)
    some, fewer = AD.text_to_ledger(facts, facts, *parts, scorer=factory)
    whole, left = {r.id: r for r in rows.collect()}, {r.id: r for r in fewer.collect()}
    assert 0 < len(left) < len(whole) and all(whole[i] == r for i, r in left.items())
    assert {r.request_id for r in some.select("request_id").distinct().collect()} < {r.request_id for r in verdicts.select("request_id").distinct().collect()}
