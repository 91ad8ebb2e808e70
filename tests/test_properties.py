"""Metamorphic checks across operators (batch vs stream, fold invariants)."""

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import Window

from meterwise.operators import admission as AD
from meterwise.operators import backfill as BF
from meterwise.operators import usage as U
from meterwise.plans import q_moderation as QM
from meterwise.plans.catalog import REGISTRY
from meterwise.plans.compare import compare
from meterwise.plans.dashboard import dashboard


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_balance_ends_at_wallet_balance(fx):
    rb = U.running_balance(U.wallet_entries(fx.accounts, fx.charges, fx.checkout_sessions, fx.invoices,
                                            fx.usage_events, fx.simulated_spend, fx.p.app_tag))
    rank = F.when(F.col("entry_id").startswith("u"), 1).when(F.col("entry_id").startswith("s"), 2).otherwise(0)
    w = Window.partitionBy("account_id").orderBy(F.desc("entry_at"), F.desc("_rank"), F.desc("entry_id"), F.desc("delta_micros"))
    last = (rb.withColumn("_rank", rank).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select("account_id", "balance_micros"))
    wb = fx.balances.join(last.select("account_id"), "account_id", "left_semi").select("account_id", "balance_micros")
    assert _rows(last) == _rows(wb)


def test_replay_never_admits_more_than_limit_in_24h(fx):
    rep = REGISTRY["admission_replay"].build(fx).filter("counted")
    prior = fx.usage_events.filter(F.col("created_at") > F.lit(fx.p.as_of - timedelta(hours=24)).cast("timestamp"))
    calls = rep.select("account_id", F.col("at").alias("created_at"), F.lit(1).alias("id")).unionByName(
        prior.select("account_id", "created_at", F.lit(0).alias("id")))
    counted = U.rolling_24h(calls).join(rep.select("account_id", F.col("at").alias("created_at")), ["account_id", "created_at"], "left_semi")
    assert counted.filter("used_24h > 2").count() == 0


def _brute_force_replay(rows, limit=2):
    """(request_id, status, balance after) of every attempt, from the fold's rows one by one."""
    rank = {"prior": 0, "credit": 1, "attempt": 2}
    out, state = [], {}
    for r in sorted(rows, key=lambda r: (r["at"], rank[r["kind"]], r["request_id"] or 0)):
        s = state.setdefault(r["account_id"], {"bal": 0, "rec": []})
        t, status = r["at"], None
        if r["kind"] == "prior":
            s["rec"].append(t)
        elif r["kind"] == "credit":
            s["bal"] += r["micros"]
        elif len([x for x in s["rec"] if x > t - timedelta(hours=24)]) >= limit:
            status = 429
        elif s["bal"] < r["micros"]:
            status = 402
        elif r["outcome"] == "ok":
            s["bal"], status = s["bal"] - r["micros"], 200
            s["rec"].append(t)
        else:
            status = 502
            if r["outcome"] == "invalid":
                s["rec"].append(t)
        if status:
            out.append((r["request_id"], status, s["bal"]))
    return sorted(out)


def _answers(df):
    return sorted((r.request_id, r.status_code, r.balance_after_micros) for r in df.collect())


def test_replay_matches_brute_force_and_stream(fx):
    admitted, outcomes, requests, snap = QM.replay_parts(fx)
    rows = AD.replay_input(admitted, outcomes, requests, fx.usage_events, snap, fx.p.as_of)
    want = _brute_force_replay([r.asDict() for r in rows.collect()])
    assert want and _answers(AD.replay_fold(rows)) == want
    assert _answers(REGISTRY["stream_admission"].build(fx)) == want


def test_backfills_are_idempotent(fx):
    once = BF.email_domain(fx.users, "users.oldx.invalid", fx.p.placeholder_domain)
    again = BF.email_domain(once.select("user_id", "email"), "users.oldx.invalid", fx.p.placeholder_domain)
    assert once.count() > 0 and again.count() == 0
    kept, purged = BF.purge_accounts(fx.accounts)
    k2, p2 = BF.purge_accounts(kept)
    assert purged.count() > 0 and p2.count() == 0 and k2.count() == kept.count()


def test_stream_balance_equals_batch(fx):
    assert _rows(REGISTRY["stream_balance"].build(fx)) == _rows(fx.balances)


def test_dashboard_lists_equal_their_own_queries(fx, con):
    d = dashboard(fx).cache()
    r = compare(d.select("account_id", "wallet.*"), con, REGISTRY["balances"].oracle_sql())
    assert r["match"], r
    for column, name, fields in (("purchases", "purchases_top10", ["id", "amount_cents", "refunded_cents", "status", "disputed", "auto", "created"]),
                                 ("auto_topup.recent", "recent_topups", ["id", "amount_cents", "status", "error", "created_at"]),
                                 ("usage.daily", "daily_merged", ["day", "requests", "units", "spent_micros", "simulated_micros"]),
                                 ("usage.recent", "recent_ledger", ["id", "units", "status", "price_micros", "simulated"])):
        flat = d.select("account_id", F.explode(column).alias("e")).select("account_id", *[F.col(f"e.{f}").alias(f) for f in fields])
        r = compare(flat, con, f"SELECT account_id, {', '.join(fields)} FROM ({REGISTRY[name].oracle_sql()}) own")
        assert r["match"], (column, r)
    d.unpersist()
