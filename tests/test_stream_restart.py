"""Streams that stop, get later files with late rows, accounts and orders, and go on."""

import shutil
import uuid

import pyarrow.parquet as pq
import pytest

from conftest import SF
from meterwise.plans.catalog import REGISTRY
from meterwise.plans.compare import compare
from meterwise.streaming import jobs as J
from meterwise.streaming.state import LeveledSums

TABLES = ("events", "lineitem", "customer", "orders")
JOBS = ("stream_synced", "stream_ledger", "stream_usage", "stream_balance", "stream_sliding_24h")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Every third row of the streamed tables at first: the rest lands in two files later, old
    times, accounts with payments and orders with line items included."""
    d = tmp_path_factory.mktemp("feed")
    rest = []
    for name in ("region", "nation", "supplier", "part", "documents", "labels"):
        shutil.copy(f"{SF}/{name}.parquet", d)
    for name in TABLES:
        rows = pq.read_table(f"{SF}/{name}.parquet")
        pick = lambda k, rows=rows: rows.take(list(range(k, len(rows), 3)))
        pq.write_table(pick(0), d / f"{name}.parquet")
        rest.append((name, pick(1), pick(2)))
    return d, rest


# The checkpoint folder outlives the test: a name of its own for each test run.
RUN = uuid.uuid4().hex


def _run(spark, folder, job):
    return getattr(J, job)(J.StreamFixtures(spark, str(folder), run=RUN))


def test_streams_resume_and_equal_the_batch(spark, con, folder):
    d, rest = folder
    first = {job: _run(spark, d, job).count() for job in JOBS}
    for name, rows, _ in rest:
        pq.write_table(rows, d / f"{name}_2.parquet")
    for job in JOBS:
        _run(spark, d, job)
    # last what earlier rows wait for: accounts, then orders
    for name, _, rows in sorted(rest, key=lambda x: x[0] == "orders"):
        pq.write_table(rows, d / f"{name}_3.parquet")
        _run(spark, d, "stream_ledger")
    for job in JOBS:
        got = _run(spark, d, job)
        assert got.count() >= first[job] > 0
        if job == "stream_synced":
            from meterwise.plans.q_lifecycle import _flat

            got = _flat(got)
        if job == "stream_ledger":  # which of an id's rows came first differs from the batch
            r = compare(got.select("id"), con, f"SELECT id FROM ({REGISTRY[job].oracle_sql()}) o")
            assert r["match"] and got.select("id").distinct().count() == got.count(), r
            continue
        r = compare(got, con, REGISTRY[job].oracle_sql())
        assert r["match"], (job, r)
        # a further start finds nothing new and changes nothing
        assert _run(spark, d, job).count() == got.count()


def test_a_lost_batch_is_run_again_to_the_same_state(spark, tmp_path):
    """The same micro-batch twice, as after a lost driver: state and sums are those of one."""
    from pyspark.sql import functions as F

    from meterwise.streaming.state import KeyedTable

    schema = spark.createDataFrame([], "k long, n long").schema
    table = KeyedTable(spark, str(tmp_path / "keyed"), schema, ["k"], buckets=4)
    add = lambda rows: rows.groupBy("k").agg(F.sum("n").cast("long").alias("n"))
    batches = [[(k, 1) for k in range(b * 3, b * 3 + 10)] for b in range(6)]
    for b, rows in enumerate(batches):
        for _ in range(2 if b in (2, 5) else 1):
            table.merge(spark.createDataFrame(rows, schema), b, add)
    want = {}
    for rows in batches:
        for k, n in rows:
            want[k] = want.get(k, 0) + n
    assert {r.k: r.n for r in table.read().collect()} == want
    # a batch of one key rewrites one bucket, and a read opens one version of each
    table.merge(spark.createDataFrame([(0, 5)], schema), 6, add)
    assert len([p for p in (tmp_path / "keyed" / "v=6").iterdir() if p.name.startswith("bucket=")]) == 1
    assert len({f.split("bucket=")[1].split("/")[0] for f in table.read().inputFiles()}) == 4
    assert {r.k: r.n for r in table.read().collect()} == want | {0: want[0] + 5}


def test_partial_sums_are_merged_by_levels(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long").schema
    sums = LeveledSums(spark, str(tmp_path / "sums"), schema, ["k"], fanout=3)
    total = {}
    for b in range(20):
        rows = [(k, b + 1) for k in range(b % 4 + 1)]
        for k, n in rows:
            total[k] = total.get(k, 0) + n
        for _ in range(2 if b in (8, 9) else 1):  # in the middle of a merge, and just after it
            sums.add(spark.createDataFrame(rows, schema), b)
        if b in (8, 13, 19):
            assert {r.k: r.n for r in sums.read().collect()} == total
            assert max(r["count"] for r in sums.partial_rows().groupBy("k").count().collect()) <= 2 * 3  # fanout - 1 rows on 3 levels
