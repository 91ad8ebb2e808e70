"""U-T5: a command whose reply has not come is in flight, not failed."""

from meterwise.operators import topups as TU

COMMANDS = "account_id long, amount_cents long, idempotency_key string, trigger string, action string, error string"
REPLIES = "idempotency_key string, invoice_id string, invoice_status string, reply_error string"


def outcomes(spark, replies):
    commands = [(1, 500, "a", "schedule", "send", None), (2, 500, "b", "schedule", "failed", "no code"), (3, 500, "c", "manual", "send", None)]
    rows = TU.topup_outcomes(spark.createDataFrame(commands, COMMANDS), spark.createDataFrame(replies, REPLIES)).collect()
    return {r.account_id: (r.status, r.error, r.disable_auto_topup) for r in rows}


def test_no_reply_yet(spark):
    assert outcomes(spark, []) == {1: ("pending", None, False), 2: ("failed", "no code", True), 3: ("pending", None, False)}


def test_replies(spark):
    got = outcomes(spark, [("a", None, None, "declined"), ("c", "in_1", None, None)])
    assert got == {1: ("failed", "declined", True), 2: ("failed", "no code", True), 3: ("open", None, False)}
