"""Top-ups and debits on the wallet (J8-J10, U-T1..U-T6, U-D1, U-D2).

Candidates for every account at once: accounts joined to the wallet, the
card, the attempt count and the cooldown / pending anti-joins, all keyed by
account id, so each side is shuffled (or broadcast by AQE when small) once.
The payment calls the reference makes in a loop become a command table; the
outside service's replies come back as a table and fold into new rows.
"""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.config import MICROS_PER_CENT, TOPUP_COOLDOWN_MINUTES
from meterwise.operators.purchases import card_on_file, latest_card


def _ts(dt: datetime) -> Column:
    return F.lit(dt).cast("timestamp")


def cooldown_slot(as_of: datetime) -> int:
    """Index of the cooldown window containing ``as_of`` (UTC epoch ms / window ms)."""
    return calendar.timegm(as_of.timetuple()) * 1000 // (TOPUP_COOLDOWN_MINUTES * 60_000)


def topup_attempts(accounts: DataFrame, topups: DataFrame) -> DataFrame:
    """Top-up rows per account (any status), 0 when none."""
    n = topups.groupBy("account_id").agg(F.count(F.lit(1)).cast("int").alias("attempts"))
    return accounts.select("account_id").join(n, "account_id", "left").select(
        "account_id", F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"))


def recent_topups_window(topups: DataFrame, as_of: datetime, minutes: int = TOPUP_COOLDOWN_MINUTES) -> DataFrame:
    """Top-ups strictly inside the cooldown window (exactly ``minutes`` old is outside)."""
    return topups.filter(F.col("created_at") > _ts(as_of - timedelta(minutes=minutes)))


def cooldown_clear(accounts: DataFrame, topups: DataFrame, as_of: datetime) -> DataFrame:
    """Accounts with no top-up of any status in the cooldown window."""
    recent = recent_topups_window(topups, as_of).select("account_id")
    return accounts.join(recent, "account_id", "left_anti")


def pending_topups(topups: DataFrame, invoices: DataFrame, as_of: datetime) -> DataFrame:
    """Non-failed top-ups in the cooldown window with no paid synced invoice yet.
    A NULL invoice id matches nothing, so such a row stays pending."""
    recent = recent_topups_window(topups, as_of).filter(F.col("status") != "failed")
    paid = invoices.filter(F.col("status") == "paid").select(F.col("id").alias("invoice_id"))
    return recent.join(paid, "invoice_id", "left_anti")


def pending_clear(accounts: DataFrame, topups: DataFrame, invoices: DataFrame, as_of: datetime) -> DataFrame:
    """Accounts with no pending top-up (nested NOT EXISTS as two anti joins)."""
    return accounts.join(pending_topups(topups, invoices, as_of).select("account_id"), "account_id", "left_anti")


def _candidates(accounts: DataFrame, balances: DataFrame, charges: DataFrame, topups: DataFrame, free_mode: bool) -> DataFrame:
    a = accounts.filter(F.col("stripe_customer_id").isNotNull())
    j = a.join(balances.select("account_id", "purchased_micros", "balance_micros"), "account_id", "inner")
    j = j.filter(F.col("balance_micros") < F.col("auto_topup_threshold_micros"))
    j = j.join(latest_card(accounts, charges), "account_id", "left")
    if not free_mode:
        j = j.filter(F.col("payment_method").isNotNull())
    j = j.join(topup_attempts(accounts, topups), "account_id", "left")
    return j


def _shape(j: DataFrame) -> DataFrame:
    return j.select(
        "account_id", F.col("stripe_customer_id").alias("customer"), "payment_method",
        F.col("auto_topup_amount_cents").alias("amount_cents"), "purchased_micros", F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"),
    )


def topup_scheduled(accounts: DataFrame, balances: DataFrame, charges: DataFrame, topups: DataFrame, as_of: datetime,
                    free_mode: bool) -> DataFrame:
    """U-T1: accounts with auto top-up on, under threshold, a card unless free, and no
    top-up in the cooldown window."""
    j = _candidates(accounts.filter(F.col("auto_topup_enabled")), balances, charges, topups, free_mode)
    j = j.join(recent_topups_window(topups, as_of).select("account_id"), "account_id", "left_anti")
    return _shape(j)


def topup_manual(accounts: DataFrame, balances: DataFrame, charges: DataFrame, topups: DataFrame, invoices: DataFrame,
                 as_of: datetime, free_mode: bool) -> DataFrame:
    """U-T2: "top up now" for every account: ignores the switch and the cooldown, but not a
    pending top-up that has not synced back yet."""
    j = _candidates(accounts, balances, charges, topups, free_mode)
    j = j.join(pending_topups(topups, invoices, as_of).select("account_id"), "account_id", "left_anti")
    return _shape(j)


def topup_keys(scheduled: DataFrame, manual: DataFrame, as_of: datetime) -> DataFrame:
    """U-T3: idempotency keys. Scheduled: one per account per cooldown window; manual: the
    same while purchased and attempts are unchanged. Deduplicated by key."""
    slot = F.lit(cooldown_slot(as_of))
    s = scheduled.select("account_id", F.lit("schedule").alias("trigger"),
                         F.concat_ws(":", F.lit("topup"), F.col("account_id").cast("string"), slot.cast("string")).alias("idempotency_key"))
    m = manual.select("account_id", F.lit("manual").alias("trigger"),
                      F.concat_ws(":", F.lit("topup"), F.col("account_id").cast("string"), F.lit("manual"),
                                  F.col("purchased_micros").cast("string"), F.col("attempts").cast("string")).alias("idempotency_key"))
    return s.unionByName(m).dropDuplicates(["idempotency_key"])


def topup_commands(candidates: DataFrame, promotion_codes: DataFrame, promotion_code: str, app_tag: str, free_mode: bool,
                   trigger: str, as_of: datetime) -> DataFrame:
    """U-T4: candidates to invoice commands for the payment service.

    Free mode: promotion id, no card; paid mode: card, no promotion. In free mode with no
    active promotion synced, the command is a failure row instead (nothing to send).
    """
    promo = (promotion_codes.filter((F.col("code") == promotion_code) & F.col("active"))
             .groupBy("code").agg(F.max_by("id", F.struct("created", "id")).alias("promotion_id"))
             .select(F.col("promotion_id")))
    c = candidates.withColumn("promotion_id", promo.scalar())  # one row at most: grouped by the one code
    slot = F.lit(cooldown_slot(as_of))
    key = (F.concat_ws(":", F.lit("topup"), F.col("account_id").cast("string"), slot.cast("string")) if trigger == "schedule" else
           F.concat_ws(":", F.lit("topup"), F.col("account_id").cast("string"), F.lit("manual"),
                       F.col("purchased_micros").cast("string"), F.col("attempts").cast("string")))
    meta = F.to_json(F.struct(F.lit(app_tag).alias("app"), F.col("account_id").cast("string").alias("account_id"),
                              F.lit("auto_topup").alias("kind"), F.lit(trigger).alias("trigger"),
                              F.col("amount_cents").cast("string").alias("credits_cents")))
    failed = F.lit(free_mode) & F.col("promotion_id").isNull()
    return c.select(
        "account_id", "customer", "amount_cents",
        (F.col("promotion_id") if free_mode else F.lit(None).cast("string")).alias("promotion_id"),
        (F.lit(None).cast("string") if free_mode else F.col("payment_method")).alias("payment_method"),
        key.alias("idempotency_key"),
        meta.alias("metadata"),
        F.lit(trigger).alias("trigger"),
        F.when(failed, "failed").otherwise("send").alias("action"),
        F.when(failed, F.lit(f"Promotion code {promotion_code} isn't synced yet.")).alias("error"),
    )


def topup_outcomes(commands: DataFrame, replies: DataFrame) -> DataFrame:
    """U-T5: fold the payment service's replies into top-up rows.

    ``replies``: (idempotency_key, invoice_id, invoice_status, error). A success row gets
    status ``open`` when the reply has none; a failure row keeps the message; a scheduled
    failure also switches auto top-up off (``disable_auto_topup``), a manual one does not.
    Commands that failed before sending are failures too. A sent command without a reply
    is still in flight: ``pending``, no error, auto top-up stays on.
    """
    j = commands.join(replies.withColumn("replied", F.lit(True)), "idempotency_key", "left")
    waits = (F.col("action") == "send") & F.col("replied").isNull()
    err = F.coalesce(F.col("error"), F.col("reply_error"))
    ok = (F.col("action") == "send") & F.col("invoice_id").isNotNull()
    return j.select(
        "account_id",
        F.when(ok, F.col("invoice_id")).alias("invoice_id"),
        "amount_cents",
        F.when(waits, "pending").when(ok, F.coalesce(F.col("invoice_status"), F.lit("open"))).otherwise(F.lit("failed")).alias("status"),
        F.when(waits | ok, F.lit(None).cast("string")).otherwise(F.coalesce(err, F.lit("Auto top-up failed."))).alias("error"),
        (~waits & ~ok & (F.col("trigger") == "schedule")).alias("disable_auto_topup"),
    )


def topup_available(accounts: DataFrame, balances: DataFrame, charges: DataFrame) -> DataFrame:
    """U-T6: can auto top-up be offered? Free mode: a customer and purchased > 0.
    Paid mode: a card-on-file charge (J4) exists, even when its digits are missing."""
    card = card_on_file(accounts, charges).select("account_id", "charge_id")
    j = accounts.select("account_id", "stripe_customer_id").join(balances.select("account_id", "purchased_micros"), "account_id", "left")
    j = j.join(card, "account_id", "left")
    return j.select(
        "account_id",
        (F.col("stripe_customer_id").isNotNull() & (F.coalesce("purchased_micros", F.lit(0)) > 0)).alias("available_free"),
        F.col("charge_id").isNotNull().alias("available_paid"),
    )


def debit_capped(balances: DataFrame, requested: Column) -> DataFrame:
    """U-D1: simulated debit = least(requested, balance), only when positive: never below zero."""
    amount = F.least(requested, F.col("balance_micros"))
    return balances.select("account_id", amount.cast("long").alias("amount_micros")).filter(F.col("amount_micros") > 0)


def debit_amount(balances: DataFrame, cents: int) -> DataFrame:
    """U-D1 with a fixed amount in cents."""
    return debit_capped(balances, F.lit(cents * MICROS_PER_CENT).cast("long"))


def debit_below_threshold(accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """U-D2: land one cent under the account's threshold (then capped as U-D1)."""
    j = balances.join(accounts.select("account_id", "auto_topup_threshold_micros"), "account_id", "inner")
    requested = F.col("balance_micros") - F.col("auto_topup_threshold_micros") + F.lit(MICROS_PER_CENT)
    return debit_capped(j, requested)
