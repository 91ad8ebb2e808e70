"""Frozen domain constants and run parameters.

Everything time-dependent takes an explicit ``as_of`` instead of ``now()``,
so a job re-run on the same inputs gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# --- Fixed values (must equal the service being rebuilt) ----------------------
# Moderation categories, in this order (order decides `flagged` and ties).
CATEGORIES = ("harassment", "hate", "sexual", "violence", "self_harm", "illicit", "spam")
# Verdict thresholds on the rounded top score.
REVIEW_THRESHOLD = 0.4
BLOCK_THRESHOLD = 0.8
# Billing unit and request bounds.
CHARS_PER_UNIT = 2000
MAX_ITEMS_PER_REQUEST = 20
MAX_CHARS_PER_ITEM = 8000
# Token budget of one scoring call: base + per item.
TOKEN_BUDGET_BASE = 1024
TOKEN_BUDGET_PER_ITEM = 192
# Money: integer micro-dollars.
MICROS_PER_USD = 1_000_000
MICROS_PER_CENT = 10_000
# Credit packs (cents) and auto top-up choices.
PACK_CENTS = (1000, 2500, 10000)
TOPUP_AMOUNTS_CENTS = (1000, 2500, 10000)
TOPUP_THRESHOLDS_CENTS = (200, 500, 1000)
TOPUP_COOLDOWN_MINUTES = 15
# Requests one account may make in any rolling 24 hours.
DAILY_REQUEST_LIMIT = 2
# The one service sold and the model behind it.
MODERATION_SERVICE = "moderate"
DEFAULT_MODEL = "gpt-oss-20b"
# Reason text kept per result.
MAX_REASON_CHARS = 300
# Retry-After when no slot time is known (seconds).
DEFAULT_RETRY_AFTER_S = 3600
# Log viewer: lines kept and time ranges (label -> minutes, None = all).
LOG_TAIL_LINES = 5000
LOG_RANGES_MINUTES = {"5m": 5, "15m": 15, "1h": 60, "24h": 1440, "all": None}
# Credit watch time-outs after a checkout / top-up request (minutes).
CHECKOUT_WATCH_MINUTES = 10
TOPUP_WATCH_MINUTES = 7
# Synced tables may land this late (session creates, intent updates).
SYNC_LAG_MINUTES = 10
# Scheduled top-up cadence (minutes).
TOPUP_SCHEDULE_MINUTES = 5

MICROS_24H = 24 * 3600 * 1_000_000


@dataclass(frozen=True)
class Params:
    """Per-run parameters (the reference reads these from the clock and env)."""

    as_of: datetime = datetime(2024, 1, 31, 0, 0, 0)
    app_tag: str = "appx"
    key_prefix: str = "key_"
    free_mode: bool = True
    promotion_code: str = "APPX100"
    service: str = MODERATION_SERVICE
    model: str = DEFAULT_MODEL
    old_tag: str = "oldx"
    categories: tuple = field(default=CATEGORIES)

    @property
    def as_of_sql(self) -> str:
        return self.as_of.strftime("%Y-%m-%d %H:%M:%S")

    @property
    def placeholder_domain(self) -> str:
        return f"users.{self.app_tag}.invalid"

    @property
    def lookup_keys(self) -> tuple:
        return tuple(f"{self.app_tag}_credits_{c // 100}" for c in PACK_CENTS)


DEFAULT = Params()
