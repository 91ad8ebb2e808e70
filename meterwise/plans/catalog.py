"""Loads every query module so ``REGISTRY`` is complete."""

from meterwise.plans import q_dashboard, q_lifecycle, q_moderation, q_purchases, q_streaming, q_topups, q_usage, q_wallet  # noqa: F401
from meterwise.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
