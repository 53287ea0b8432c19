"""usagekit: product-usage analytics over an event log, as Spark DataFrame functions."""

from usagekit.session import build_session, ensure_utc

__all__ = ["build_session", "ensure_utc"]
