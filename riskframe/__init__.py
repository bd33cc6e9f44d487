"""riskframe: leakage-safe risk features and risk decisions as Spark jobs."""

from riskframe.spec import CARD_PAYMENTS, TableSpec

__all__ = ["CARD_PAYMENTS", "TableSpec"]
