"""Transaction queries with optional parameters: only what is given becomes a predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS_MS = 86_400_000


@dataclass(frozen=True)
class TransactionQuery:
    start_ms: int | None = None
    end_ms: int | None = None
    category_id: str | None = None
    direction: str | None = None
    payment_method: str | None = None
    merchant_key: str | None = None
    search: str | None = None
    limit: int | None = None

    def filter(self, tx: DataFrame) -> DataFrame:
        for column, value in (("category_id", self.category_id), ("direction", self.direction),
                              ("payment_method", self.payment_method), ("merchant_key", self.merchant_key)):
            if value is not None:
                tx = tx.where(F.col(column) == value)
        if self.start_ms is not None:
            tx = tx.where(F.col("ts_ms") >= self.start_ms)
        if self.end_ms is not None:
            tx = tx.where(F.col("ts_ms") <= self.end_ms)
        if self.search:
            # % and _ stay wildcards, a backslash is itself
            needle = "%" + self.search.replace("\\", "\\\\") + "%"
            tx = tx.where(F.col("merchant_display").ilike(needle) | F.col("merchant_key").ilike(needle))
        return tx

    def run(self, tx: DataFrame) -> DataFrame:
        """Newest first, ties by id."""
        found = self.filter(tx)
        return found if self.limit is None else found.orderBy(F.desc("ts_ms"), "tx_id").limit(self.limit)


def preset(days: int, now_ms: int) -> tuple[int, int]:
    """The period of the last days, not before 0."""
    return max(0, now_ms - days * DAYS_MS), now_ms
