"""Lookups over scan states: (scan_id, status, started_at, completed_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("PENDING", "RUNNING")
RESUMABLE = ("INTERRUPTED", "PENDING", "RUNNING")


def _newest(states: DataFrame, statuses: tuple[str, ...], by: str) -> DataFrame:
    """The row of these statuses with the greatest time, ties by the greater id: a maximum with partial sums, no sort."""
    row = F.struct(*states.columns)
    return states.where(F.col("status").isin(*statuses)).agg(F.max_by(row, F.struct(by, "scan_id")).alias("x")).where("x is not null").select("x.*")


def active(states: DataFrame) -> DataFrame:
    return _newest(states, ACTIVE, "updated_at")


def resumable(states: DataFrame) -> DataFrame:
    return _newest(states, RESUMABLE, "updated_at")


def latest_completed(states: DataFrame) -> DataFrame:
    return _newest(states, ("COMPLETED",), "completed_at")


def newest_by_status(states: DataFrame) -> DataFrame:
    """(status, scan_id) of the newest scan of every status."""
    return states.groupBy("status").agg(F.max_by("scan_id", F.struct("updated_at", "scan_id")).alias("scan_id"))


def violation() -> Column:
    """What is wrong with a state that also counts processed and accepted messages; null if nothing is."""
    running = F.col("status").isin(*ACTIVE)
    return (F.when(F.coalesce((F.col("accepted") > F.col("processed")) | (F.col("accepted") < 0), F.lit(True)), "COUNTS")
            .when((F.col("status") == "COMPLETED") & F.coalesce(F.col("completed_at") < F.col("started_at"), F.lit(True)), "COMPLETED_AT")
            .when(running & F.col("completed_at").isNotNull(), "STILL_RUNNING"))
