"""The line operators on streams. They look at one line at a time, so that the batch functions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonloom.plans import ledger


def emissions(lines: DataFrame) -> DataFrame:
    """Lines of a stream without junk, classified, with their emissions."""
    return ledger.emissions(ledger.classify(ledger.without_junk(lines)))


def kg_by_hour(results: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """kg of each scope and hour; lines later than `late` behind the newest are left out, which bounds the state."""
    return results.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "scope").agg(F.sum("emission_kg").alias("emission_kg"))
