"""Session store: the last value put under each key, while it lives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_sessions(puts: DataFrame, as_of: Column, ttl_sec: int = 3600) -> DataFrame:
    """Newest `session_data` per (source_ip, session_id) that has not expired by `as_of`.

    One partial aggregation; `id` breaks ties between puts of the same instant.
    """
    latest = F.max_by("session_data", F.struct("stored_at", "id"))
    alive = F.col("stored_at") + F.expr(f"INTERVAL {int(ttl_sec)} SECONDS") > as_of
    return (
        puts.filter(F.col("stored_at") <= as_of)
        .groupBy("source_ip", "session_id")
        .agg(F.max("stored_at").alias("stored_at"), latest.alias("session_data"))
        .filter(alive)
    )
