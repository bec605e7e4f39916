"""Questions about stored logs, anomalies and alerts: pages, lookups, updates, training pull.

"Now" is always the argument `as_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(df: DataFrame, start: Column, end: Column | None = None, ts: str = "created_at") -> DataFrame:
    """Rows from `start` to `end`. A table laid out by the day of `created_at` reads only those days."""
    fits = F.col(ts) >= start if end is None else F.col(ts).between(start, end)
    if ts == "created_at" and "event_date" in df.columns:
        fits &= F.col("event_date") >= F.to_date(start)
        if end is not None:
            fits &= F.col("event_date") <= F.to_date(end)
    return df.filter(fits)


def since(df: DataFrame, as_of: Column, hours: int, ts: str = "created_at") -> DataFrame:
    return within(df, as_of - F.expr(f"INTERVAL {int(hours)} HOURS"), None, ts)


def _newest(df: DataFrame, limit: int, offset: int, ts: str) -> DataFrame:
    ordered = df.orderBy(F.desc(ts), F.desc("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def find_anomalies(
    anomalies: DataFrame,
    as_of: Column,
    hours: int = 24,
    min_risk_score: float | None = None,
    risk_level: str | None = None,
    source_ip: str | None = None,
    is_anomaly: bool | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Anomalies that fit; with a limit, the newest of them from `offset` on."""
    found = since(anomalies, as_of, hours)
    if min_risk_score is not None:
        found = found.filter(F.col("risk_score") >= min_risk_score)
    for column, value in (
        ("risk_level", risk_level),
        ("source_ip", source_ip),
        ("is_anomaly", is_anomaly),
    ):
        if value is not None:
            found = found.filter(F.col(column) == F.lit(value))
    return found if limit is None else _newest(found, limit, offset, "created_at")


def page(
    found: DataFrame, limit: int = 10, offset: int = 0, ts: str = "created_at"
) -> DataFrame:
    """One page, newest first, each row with the total, the page number and the page size."""
    total = found.agg(F.count("*")).scalar()
    return _newest(found, limit, offset, ts).withColumns(
        {
            "total": total,
            "page": F.lit(offset // limit + 1),
            "page_size": F.lit(limit),
        }
    )


def anomalies_page(
    anomalies: DataFrame,
    as_of: Column,
    limit: int = 10,
    offset: int = 0,
    hours: int = 24,
    min_risk_score: float = 0.6,
    risk_level: str | None = None,
) -> DataFrame:
    return page(find_anomalies(anomalies, as_of, hours, min_risk_score, risk_level), limit, offset)


def anomaly_detail(anomalies: DataFrame, anomaly_id: int) -> DataFrame:
    """One anomaly with its context as a struct."""
    context = [
        c
        for c in ("source_ip", "username", "hostname", "event_type", "raw_log", "log_source")
        if c in anomalies.columns
    ]
    return anomalies.filter(F.col("id") == anomaly_id).withColumn("context", F.struct(*context))


def logs_page(
    logs: DataFrame,
    as_of: Column,
    limit: int = 100,
    offset: int = 0,
    source_ip: str | None = None,
    hours: int = 24,
) -> DataFrame:
    found = since(logs, as_of, hours)
    if source_ip is not None:
        found = found.filter(F.col("source_ip") == source_ip)
    return _newest(found, limit, offset, "created_at")


def alerts_page(
    alerts: DataFrame,
    limit: int = 100,
    offset: int = 0,
    sent: bool | None = None,
    acknowledged: bool | None = None,
) -> DataFrame:
    found = alerts
    for column, value in (("sent", sent), ("acknowledged", acknowledged)):
        if value is not None:
            found = found.filter(F.col(column) == F.lit(value))
    return _newest(found, limit, offset, "created_at")


def apply_updates(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """A new version of the table: non-null values of `updates` replace the stored ones."""
    changed = [c for c in updates.columns if c != key and c in table.columns]
    added = [c for c in updates.columns if c != key and c not in table.columns]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], *added)
    joined = table.join(new, key, "left")
    kept = [
        F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns
    ]
    return joined.select(*kept, *added)


def training_pull(
    logs: DataFrame,
    as_of: Column,
    days: int = 30,
    max_risk: float = 0.6,
    min_samples: int = 1000,
    limit: int | None = None,
) -> DataFrame:
    """All normal logs of the last days, or the newest `limit`; fails when there are too few."""
    normal = since(logs, as_of, days * 24).filter(F.col("risk_score") <= max_risk)
    pulled = normal if limit is None else _newest(normal, limit, 0, "created_at")
    enough = pulled.limit(min_samples).count()
    if enough < min_samples:
        raise ValueError(f"not enough training samples: {enough}, need {min_samples}")
    return pulled
