"""Tables out: partitioned appends, JSON fields, retention, and scrubbing of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV6 = (
    r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
    r"|\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    r"|(?<![0-9A-Za-z:])::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*(?![0-9A-Za-z:])"
)
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
RETENTION_DAYS = 90


def append(df: DataFrame, path: str, ts: str | None = None) -> None:
    """Append to a zstd Parquet table with one folder per day of `ts`, ordered by address.

    The day is that of `created_at`, by which history is asked, or of `log_timestamp` where rows have
    no such column. Rows are dealt to tasks by day first, so a day gets few files. Repeated batches,
    updates and compaction are the business of `store.Store`.
    """
    day = ts or ("created_at" if "created_at" in df.columns else "log_timestamp")
    dated = df.withColumn("event_date", F.to_date(day)).hint("rebalance", "event_date")
    if "source_ip" in df.columns:
        dated = dated.sortWithinPartitions("event_date", "source_ip")
    dated.write.mode("append").option("compression", "zstd").partitionBy("event_date").parquet(path)


def append_logs(scored: DataFrame, path: str, ts: str | None = None) -> None:
    append(scored, path, ts)


def append_anomalies(scored: DataFrame, path: str, ts: str | None = None) -> None:
    append(scored.filter("is_anomaly"), path, ts)


def within_retention(
    df: DataFrame, as_of: Column, days: int = RETENTION_DAYS, ts: str = "event_date"
) -> DataFrame:
    """Rows young enough to keep; on `event_date` this prunes whole folders."""
    return df.filter(F.to_date(ts) >= F.date_sub(F.to_date(as_of), days))


def mask(text: Column) -> Column:
    """Free text with e-mail addresses and IP addresses of both kinds blanked out."""
    without_mail = F.regexp_replace(text, EMAIL, "<email>")
    return F.regexp_replace(F.regexp_replace(without_mail, IPV6, "<ip>"), IP, "<ip>")


def pseudonym(value: Column, salt: str) -> Column:
    """The same value always gets the same name, which does not tell the value."""
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def scrub(df: DataFrame, salt: str, names: tuple[str, ...] = ("source_ip", "username")) -> DataFrame:
    """Pseudonyms in the named columns, and masks in the free text.

    Where a row's own named values stand in its free text, they are replaced by their pseudonyms.
    """
    named = [n for n in names if n in df.columns]
    columns = {n: pseudonym(F.col(n), salt) for n in named}
    for c in ("raw_log", "log_line", "message", "payload"):
        if c in df.columns:
            text = F.col(c)
            for n in named:
                value = F.col(n).cast("string")
                said = F.coalesce(value, F.lit("")) != ""
                text = F.when(said, F.replace(text, value, F.substring(columns[n], 1, 16))).otherwise(text)
            columns[c] = mask(text)
    return df.withColumns(columns)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
