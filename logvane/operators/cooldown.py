"""At most one alert per key and cooldown, measured from the last one sent.

Which alert is sent depends on all before it, so a key is a chain. A week of a key is reduced
to a small table: for each second it may be entered at, the last second it sends. Those
tables compose in one short pass per key, and then every week is replayed on its own. No
task sees more than one key's week of distinct seconds, or one key's list of weeks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvane.operators.prefix import join_same

STRETCH = 7 * 86_400


def _following(seconds: np.ndarray, wait: int) -> np.ndarray:
    """Position of the next second that may be sent after each one."""
    return np.searchsorted(seconds, seconds + wait, side="left")


def cooldown(
    alerts: DataFrame,
    keys: list[str],
    ts: str = "created_at",
    row_id: str = "id",
    wait_sec: int = 300,
) -> DataFrame:
    """The alerts that are sent; without a wait, all of them. Alerts without a key are one key."""
    if wait_sec <= 0:
        return alerts
    key_fields = [alerts.schema[k] for k in keys]
    numbered = alerts.withColumn("_sec", F.unix_seconds(F.col(ts).cast("timestamp")))
    seconds = numbered.groupBy(*keys, "_sec").agg(F.min(row_id).alias("_first"))
    daily = seconds.select(*keys, "_sec", F.floor(F.col("_sec") / STRETCH).alias("_day"))

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_sec"].to_numpy())
        start = int(pdf["_day"].iloc[0]) * STRETCH
        entries = min(int(np.searchsorted(at, start + wait_sec)) + 1, len(at))
        onward = _following(at, wait_sec)
        here = np.arange(entries)
        while True:
            ahead = np.where(onward[here] < len(at), onward[here], here)
            if (ahead == here).all():
                break
            here = ahead
        row = pdf.iloc[:1][[*keys, "_day"]].copy()
        row["entries"] = [at[:entries].tolist()]
        row["last_sent"] = [at[here].tolist()]
        return row

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pdf.sort_values("_day")
        allowed, open_from = [], -1
        for entries, last in zip(days["entries"], days["last_sent"], strict=True):
            allowed.append(open_from)
            at = int(np.searchsorted(entries, open_from, side="left"))
            if at < len(entries):
                open_from = int(last[at]) + wait_sec
        return days[[*keys, "_day"]].assign(_open_from=allowed)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_sec"].to_numpy())
        onward = _following(at, wait_sec)
        here, sent = int(np.searchsorted(at, pdf["_open_from"].iloc[0])), []
        while here < len(at):
            sent.append(at[here])
            here = int(onward[here])
        result = pd.concat([pdf.iloc[:1][keys]] * len(sent)) if sent else pdf.iloc[:0][keys]
        return result.assign(_sec=np.array(sent, dtype=np.int64))

    day = [*key_fields, T.StructField("_day", T.LongType())]
    table = T.ArrayType(T.LongType())
    summaries = daily.groupBy(*keys, "_day").applyInPandas(
        summarize,
        T.StructType([*day, T.StructField("entries", table), T.StructField("last_sent", table)]),
    )
    opened = summaries.groupBy(*keys).applyInPandas(
        compose, T.StructType([*day, T.StructField("_open_from", T.LongType())])
    )
    sent = (
        join_same(daily, opened, [*keys, "_day"])
        .groupBy(*keys, "_day")
        .applyInPandas(replay, T.StructType([*key_fields, T.StructField("_sec", T.LongType())]))
    )
    firsts = join_same(seconds, sent, [*keys, "_sec"]).select(*keys, "_sec", F.col("_first").alias(row_id))
    return join_same(numbered, firsts, [*keys, "_sec", row_id], "left_semi").drop("_sec")
