"""How many rows of the same key lie before, or around, a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logvane.operators.prefix import join_same, running_totals
from logvane.plans.history import within


def _seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def similar_before(
    df: DataFrame,
    keys: list[str],
    ts: str = "created_at",
    row_id: str = "id",
    name: str = "similar_anomalies",
) -> DataFrame:
    """Count of earlier rows with the same keys, ordered by (ts, id).

    Counted within minutes, then over minutes: no window holds more than a key's one minute.
    """
    cut = df.withColumns({"_minute": F.floor(_seconds(ts) / 60), "_one": F.lit(1)})
    return running_totals(cut, keys, "_minute", [ts, row_id], {name: "_one"}).drop("_minute", "_one")


def around(
    points: DataFrame, logs: DataFrame, keys: list[str], within_sec: int, ts: str, name: str
) -> DataFrame:
    """Add the number of logs with the same keys at most `within_sec` seconds away.

    Logs are counted per key and second; both sides meet in stretches of time that overlap
    by the distance, so a hot key is spread over its stretches and no pairs are made. A null
    in the key matches nothing; such a point stays, with 0.
    """
    width = max(4 * within_sec, 3600)
    second = _seconds(ts)
    counts = logs.dropna(subset=keys).groupBy(*keys, second.alias("_sec")).agg(F.count("*").alias("_n"))
    asked = (
        points.dropna(subset=keys)
        .select(*keys, second.alias("_sec"))
        .distinct()
        .withColumn("_n", F.lit(0))
    )
    home = F.floor(F.col("_sec") / width)
    low, high = [F.floor((F.col("_sec") + d) / width) for d in (-within_sec, within_sec)]
    spread = counts.withColumn("_part", F.explode(F.array_distinct(F.array(low, home, high))))
    own = asked.withColumn("_part", home)
    merged = (
        spread.unionByName(own)
        .groupBy(*keys, "_part", "_sec")
        .agg(F.sum("_n").alias("_n"), F.max(F.col("_n") == 0).alias("_asked"))
    )
    near = (
        W.partitionBy(*keys, "_part").orderBy("_sec").rangeBetween(-within_sec, within_sec)
    )
    answered = (
        merged.withColumn(name, F.sum("_n").over(near))
        .filter(F.col("_asked") & (F.col("_part") == home))
        .select(*keys, "_sec", name)
    )
    found = points.withColumn("_sec", second).join(answered, [*keys, "_sec"], "left").drop("_sec")
    return found.withColumn(name, F.coalesce(name, F.lit(0)))


def _by_kind(df: DataFrame, *kept: str) -> DataFrame:
    """`kept` once per key a row can be found by: its address, its user, and both; an empty one is none."""
    ip, user = (F.when(F.col(c) != "", F.col(c)) for c in ("source_ip", "username"))
    no = F.lit("")
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("_kind"), a.alias("_a"), b.alias("_b"), F.lit(sign).alias("_sign"))
            for kind, a, b, sign in (("ip", ip, no, 1), ("user", no, user, 1), ("both", ip, user, -1))
        ]
    )
    known = F.filter(kinds, lambda k: k["_a"].isNotNull() & k["_b"].isNotNull())
    return df.select(*kept, F.inline(known))


def related_logs(
    anomalies: DataFrame, logs: DataFrame, within_sec: int = 300, ts: str = "created_at"
) -> DataFrame:
    """Per anomaly, how many logs share its address or its user within the distance.

    Logs that share both count once: all three counts come from one pass over the logs.
    """
    counted = around(
        _by_kind(anomalies, "id", ts), _by_kind(logs, ts), ["_kind", "_a", "_b"], within_sec, ts, "_near"
    )
    totals = counted.groupBy("id").agg(F.sum(F.col("_sign") * F.col("_near")).alias("related_logs"))
    found = anomalies.join(totals, "id", "left")
    return found.withColumn("related_logs", F.coalesce("related_logs", F.lit(0).cast("long")))


def related_logs_of(
    anomaly: DataFrame, logs: DataFrame, within_sec: int = 300, ts: str = "created_at"
) -> DataFrame:
    """The logs related to a few given anomalies (a detail view), each once per anomaly."""
    asked = anomaly.select(
        F.col("id").alias("anomaly_id"),
        F.col(ts).alias("_at"),
        F.col("source_ip").alias("_ip"),
        F.when(F.col("username") != "", F.col("username")).alias("_user"),
    )
    close = F.abs(_seconds(ts) - _seconds("_at")) <= within_sec
    # the days and times around all asked ones, as scalars: logs laid out by day read only those
    reach = F.expr(f"INTERVAL {int(within_sec) + 1} SECONDS")
    first = asked.agg(F.min("_at") - reach).scalar()
    last = asked.agg(F.max("_at") + reach).scalar()
    logs = within(logs, first, last, ts)
    by_ip = logs.join(asked, logs["source_ip"] == asked["_ip"]).filter(close)
    by_user = logs.join(asked, logs["username"] == asked["_user"]).filter(close)
    return (
        by_ip.union(by_user)
        .drop("_at", "_ip", "_user")
        .dropDuplicates(["anomaly_id", "id"])
    )


def user_baseline(
    df: DataFrame, key: str, value: str, ts: str = "created_at", days: int = 7
) -> DataFrame:
    """Add the deviation of each value from its key's previous days, in standard deviations.

    The baseline is built from one row per key and day; null without a spread to compare to.
    Rows without a key are one group. Days are combined as deviations from the key's own mean,
    so a small spread around a large value keeps its digits.
    """
    day = F.floor(_seconds(ts) / 86400)
    x = F.col(value)
    daily = df.groupBy(key, day.alias("_day")).agg(
        F.count(x).alias("_n"), F.avg(x).alias("_mean"), F.var_pop(x).alias("_var")
    )
    whole = W.partitionBy(key)
    centre = F.sum(F.col("_mean") * F.col("_n")).over(whole) / F.sum("_n").over(whole)
    shift = F.col("_mean") - F.col("_centre")
    moved = daily.withColumn("_centre", centre).withColumns(
        {"_s": F.col("_n") * shift, "_q": F.col("_n") * (F.col("_var") + shift * shift)}
    )
    before = W.partitionBy(key).orderBy("_day").rangeBetween(-days, -1)
    n, s, q = [F.sum(c).over(before) for c in ("_n", "_s", "_q")]
    base = moved.select(
        key,
        "_day",
        n.alias("baseline_n"),
        (s / n + F.col("_centre")).alias("baseline_mean"),
        F.sqrt(F.greatest(q / n - F.pow(s / n, 2), F.lit(0.0))).alias("baseline_std"),
    )
    return (
        join_same(df.withColumn("_day", day), base, [key, "_day"])
        .drop("_day")
        .withColumn(
            "deviation",
            F.when(
                F.col("baseline_std") > 0, (x - F.col("baseline_mean")) / F.col("baseline_std")
            ),
        )
    )
