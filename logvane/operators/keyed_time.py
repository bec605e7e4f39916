"""Per-address state before each event: rates, idle time, sessions, endpoints seen.

The state counts distinct seconds, is read before the event is added, and is ordered by
(second, line id). Events are first reduced to one row per address and second. Those rows
are cut into hours with an overlap as wide as the longest frame, so no window holds more
than 3 900 rows however busy an address is; what crosses hours is carried by one row per
address and hour. The events themselves are shuffled once, by (address, second).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logvane.operators.prefix import running_totals

BUCKET_SEC = 3600
MINUTE_WINDOW = 60
FAILURE_WINDOW = 300
SESSION_GAP = 1800
ENDPOINT_TTL = 3600

# --- fixed values: which event names feed the login state ---
AUTH_RULES = {
    "strict": ("auth", "login"),
    "extended": ("auth", "login", "password_failed"),
}


def is_auth(event_type: Column, rule: str = "strict") -> Column:
    """Whether an event counts as a login attempt."""
    lowered = F.lower(event_type)
    found = F.lit(False)
    for word in AUTH_RULES[rule]:
        found = found | lowered.contains(word)
    return F.coalesce(found, F.lit(False))


def _per_second(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First line id per (address, second, endpoint), and per (address, second)."""
    by_endpoint = events.groupBy("_key", "_sec", "_endpoint").agg(
        F.min("_id").alias("first_id"),
        F.min(F.when(F.col("_auth"), F.col("_id"))).alias("auth_id"),
        F.min(F.when(F.col("_failed"), F.col("_id"))).alias("fail_id"),
    )
    seconds = by_endpoint.groupBy("_key", "_sec").agg(
        F.min("first_id").alias("first_id"),
        F.min("auth_id").alias("auth_id"),
        F.min("fail_id").alias("fail_id"),
    )
    return by_endpoint, seconds


def _frames(seconds: DataFrame) -> DataFrame:
    """Distinct seconds in the trailing frames, from hours that overlap by the widest frame."""
    hour = F.floor(F.col("_sec") / BUCKET_SEC)
    reaches_next = F.col("_sec") % BUCKET_SEC >= BUCKET_SEC - FAILURE_WINDOW
    placed = seconds.withColumn(
        "_hour", F.explode(F.when(reaches_next, F.array(hour, hour + 1)).otherwise(F.array(hour)))
    )
    own = F.col("_hour") == hour
    in_order = W.partitionBy("_key", "_hour").orderBy("_sec")
    minute = in_order.rangeBetween(-MINUTE_WINDOW, -1)
    five = in_order.rangeBetween(-FAILURE_WINDOW, -1)
    return (
        placed.withColumns(
            {
                "requests": F.count("first_id").over(minute),
                "logins": F.count("auth_id").over(minute),
                "logins_5m": F.count("auth_id").over(five),
                "failures_5m": F.count("fail_id").over(five),
                "_before": F.lag(F.when(own, F.col("_sec"))).over(in_order),
            }
        )
        .filter(own)
    )


def sessionize(seconds: DataFrame, gaps: dict[str, int]) -> DataFrame:
    """Add `prev_sec` and, per named gap, the second its session started.

    Wants `_key, _sec, _hour` and `_before` (the previous second within the hour).
    """
    starts = {
        name: F.when(F.col("_sec") - F.col("_before") >= gap, F.col("_sec"))
        for name, gap in gaps.items()
    }
    hours = seconds.groupBy("_key", "_hour").agg(
        F.min("_sec").alias("_first"),
        F.max("_sec").alias("_last"),
        *[F.max(start).alias(f"_late_{name}") for name, start in starts.items()],
    )
    by_hour = W.partitionBy("_key").orderBy("_hour")
    hours = hours.withColumn("_prev_last", F.lag("_last").over(by_hour))
    for name, gap in gaps.items():
        fresh = F.col("_prev_last").isNull() | (F.col("_first") - F.col("_prev_last") >= gap)
        opening = F.when(fresh, F.col("_first"))
        newest = F.coalesce(F.col(f"_late_{name}"), opening)
        carried = F.last(newest, ignorenulls=True).over(by_hour.rowsBetween(W.unboundedPreceding, -1))
        hours = hours.withColumn(f"_open_{name}", F.coalesce(opening, carried))
    opened = [f"_open_{name}" for name in gaps]
    joined = seconds.join(hours.select("_key", "_hour", "_prev_last", *opened), ["_key", "_hour"])
    so_far = (
        W.partitionBy("_key", "_hour").orderBy("_sec").rowsBetween(W.unboundedPreceding, 0)
    )
    return joined.withColumns(
        {
            "prev_sec": F.coalesce("_before", "_prev_last"),
            **{
                name: F.coalesce(F.max(start).over(so_far), F.col(f"_open_{name}"))
                for name, start in starts.items()
            },
        }
    ).drop("_before", "_prev_last", *opened)


def _endpoints(by_endpoint: DataFrame, seconds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seconds with the endpoints seen before them, and the first sighting of each endpoint."""
    sessions = seconds.select("_key", "_sec", "_hour", "endpoint_session")
    sighted = (
        by_endpoint.join(sessions, ["_key", "_sec"])
        .groupBy("_key", "endpoint_session", "_endpoint")
        .agg(F.min(F.struct("_sec", "first_id", "_hour")).alias("_s"))
        .select("_key", "endpoint_session", "_s.*")
    )
    new = sighted.groupBy("_key", "_sec").agg(F.count("*").alias("_new"))
    counted = seconds.join(new, ["_key", "_sec"], "left").withColumn(
        "_new", F.coalesce("_new", F.lit(0))
    )
    totals = running_totals(
        counted, ["_key", "endpoint_session"], "_hour", ["_sec"], {"endpoints": "_new"}
    )
    return totals, sighted.select("_key", "_sec", F.col("first_id").alias("_id"))


def keyed_features(
    events: DataFrame,
    key: str = "source_ip",
    ts: str = "timestamp",
    line_id: str = "line_id",
    auth_rule: str = "strict",
    activity_ttl_sec: int | None = None,
) -> DataFrame:
    """Add the six per-address features to events that have `event_type, success, endpoint`.

    `activity_ttl_sec` forgets an address after that long (3600: the cache's own expiry);
    None keeps it, so long absences show.
    """
    auth = is_auth(F.col("event_type"), auth_rule)
    prepared = events.withColumns(
        {
            "_key": F.coalesce(F.col(key), F.lit("unknown")),
            "_sec": F.unix_seconds(F.col(ts).cast("timestamp")),
            "_id": F.col(line_id),
        }
    )
    slim = prepared.select(
        "_key",
        "_sec",
        "_id",
        F.coalesce("endpoint", F.lit("")).alias("_endpoint"),
        auth.alias("_auth"),
        (auth & ~F.coalesce("success", F.lit(False))).alias("_failed"),
    )
    by_endpoint, seconds = _per_second(slim)
    gaps = {"session": SESSION_GAP, "endpoint_session": ENDPOINT_TTL}
    timed = sessionize(_frames(seconds), gaps)
    state, sightings = _endpoints(by_endpoint, timed)
    state = state.drop("_hour", "_new", "endpoint_session")

    # first sightings line up with the events of their second; what they add counts from the
    # next event on
    marked = prepared.withColumn("_mark", F.lit(0)).unionByName(
        sightings.withColumn("_mark", F.lit(1)), allowMissingColumns=True
    )
    within = (
        W.partitionBy("_key", "_sec").orderBy("_id", "_mark").rowsBetween(W.unboundedPreceding, 0)
    )
    placed = marked.withColumn("_seen", F.sum("_mark").over(within)).filter("_mark = 0")
    joined = placed.join(state, ["_key", "_sec"])

    def earlier(first: str) -> Column:
        return F.coalesce(F.col(first) < F.col("_id"), F.lit(False)).cast("int")

    repeat = earlier("first_id") == 1
    idle = F.col("_sec") - F.col("prev_sec")
    if activity_ttl_sec is not None:
        idle = F.when(idle < activity_ttl_sec, idle)
    attempts = F.col("logins_5m") + earlier("auth_id")
    failures = F.col("failures_5m") + earlier("fail_id")
    return joined.withColumns(
        {
            "login_attempts_per_minute": (F.col("logins") + earlier("auth_id")).cast("double")
            / (MINUTE_WINDOW / 60),
            "requests_per_second": (F.col("requests") + earlier("first_id")) / MINUTE_WINDOW,
            "failed_auth_rate": F.coalesce(F.try_divide(failures, attempts), F.lit(0.0)),
            "unique_endpoints_accessed": F.col("endpoints") + F.col("_seen"),
            "time_since_last_activity_sec": F.when(repeat, 0.0).otherwise(
                F.coalesce(idle.cast("double"), F.lit(0.0))
            ),
            "session_duration_sec": (F.col("_sec") - F.col("session")).cast("double"),
        }
    ).select(*events.columns, *KEYED_FEATURES)


KEYED_FEATURES = (
    "login_attempts_per_minute",
    "requests_per_second",
    "failed_auth_rate",
    "unique_endpoints_accessed",
    "time_since_last_activity_sec",
    "session_duration_sec",
)


def session_summary(
    events: DataFrame,
    keys: list[str],
    ts: str,
    gap_sec: int,
    aggregates: dict[str, Column],
    merges: dict[str, str],
) -> DataFrame:
    """One row per session of the keys: bounds, event count, and further aggregates.

    `aggregates` reduce the events of one second, `merges` names how those reduce further
    (`sum`, `max`, `min`, `collect_set`). Same hours-and-carry scheme as above.
    """
    keyed = events.withColumns(
        {
            "_key": F.struct(*keys),
            "_sec": F.unix_seconds(F.col(ts).cast("timestamp")),
        }
    )
    seconds = keyed.groupBy("_key", "_sec").agg(
        F.count("*").alias("events"), *[a.alias(n) for n, a in aggregates.items()]
    )
    hourly = seconds.withColumn("_hour", F.floor(F.col("_sec") / BUCKET_SEC)).withColumn(
        "_before", F.lag("_sec").over(W.partitionBy("_key", "_hour").orderBy("_sec"))
    )
    merged = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
    }
    return (
        sessionize(hourly, {"session": gap_sec})
        .groupBy("_key", "session")
        .agg(
            F.max("_sec").alias("_end"),
            F.sum("events").alias("events"),
            *[merged[merges[n]](n).alias(n) for n in aggregates],
        )
        .select(
            "_key.*",
            F.timestamp_seconds("session").alias("session_start"),
            F.timestamp_seconds("_end").alias("session_end"),
            "events",
            *aggregates,
        )
    )


def unique_keys_last_hour(
    events: DataFrame, key: str = "source_ip", ts: str = "timestamp", minutes: int = 60
) -> DataFrame:
    """`minute, unique_ips_last_hour`: addresses active in the hour before each active minute.

    Every active minute of an address adds one to the following hour, up to its next active
    minute; the running sum of these steps is the answer. Linear in (address, minute) pairs.
    """
    minute = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 60)
    active = events.select(F.col(key).alias("_key"), minute.alias("_minute")).distinct()
    following = F.lead("_minute").over(W.partitionBy("_key").orderBy("_minute"))
    spans = active.withColumn(
        "_until", F.least(F.col("_minute") + minutes, F.coalesce(following, F.lit(2**40)))
    )
    steps = spans.select(
        F.explode(
            F.array(
                F.struct((F.col("_minute") + 1).alias("_minute"), F.lit(1).alias("_step")),
                F.struct((F.col("_until") + 1).alias("_minute"), F.lit(-1).alias("_step")),
                F.struct(F.col("_minute").alias("_minute"), F.lit(0).alias("_step")),
            )
        ).alias("_s"),
    ).select("_s.*")
    summed = (
        steps.groupBy("_minute")
        .agg(F.sum("_step").alias("_step"), F.max(F.col("_step") == 0).alias("_asked"))
        .withColumn("_day", F.floor(F.col("_minute") / 1440))
    )
    running = running_totals(summed, [], "_day", ["_minute"], {"_ahead": "_step"})
    return running.filter("_asked").select(
        F.timestamp_seconds(F.col("_minute") * 60).alias("minute"),
        (F.col("_ahead") + F.col("_step")).alias("unique_ips_last_hour"),
    )


def with_unique_ips(
    events: DataFrame,
    key: str = "source_ip",
    ts: str = "timestamp",
    active: DataFrame | None = None,
) -> DataFrame:
    """Attach the count of addresses in the hour before the event's minute.

    `active` are the events to count, if not `events` themselves: the stored ones, where `events`
    is a long plan that would otherwise be run twice.
    """
    per_minute = unique_keys_last_hour(events if active is None else active, key, ts).withColumnRenamed("minute", "_minute")
    return (
        events.withColumn("_minute", F.date_trunc("minute", F.col(ts).cast("timestamp")))
        .join(per_minute, "_minute")
        .drop("_minute")
    )
