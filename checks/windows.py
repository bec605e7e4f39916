"""State over time: the SQL joins every event with all earlier ones of its address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.parsing import now
from checks.registry import AS_OF, EXPANDED, query
from logvane.operators import keyed_time, parsing
from logvane.operators.prefix import top_per_group
from logvane.session import stage
from logvane.sources import derived

# the fields of every fixture line, straight from `events`
EV = f"""
SELECT event_id*8 + k AS line_id, ip AS source_ip, t, CAST(epoch(t) AS BIGINT) AS sec, user_id, value, event_id, event_type AS kind,
 CASE WHEN event_type IN ('error','signup') THEN 'auth' WHEN event_type IN ('click','view') THEN 'nginx' ELSE 'firewall' END AS source,
 CASE WHEN event_type = 'error' THEN 'ssh_password_failed' WHEN event_type = 'signup' THEN 'ssh_auth_success'
  WHEN event_type IN ('click','view') THEN CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 7 IN (0,1) THEN 'http_auth_failed' ELSE 'http_auth_success' END WHEN 1 THEN 'http_admin_access' WHEN 2 THEN 'http_api_request' WHEN 3 THEN 'http_path_traversal_attempt' ELSE 'http_request' END
  ELSE 'firewall_' || CASE event_id % 4 WHEN 0 THEN 'ssh' WHEN 1 THEN 'http' WHEN 2 THEN 'rdp' ELSE 'tcp' END || CASE WHEN event_id % 3 = 0 THEN '_accept' ELSE '_drop' END END AS event_type,
 CASE WHEN event_type IN ('click','view') THEN CASE event_id % 5 WHEN 0 THEN '/login' WHEN 1 THEN '/admin/panel' WHEN 2 THEN '/api/users' WHEN 3 THEN '/a/../etc/passwd' ELSE '/' END ELSE '' END AS endpoint,
 CASE WHEN event_type IN ('click','view') THEN CASE event_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 500 ELSE 200 END ELSE 0 END AS status_code,
 CASE WHEN event_type = 'error' THEN false WHEN event_type = 'signup' THEN true WHEN event_type IN ('click','view') THEN event_id % 7 NOT IN (0,1) ELSE event_id % 3 = 0 END AS success,
 CASE WHEN event_type IN ('error','signup') THEN CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'user' || CAST(user_id AS VARCHAR) END ELSE '' END AS username,
 CASE WHEN event_type IN ('click','view') THEN CAST(floor(value*100) AS BIGINT) ELSE 0 END AS bytes_sent,
 CASE WHEN event_type IN ('click','view') THEN 'Mozilla/5.0' ELSE '' END AS user_agent
FROM ({derived.EXPANDED.format(expanded=EXPANDED)}) x
"""
AUTH = {
    "strict": "(contains(event_type,'auth') OR contains(event_type,'login'))",
    "extended": "(contains(event_type,'auth') OR contains(event_type,'login') OR contains(event_type,'password_failed'))",
}


def ev(rule: str = "strict") -> str:
    return f"ev AS MATERIALIZED (SELECT *, {AUTH[rule]} AS is_auth FROM ({EV}))"


def pairs(seconds: int) -> str:
    return (
        "FROM ev e LEFT JOIN ev p ON p.source_ip = e.source_ip AND p.sec <= e.sec AND"
        f" p.sec >= e.sec - {seconds} AND (p.sec < e.sec OR p.line_id < e.line_id)"
    )


def frame_sql(rule: str) -> str:
    return f"""WITH {ev(rule)} SELECT e.line_id,
 CAST(count(DISTINCT CASE WHEN p.is_auth AND p.sec >= e.sec - 60 THEN p.sec END) AS DOUBLE) AS login_attempts_per_minute,
 coalesce(round(count(DISTINCT CASE WHEN p.is_auth AND NOT p.success THEN p.sec END) / nullif(count(DISTINCT CASE WHEN p.is_auth THEN p.sec END), 0), 9), 0) AS failed_auth_rate
 {pairs(300)} GROUP BY e.line_id"""


def state_sql(rule: str) -> str:
    """All six features of an address, each event against all earlier ones of the address."""
    return f"""WITH {ev(rule)}, g AS (SELECT *, sec - lag(sec) OVER w AS idle FROM ev WINDOW w AS (PARTITION BY source_ip ORDER BY sec, line_id)),
 s AS (SELECT *, sum(CASE WHEN idle >= 1800 THEN 1 ELSE 0 END) OVER w AS half, sum(CASE WHEN idle >= 3600 THEN 1 ELSE 0 END) OVER w AS whole FROM g WINDOW w AS (PARTITION BY source_ip ORDER BY sec, line_id)),
 o AS (SELECT line_id, CAST(coalesce(idle, 0) AS DOUBLE) AS time_since_last_activity_sec, CAST(sec - min(sec) OVER (PARTITION BY source_ip, half) AS DOUBLE) AS session_duration_sec FROM s),
 e AS (SELECT e.line_id, count(DISTINCT p.endpoint) AS unique_endpoints_accessed FROM s e LEFT JOIN s p ON p.source_ip = e.source_ip AND p.whole = e.whole AND (p.sec < e.sec OR (p.sec = e.sec AND p.line_id < e.line_id)) GROUP BY e.line_id),
 r AS (SELECT e.line_id, count(DISTINCT CASE WHEN p.is_auth AND p.sec >= e.sec - 60 THEN p.sec END)::DOUBLE AS login_attempts_per_minute, round(count(DISTINCT CASE WHEN p.sec >= e.sec - 60 THEN p.sec END) / 60.0::DOUBLE, 9) AS requests_per_second,
  coalesce(round(count(DISTINCT CASE WHEN p.is_auth AND NOT p.success THEN p.sec END) / nullif(count(DISTINCT CASE WHEN p.is_auth THEN p.sec END), 0), 9), 0) AS failed_auth_rate {pairs(300)} GROUP BY e.line_id)
 SELECT * FROM r JOIN e USING (line_id) JOIN o USING (line_id)"""


_parsed: dict[tuple[str, str], DataFrame] = {}


def parsed_lines(spark, sf):
    """The parsed fixture lines as the stored table the state operators read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _parsed:
        lines = parsing.parse_logs(derived.lines(spark, sf), now(), F.lit(2024))
        _parsed[key] = stage(parsing.normalize(lines).drop("raw_log", "tags", "extra"))
    return _parsed[key]


def events(spark, sf):
    wanted = ("line_id", "timestamp", "source_ip", "event_type", "success", "endpoint")
    return parsed_lines(spark, sf).select(*wanted)


def feature(spark, sf, *names, **options):
    return keyed_time.keyed_features(events(spark, sf), **options).select("line_id", *names)


@query("win_login_rate", frame_sql("strict"))
def win_login_rate(spark, sf):
    return feature(
        spark, sf, "login_attempts_per_minute", F.round("failed_auth_rate", 9).alias("failed_auth_rate")
    )


@query("win_failed_auth_rate", frame_sql("extended"))
def win_failed_auth_rate(spark, sf):
    rate = F.round("failed_auth_rate", 9).alias("failed_auth_rate")
    return feature(spark, sf, "login_attempts_per_minute", rate, auth_rule="extended")


@query(
    "win_request_rate",
    f"WITH {ev()} SELECT e.line_id, round(count(DISTINCT p.sec) / 60.0::DOUBLE, 9) AS requests_per_second {pairs(60)} GROUP BY e.line_id",
)
def win_request_rate(spark, sf):
    return feature(spark, sf, F.round("requests_per_second", 9).alias("requests_per_second"))


@query(
    "win_unique_endpoints",
    f"""WITH {ev()}, g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= 3600 THEN 1 ELSE 0 END AS gap FROM ev WINDOW w AS (PARTITION BY source_ip ORDER BY sec, line_id)),
 s AS (SELECT *, sum(gap) OVER (PARTITION BY source_ip ORDER BY sec, line_id) AS session FROM g)
 SELECT e.line_id, count(DISTINCT p.endpoint) AS unique_endpoints_accessed FROM s e LEFT JOIN s p ON p.source_ip = e.source_ip AND p.session = e.session AND (p.sec < e.sec OR (p.sec = e.sec AND p.line_id < e.line_id)) GROUP BY e.line_id""",
)
def win_unique_endpoints(spark, sf):
    return feature(spark, sf, "unique_endpoints_accessed")


@query(
    "win_unique_ips",
    f"""WITH {ev()} SELECT e.line_id, count(DISTINCT p.source_ip) AS unique_ips_last_hour FROM ev e LEFT JOIN ev p
 ON p.t >= date_trunc('minute', e.t) - INTERVAL 1 HOUR AND p.t < date_trunc('minute', e.t) GROUP BY e.line_id""",
)
def win_unique_ips(spark, sf):
    return keyed_time.with_unique_ips(events(spark, sf)).select("line_id", "unique_ips_last_hour")


def idle_sql(limit: str) -> str:
    return f"""WITH {ev()}, d AS (SELECT line_id, sec - lag(sec) OVER (PARTITION BY source_ip ORDER BY sec, line_id) AS idle FROM ev)
 SELECT line_id, CAST(CASE WHEN {limit} THEN idle ELSE 0 END AS DOUBLE) AS time_since_last_activity_sec FROM d"""


@query("win_idle_time", idle_sql("idle IS NOT NULL"))
def win_idle_time(spark, sf):
    return feature(spark, sf, "time_since_last_activity_sec")


@query("win_idle_time_expiring", idle_sql("idle < 3600"))
def win_idle_time_expiring(spark, sf):
    return feature(spark, sf, "time_since_last_activity_sec", activity_ttl_sec=3600)


@query(
    "win_session_duration",
    f"""WITH {ev()}, g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= 1800 THEN 1 ELSE 0 END AS gap FROM ev WINDOW w AS (PARTITION BY source_ip ORDER BY sec, line_id)),
 s AS (SELECT *, sum(gap) OVER (PARTITION BY source_ip ORDER BY sec, line_id) AS session FROM g)
 SELECT line_id, CAST(sec - min(sec) OVER (PARTITION BY source_ip, session) AS DOUBLE) AS session_duration_sec FROM s""",
)
def win_session_duration(spark, sf):
    return feature(spark, sf, "session_duration_sec")


@query(
    "win_last_n",
    f"WITH {ev()} SELECT source_ip, line_id FROM ev QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY sec DESC, line_id DESC) <= 1000",
)
def win_last_n(spark, sf):
    newest = [F.desc("timestamp"), F.desc("line_id")]
    return top_per_group(
        events(spark, sf).select("source_ip", "timestamp", "line_id"), ["source_ip"], newest, 1000
    ).select("source_ip", "line_id")


@query(
    "kv_session_ttl",
    f"""SELECT source_ip, session_id, max(created_at) AS stored_at, arg_max(event_type, (created_at, id)) AS session_data FROM
 (SELECT id, created_at, '10.0.' || CAST(user_id % 2 AS VARCHAR) || '.' || CAST(user_id % 8 AS VARCHAR) AS source_ip, 'user' || CAST(user_id AS VARCHAR) AS session_id, event_type FROM (SELECT event_id AS id, ts AS created_at, user_id, event_type FROM events WHERE ts <= {AS_OF}))
 GROUP BY source_ip, session_id HAVING max(created_at) + INTERVAL 24 HOUR > {AS_OF}""",
)
def kv_session_ttl(spark, sf):
    from logvane.operators.sessions_kv import live_sessions

    puts = derived.anomalies(spark, sf).select(
        "id",
        "source_ip",
        F.col("username").alias("session_id"),
        F.col("event_type").alias("session_data"),
        F.col("created_at").alias("stored_at"),
    )
    as_of = F.lit(derived.AS_OF).cast("timestamp_ntz")
    return live_sessions(puts, as_of, ttl_sec=86400)
