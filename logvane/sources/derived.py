"""Log lines and scored tables computed from the `events` table.

The SQL texts hold for Spark and for the check engine alike; only `{events}` differs.
Every row of `events` takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(t)*3-2, 3)"
HMS = (
    "lpad(cast(hour(t) as string),2,'0') || ':' || lpad(cast(minute(t) as string),2,'0')"
    " || ':' || lpad(cast(second(t) as string),2,'0')"
)

# every fifth user's errors come as bursts of five lines, seven seconds apart
BURST = "event_type='error' AND user_id % 5 = 0"

EXPANDED = """
SELECT e.*, '10.0.' || cast(user_id % 2 as string) || '.' || cast(user_id % 8 as string) AS ip,
 date_trunc('second', ts) + k * INTERVAL '7' SECOND AS t
FROM {expanded} e
"""

LINES = (
    """
SELECT event_id*8 + k AS line_id,
 CASE WHEN event_type IN ('error','signup') THEN 'auth' WHEN event_type IN ('click','view') THEN 'nginx' ELSE 'firewall' END AS source,
 CASE
 WHEN event_type IN ('error','signup') THEN MON || ' ' || cast(day(t) as string) || ' ' || HMS || ' host' || cast(user_id % 3 as string) || ' sshd[' || cast(1000+user_id as string) || ']: ' || CASE WHEN event_type='error' THEN 'Failed password for ' ELSE 'Accepted password for ' END || CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'user' || cast(user_id as string) END || ' from ' || ip || ' port ' || cast(50000+event_id % 10000 as string) || ' ssh2'
 WHEN event_type IN ('click','view') THEN ip || ' - - [' || lpad(cast(day(t) as string),2,'0') || '/' || MON || '/' || cast(year(t) as string) || ':' || HMS || ' +0000] "GET ' || CASE event_id % 5 WHEN 0 THEN '/login' WHEN 1 THEN '/admin/panel' WHEN 2 THEN '/api/users' WHEN 3 THEN '/a/../etc/passwd' ELSE '/' END || ' HTTP/1.1" ' || CASE event_id % 7 WHEN 0 THEN '403' WHEN 1 THEN '500' ELSE '200' END || ' ' || cast(cast(floor(value*100) as bigint) as string) || ' "-" "Mozilla/5.0"'
 ELSE MON || ' ' || cast(day(t) as string) || ' ' || HMS || ' fw kernel: [1.5] ' || CASE WHEN event_id % 3 = 0 THEN 'ACCEPT' ELSE 'DROP' END || ' IN=eth0 OUT= SRC=' || ip || ' DST=10.0.0.1 LEN=60 PROTO=TCP SPT=' || cast(50000+event_id % 10000 as string) || ' DPT=' || CASE event_id % 4 WHEN 0 THEN '22' WHEN 1 THEN '443' WHEN 2 THEN '3389' ELSE '9999' END
 END AS log_line
FROM ("""
    + EXPANDED
    + """) x
"""
).replace("MON", MONTH).replace("HMS", HMS)

# one line per event over all formats, with broken, foreign and unusual ones among them
MIXED = (
    """
SELECT event_id AS line_id,
 CASE WHEN event_id % 24 < 6 THEN 'syslog' WHEN event_id % 24 < 15 THEN 'auth' WHEN event_id % 24 < 20 THEN 'nginx' WHEN event_id % 24 < 23 THEN 'firewall' ELSE 'custom' END AS source,
 CASE event_id % 24
 WHEN 0 THEN STAMP || ' app cron[' || cast(user_id as string) || ']: (backup) CMD (/opt/jobs/rotate.sh)'
 WHEN 1 THEN STAMP || ' app systemd[1]: Started job ' || cast(user_id as string)
 WHEN 2 THEN STAMP || ' srv sshd[9]: Failed password for user' || cast(user_id as string) || ' from ' || ip || ' port 22 ssh2'
 WHEN 3 THEN '<' || cast(event_id % 192 as string) || '>1 2024-01-' || lpad(cast(day(t) as string),2,'0') || 'T' || HMS || 'Z mail su ' || cast(user_id as string) || ' ID' || cast(event_id % 50 as string) || ' - warning: su root denied for user' || cast(user_id as string)
 WHEN 4 THEN '<34>broken ' || ip
 WHEN 5 THEN 'Feb 30 ' || HMS || ' app kernel: link up ' || ip
 WHEN 6 THEN STAMP || ' server sudo: user' || cast(user_id as string) || ' : TTY=pts/1 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/less'
 WHEN 7 THEN STAMP || ' server su: pam_unix(su:session): session opened for user root by user' || cast(user_id as string)
 WHEN 8 THEN STAMP || ' server pam: authentication failure; user=user' || cast(user_id as string) || ' rhost=' || ip
 WHEN 9 THEN STAMP || ' server login[2]: FAILED LOGIN for user' || cast(user_id as string)
 WHEN 10 THEN STAMP || ' server useradd[3]: new user: useradd name=user' || cast(user_id as string)
 WHEN 11 THEN STAMP || ' server passwd[4]: password changed for user' || cast(user_id as string)
 WHEN 12 THEN STAMP || ' server sshd[5]: Invalid user guest from ' || ip
 WHEN 13 THEN 'account locked for user' || cast(user_id as string)
 WHEN 14 THEN STAMP || ' server sshd[6]: Connection closed by ' || ip
 WHEN 15 THEN ip || ' - user' || cast(user_id as string) || ' [' || cast(day(t) as string) || '/Jan/2024:' || HMS || ' +0000] "POST /upload' || CASE WHEN user_id % 2 = 0 THEN '.php' ELSE '?q=union+select' END || ' HTTP/1.1" 302 ' || cast(user_id as string) || ' "http://a.example/" "curl/8.0"'
 WHEN 16 THEN ip || ' - - [31/Feb/2024:' || HMS || ' +0000] "GET / HTTP/1.1" 200 5 "-" "-"'
 WHEN 17 THEN '2024/01/' || lpad(cast(day(t) as string),2,'0') || ' ' || HMS || ' [' || CASE WHEN user_id % 3 = 0 THEN 'error' WHEN user_id % 3 = 1 THEN 'warn' ELSE 'crit' END || '] ' || cast(user_id as string) || '#0: ' || CASE WHEN event_id % 2 = 0 THEN '*' || cast(event_id as string) || ' ' ELSE '' END || 'connect() failed, client: ' || ip
 WHEN 18 THEN STAMP || ' web nginx: ' || ip || ' "GET / HTTP/1.1" 200 5'
 WHEN 19 THEN ip || ' - - [' || cast(day(t) as string) || '/jan/2024:' || HMS || ' +0000] "GET /%3Cscript?x=<script>' || cast(user_id as string) || ' HTTP/1.1" 500 5 "-" "-"'
 WHEN 20 THEN STAMP || ' fw kernel: [2.5] REJECT IN= OUT=eth1 SRC=' || ip || ' DST=10.0.0.9 LEN=84 PROTO=ICMP TYPE=8'
 WHEN 21 THEN 'IN=eth0 OUT= SRC=' || ip || ' DST=10.0.0.9 PROTO=UDP SPT=5 DPT=' || CASE WHEN user_id % 2 = 0 THEN '53' ELSE '5432' END
 WHEN 22 THEN 'no packet here ' || ip
 ELSE chr(123) || '"ip":"' || ip || '","user":"user' || cast(user_id as string) || '","kind":"app_' || event_type || '","code":' || cast(200 + event_id % 300 as string) || chr(125) END AS log_line,
 t, ip, user_id, event_id
FROM (SELECT events.*, '10.0.' || cast(user_id % 2 as string) || '.' || cast(user_id % 8 as string) AS ip, date_trunc('second', ts) AS t FROM {events} events) x
"""
).replace("STAMP", MONTH + " || ' ' || cast(day(t) as string) || ' ' || HMS").replace("HMS", HMS)

RFC5424_LINES = """
SELECT event_id AS line_id, '<' || cast(event_id % 192 as string) || '>1 2024-01-' || lpad(cast(day(ts) as string),2,'0') || 'T' || lpad(cast(hour(ts) as string),2,'0') || ':00:00Z mail sshd ' || cast(user_id as string) || ' ID' || cast(event_id % 50 as string) || ' - Failed password for user' || cast(user_id as string) || ' from 10.0.0.' || cast(user_id % 8 as string) AS log_line FROM {events}
"""

NGINX_ERROR_LINES = """
SELECT event_id AS line_id, '2024/01/' || lpad(cast(day(ts) as string),2,'0') || ' ' || lpad(cast(hour(ts) as string),2,'0') || ':00:00 [' || CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'crit' END || '] ' || cast(user_id as string) || '#0: ' || CASE WHEN event_id % 2 = 0 THEN '*' || cast(event_id as string) || ' ' ELSE '' END || 'connect() failed, client: 10.0.0.' || cast(user_id % 8 as string) AS log_line FROM {events}
"""

ANOMALIES = """
SELECT event_id AS id, ts AS created_at, '10.0.' || cast(user_id % 2 as string) || '.' || cast(user_id % 8 as string) AS source_ip,
 'user' || cast(user_id as string) AS username, event_type, cast((event_id * 7919) % 1000 as double) / 1000 AS risk_score,
 CASE WHEN (event_id * 7919) % 1000 >= 800 THEN 'high' WHEN (event_id * 7919) % 1000 >= 600 THEN 'medium'
      WHEN (event_id * 7919) % 1000 >= 400 THEN 'low' ELSE 'normal' END AS risk_level,
 (event_id * 7919) % 1000 >= 400 AS is_anomaly
FROM {events}
"""

FEEDBACK = """
SELECT event_id * 10 AS id, event_id AS anomaly_id, event_id % 3 = 0 AS is_false_positive, ts AS created_at
FROM {events} WHERE event_id % 9 = 0
UNION ALL
SELECT event_id * 10 + 1 AS id, event_id AS anomaly_id, (event_id + 1) % 3 = 0 AS is_false_positive, ts AS created_at
FROM {events} WHERE event_id % 9 = 0 AND event_id % 2 = 0
"""

ALERTS = """
SELECT event_id AS id, event_id AS anomaly_id, ts AS created_at,
 CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'sent' WHEN 2 THEN 'failed' ELSE 'acknowledged' END AS delivery_status,
 event_id % 4 IN (1,3) AS sent, event_id % 4 = 3 AS acknowledged,
 CASE WHEN event_id % 4 = 3 THEN ts + (event_id % 60) * INTERVAL '1' MINUTE END AS acknowledged_at
FROM {events} WHERE (event_id * 7919) % 1000 >= 800 AND event_id % 5 <> 0
"""

LABELLED_SCORES = """
SELECT event_id AS id, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS label,
 cast(floor(value) + CASE WHEN event_type='error' THEN 30 ELSE 0 END as double)/(cast(floor(value) as double) + 130) AS score
FROM {events}
"""

GEO_RANGES = """
SELECT cast(lo as bigint) AS lo, cast(hi as bigint) AS hi, country, cast(lat as double) AS lat, cast(lon as double) AS lon
FROM (VALUES (167772160, 167772163, 'US', 40.0, -74.0), (167772164, 167772415, 'RU', 55.75, 37.62),
 (167772416, 167772419, 'ES', 40.42, -3.70), (167772420, 167772671, 'CN', 39.9, 116.4)) AS g(lo, hi, country, lat, lon)
"""

AS_OF = "2024-01-31 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table that is one small file, over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _from_events(text: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, events=read_table(spark, sf_dir, "events"))

    return build


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`line_id, source, log_line`: auth, nginx and firewall lines with bursts."""
    events = read_table(spark, sf_dir, "events")
    copies = F.when(F.expr(BURST), F.array(*[F.lit(i) for i in range(5)])).otherwise(
        F.array(F.lit(0))
    )
    return spread(spark.sql(LINES, expanded=events.withColumn("k", F.explode(copies))))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all formats, with broken ones and a foreign source."""
    events = read_table(spark, sf_dir, "events")
    return spread(spark.sql(MIXED, events=events).select("line_id", "source", "log_line"))


def mixed_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, every one with a metadata map."""
    events = read_table(spark, sf_dir, "events")
    rows = spark.sql(MIXED, events=events)
    user = F.concat(F.lit("meta"), F.col("user_id").cast("string"))
    code = F.when(F.col("event_id") % 3 == 0, F.lit("418")).otherwise(F.lit("not a number"))
    metadata = F.create_map(
        F.lit("username"), user, F.lit("status_code"), code, F.lit("note"), F.lit("x")
    )
    return rows.select("line_id", "source", "log_line", metadata.alias("metadata"))


rfc5424_lines = _from_events(RFC5424_LINES)
nginx_error_lines = _from_events(NGINX_ERROR_LINES)
anomalies = _from_events(ANOMALIES)
feedback = _from_events(FEEDBACK)
alerts = _from_events(ALERTS)
labelled_scores = _from_events(LABELLED_SCORES)


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GEO_RANGES)
