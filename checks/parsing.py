"""Parsing and ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.parsed_sql import parsed
from checks.registry import AS_OF, LINES, MIXED, NGINX_ERROR_LINES, RFC5424_LINES, query
from logvane.operators import parsing
from logvane.sources import derived

ALL = (
    'line_id, source, parse_status, "timestamp", source_ip, source_port, destination_ip, destination_port, event_type, method,'
    " endpoint, protocol, status_code, status_message, success, username, bytes_sent, hostname, process_name, process_id,"
    " user_agent, referer, payload, message, severity, facility, tag, extra"
)


def now():
    return F.lit(derived.AS_OF).cast("timestamp")


def flat(df: DataFrame) -> DataFrame:
    """The parsed columns as plain values."""
    names = [c.strip().strip('"') for c in ALL.split(",")]
    out = df.withColumn("tag", F.array_join("tags", ",")).withColumn(
        "extra",
        F.array_join(
            F.transform(
                F.map_entries("extra"),
                lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
            ),
            ",",
        ),
    )
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(*names)


def from_source(source: str) -> str:
    both = f"SELECT line_id, source, log_line FROM ({LINES}) UNION ALL SELECT -line_id - 1 AS line_id, source, log_line FROM ({MIXED})"
    return f"SELECT line_id, '{source}' AS source, log_line FROM ({both})"


def all_lines(spark, sf):
    """Every line of both sets: each parser also meets the lines of the other sources."""
    other = derived.mixed_lines(spark, sf).withColumn("line_id", -F.col("line_id") - 1)
    return derived.lines(spark, sf).unionByName(other)


@query("parse_syslog", f"SELECT {ALL} FROM ({parsed(from_source('syslog'))})")
def parse_syslog(spark, sf):
    return flat(parsing.normalize(parsing.parse_syslog(all_lines(spark, sf), now())))


@query("parse_auth", f"SELECT {ALL} FROM ({parsed(from_source('auth'))})")
def parse_auth(spark, sf):
    return flat(parsing.normalize(parsing.parse_auth(all_lines(spark, sf), now())))


@query("parse_firewall", f"SELECT {ALL} FROM ({parsed(from_source('firewall'))})")
def parse_firewall(spark, sf):
    return flat(parsing.normalize(parsing.parse_firewall(all_lines(spark, sf), now())))


@query("parse_nginx_access", f"SELECT {ALL} FROM ({parsed(from_source('nginx'))})")
def parse_nginx_access(spark, sf):
    return flat(parsing.normalize(parsing.parse_nginx(all_lines(spark, sf), now())))


@query(
    "parse_rfc5424",
    f"SELECT {ALL} FROM ({parsed(f'SELECT line_id, {chr(39)}syslog{chr(39)} AS source, log_line FROM ({RFC5424_LINES})')})",
)
def parse_rfc5424(spark, sf):
    return flat(parsing.normalize(parsing.parse_syslog(derived.rfc5424_lines(spark, sf), now())))


@query(
    "parse_nginx_error",
    f"SELECT {ALL} FROM ({parsed(f'SELECT line_id, {chr(39)}nginx{chr(39)} AS source, log_line FROM ({NGINX_ERROR_LINES})')})",
)
def parse_nginx_error(spark, sf):
    return flat(parsing.normalize(parsing.parse_nginx(derived.nginx_error_lines(spark, sf), now())))


@query("parse_dispatch_permissive", f"SELECT {ALL} FROM ({parsed(MIXED)})")
def parse_dispatch_permissive(spark, sf):
    return flat(parsing.normalize(parsing.parse_logs(derived.mixed_lines(spark, sf), now())))


@query("parse_dropmalformed", f"SELECT {ALL} FROM ({parsed(MIXED, mode='drop')})")
def parse_dropmalformed(spark, sf):
    lines = derived.mixed_lines(spark, sf)
    return flat(parsing.normalize(parsing.parse_logs(lines, now(), mode="dropmalformed")))


@query(
    "metadata_override",
    f"""SELECT p.line_id, 'meta' || CAST(e.user_id AS VARCHAR) AS username, CASE WHEN e.event_id % 3 = 0 THEN 418 ELSE p.status_code END AS status_code, p.event_type, p.hostname
 FROM ({parsed(MIXED)}) p JOIN events e ON p.line_id = e.event_id""",
)
def metadata_override(spark, sf):
    lines = derived.mixed_with_metadata(spark, sf)
    parsed_lines = parsing.normalize(parsing.parse_logs(lines, now()))
    return parsing.override_with_metadata(parsed_lines).select(
        "line_id", "username", "status_code", "event_type", "hostname"
    )


@query(
    "normalize_defaults",
    f"""SELECT parse_status, sum(CASE WHEN source_ip = 'unknown' THEN 1 ELSE 0 END)::BIGINT AS no_ip, sum(CASE WHEN username = '' THEN 1 ELSE 0 END)::BIGINT AS no_user,
 sum(CASE WHEN endpoint = '' THEN 1 ELSE 0 END)::BIGINT AS no_endpoint, sum(CASE WHEN status_code = 0 THEN 1 ELSE 0 END)::BIGINT AS no_status, sum(length(payload))::BIGINT AS payload_chars
 FROM ({parsed(MIXED)}) GROUP BY parse_status""",
)
def normalize_defaults(spark, sf):
    p = parsing.normalize(parsing.parse_logs(derived.mixed_lines(spark, sf), now()))
    return p.groupBy("parse_status").agg(
        F.count_if(F.col("source_ip") == "unknown").alias("no_ip"),
        F.count_if(F.col("username") == "").alias("no_user"),
        F.count_if(F.col("endpoint") == "").alias("no_endpoint"),
        F.count_if(F.col("status_code") == 0).alias("no_status"),
        F.sum(F.length("payload")).alias("payload_chars"),
    )


@query(
    "parse_json_custom",
    f"""SELECT line_id, CASE WHEN source = 'custom' THEN 'ok' ELSE 'error' END AS parse_status, CASE WHEN source = 'custom' THEN ip END AS source_ip,
 CASE WHEN source = 'custom' THEN 'user' || CAST(user_id AS VARCHAR) END AS username, CASE WHEN source = 'custom' THEN 'app_' || (SELECT event_type FROM events e WHERE e.event_id = m.event_id) ELSE 'unknown' END AS event_type,
 CASE WHEN source = 'custom' THEN CAST(200 + event_id % 300 AS INTEGER) END AS status_code, {AS_OF} AS "timestamp"
 FROM ({MIXED}) m""",
)
def parse_json_custom(spark, sf):
    names = {"source_ip": "ip", "username": "user", "event_type": "kind", "status_code": "code"}
    p = parsing.parse_json_app_logs(derived.mixed_lines(spark, sf), names, now())
    return p.select(
        "line_id",
        "parse_status",
        "source_ip",
        "username",
        "event_type",
        "status_code",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )
