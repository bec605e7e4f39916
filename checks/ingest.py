"""Ingest and single-event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.parsed_sql import parsed
from checks.parsing import now
from checks.registry import GEO_RANGES, LINES, MIXED, RFC5424_LINES, query
from checks.windows import EV, parsed_lines, state_sql
from logvane.functions import scalar
from logvane.operators import features, lookup, parsing
from logvane.schema import FEATURE_NAMES
from logvane.sources import derived, ingest


@query(
    "reject_invalid",
    """SELECT doc_id, source, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 10000 THEN 'too long' WHEN source NOT IN ('syslog','nginx','auth','firewall','custom') THEN 'unknown source' END AS reason
 FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'syslog' WHEN 1 THEN 'nginx' WHEN 2 THEN 'custom' ELSE 'journal' END AS source FROM documents)
 WHERE length(text) = 0 OR length(text) > 10000 OR source NOT IN ('syslog','nginx','auth','firewall','custom')""",
)
def reject_invalid(spark, sf):
    docs = derived.read_table(spark, sf, "documents")
    source = F.expr("CASE doc_id % 4 WHEN 0 THEN 'syslog' WHEN 1 THEN 'nginx' WHEN 2 THEN 'custom' ELSE 'journal' END")
    lines = docs.select("doc_id", F.col("text").alias("log_line"), source.alias("source"))
    return ingest.split_valid(lines)[1].select("doc_id", "source", "reason")


@query(
    "json_envelope",
    """SELECT e.event_id, i AS position, 'line ' || CAST(e.event_id AS VARCHAR) || ' of ' || e.event_type || CASE WHEN i = 1 THEN ' again' ELSE '' END AS log_line, CASE WHEN i = 1 THEN 'nginx' ELSE 'auth' END AS source
 FROM events e, (VALUES (0), (1)) AS v(i) WHERE i = 0 OR e.event_id % 2 = 1""",
)
def json_envelope(spark, sf):
    events = derived.read_table(spark, sf, "events")
    text = F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(" of "), F.col("event_type"))
    one = F.struct(text.alias("log_line"), F.lit("auth").alias("source"))
    two = F.struct(F.concat(text, F.lit(" again")).alias("log_line"), F.lit("nginx").alias("source"))
    many = F.to_json(F.struct(F.array(one, two).alias("logs")))
    bodies = events.select(
        "event_id", F.when(F.col("event_id") % 2 == 1, many).otherwise(F.to_json(one)).alias("body")
    )
    return ingest.unpack_envelopes(bodies).select("event_id", "position", "log_line", "source")


PATHS = "CASE event_id % 5 WHEN 0 THEN '/var/log/auth.log' WHEN 1 THEN '/var/log/nginx/access.log' WHEN 2 THEN '/var/log/messages' WHEN 3 THEN '/var/log/secure.1' ELSE '/opt/app/out.log' END"


@query(
    "source_from_path",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'nginx' WHEN 2 THEN 'syslog' WHEN 3 THEN 'auth' ELSE 'custom' END AS source FROM events",
)
def source_from_path(spark, sf):
    events = derived.read_table(spark, sf, "events").withColumn("path", F.expr(PATHS))
    return events.select("event_id", ingest.source_of_path("path").alias("source"))


@query("severity_gate", f"SELECT line_id FROM ({RFC5424_LINES}) WHERE (line_id % 192) % 8 <= 4")
def severity_gate(spark, sf):
    return ingest.severe_only(derived.rfc5424_lines(spark, sf)).select("line_id")


@query(
    "severity_sample",
    f"SELECT line_id, severity FROM ({parsed(MIXED)}) WHERE line_id % 100 < CASE WHEN severity IN ('CRITICAL','ERROR') THEN 100 WHEN severity = 'WARNING' THEN 50 ELSE 10 END",
)
def severity_sample(spark, sf):
    p = parsing.parse_logs(derived.mixed_lines(spark, sf), now())
    return ingest.sample_by_severity(p).select("line_id", "severity")


@query("event_id", f"SELECT line_id, substr(md5(log_line || CAST(line_id AS VARCHAR)), 1, 12) AS log_id FROM ({LINES})")
def event_id(spark, sf):
    return ingest.with_event_id(derived.lines(spark, sf)).select("line_id", "log_id")


SCALARS = f"""SELECT line_id, CAST(hour(t) AS INTEGER) AS hour_of_day, CAST(isodow(t) - 1 AS INTEGER) AS day_of_week, isodow(t) >= 6 AS is_weekend, hour(t) BETWEEN 9 AND 17 AS is_business_hours,
 CAST(status_code BETWEEN 400 AND 499 AS DOUBLE) AS error_rate_4xx, CAST(status_code BETWEEN 500 AND 599 AS DOUBLE) AS error_rate_5xx, username = 'root' AS is_privileged_user, starts_with(endpoint, '/admin') AS is_sensitive_endpoint,
 user_agent = 'Mozilla/5.0' AS is_known_user_agent, source_ip = '10.0.0.1' AS is_known_ip, round(ln(1 + bytes_sent), 6) AS bytes_transferred FROM ({EV})"""


def scalars(spark, sf):
    return features.scalar_features(parsed_lines(spark, sf).drop("country").withColumn("country", F.lit("US")))


@query("feat_temporal", f"SELECT line_id, hour_of_day, day_of_week, is_weekend, is_business_hours FROM ({SCALARS})")
def feat_temporal(spark, sf):
    return scalars(spark, sf).select("line_id", "hour_of_day", "day_of_week", "is_weekend", "is_business_hours")


@query("feat_http_errors", f"SELECT line_id, error_rate_4xx, error_rate_5xx FROM ({SCALARS})")
def feat_http_errors(spark, sf):
    return scalars(spark, sf).select("line_id", "error_rate_4xx", "error_rate_5xx")


@query(
    "feat_context",
    f"SELECT line_id, is_privileged_user, is_sensitive_endpoint, is_known_user_agent, is_known_ip, line_id % 3 = 0 AS is_known_country FROM ({SCALARS})",
)
def feat_context(spark, sf):
    """A third of the lines comes from a country that is not known, a third from none."""
    country = F.expr("CASE line_id % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'ZZ' END")
    events = parsed_lines(spark, sf).drop("country").withColumn("country", country)
    return features.scalar_features(events).select(
        "line_id", "is_privileged_user", "is_sensitive_endpoint", "is_known_user_agent", "is_known_ip", "is_known_country"
    )


@query("feat_bytes_log", f"SELECT line_id, bytes_transferred FROM ({SCALARS})")
def feat_bytes_log(spark, sf):
    return scalars(spark, sf).select("line_id", F.round("bytes_transferred", 6).alias("bytes_transferred"))


@query(
    "feat_entropy",
    """WITH b AS (SELECT doc_id, length(text) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
 c AS (SELECT doc_id, n, x, count(*) AS k FROM b GROUP BY doc_id, n, x)
 SELECT d.doc_id, round(coalesce(e.entropy, 0), 6) AS entropy FROM documents d LEFT JOIN (SELECT doc_id, sum(-(k / n) * log2(k / n)) AS entropy FROM c GROUP BY doc_id) e USING (doc_id)""",
)
def feat_entropy(spark, sf):
    docs = derived.read_table(spark, sf, "documents")
    return docs.select("doc_id", F.round(scalar.entropy(F.col("text")), 6).alias("entropy"))


# all 21 features of every line; the addresses of the hour before are counted per minute
ALL_FEATURES = f"""WITH st AS ({state_sql("strict")}), sc AS ({SCALARS}), ev AS (SELECT line_id, source_ip, date_trunc('minute', t) AS m, ln(1 + bytes_sent) AS bytes_transferred FROM ({EV})),
 active AS (SELECT DISTINCT m, source_ip FROM ev), asked AS (SELECT DISTINCT m FROM ev),
 u AS (SELECT k.m, count(DISTINCT a.source_ip) AS unique_ips_last_hour FROM asked k LEFT JOIN active a ON a.m >= k.m - INTERVAL 1 HOUR AND a.m < k.m GROUP BY k.m),
 b AS (SELECT line_id, length(log_line) AS n, unnest(regexp_extract_all(hex(encode(log_line)), '..')) AS x FROM ({LINES})),
 en AS (SELECT line_id, sum(-(k / n) * log2(k / n)) AS payload_entropy FROM (SELECT line_id, n, x, count(*) AS k FROM b GROUP BY ALL) GROUP BY line_id)
 SELECT sc.* EXCLUDE (bytes_transferred), ev.bytes_transferred, st.* EXCLUDE (line_id), u.unique_ips_last_hour, en.payload_entropy, 0.0::DOUBLE AS geographic_distance_km, false AS is_known_country
 FROM sc JOIN st USING (line_id) JOIN ev USING (line_id) JOIN u ON u.m = ev.m JOIN en USING (line_id)"""


def all_21(spark, sf):
    return features.all_features(parsed_lines(spark, sf))


@query(
    "feat_vector",
    "SELECT line_id, 21 AS size, "
    + ", ".join(f"round(CAST(CAST({n} AS FLOAT) AS DOUBLE), 5) AS v{i}" for i, n in enumerate(FEATURE_NAMES))
    + f" FROM ({ALL_FEATURES})",
)
def feat_vector(spark, sf):
    """Every cell of the vector, to five decimals: cells are 32-bit floats."""
    made = all_21(spark, sf).select("line_id", scalar.vector().alias("v"))
    parts = [F.round(F.col("v")[i].cast("double"), 5).alias(f"v{i}") for i in range(len(FEATURE_NAMES))]
    return made.select("line_id", F.size("v").alias("size"), *parts)


SHOWN = [
    (f"{group}_{name}", source, digits)
    for group, fields in scalar.NESTED.items()
    for name, source, digits in fields
]


@query(
    "feat_nested",
    "SELECT line_id, "
    + ", ".join(f"{source if digits is None else f'round_even({source}, {digits})'} AS {name}" for name, source, digits in SHOWN)
    + f" FROM ({ALL_FEATURES})",
)
def feat_nested(spark, sf):
    """The features in their groups, with the decimals they are shown with."""
    rows = all_21(spark, sf).select("line_id", scalar.nested().alias("n"))
    cells = [
        F.col(f"n.{group}.{name}").alias(f"{group}_{name}") for group, fields in scalar.NESTED.items() for name, _, _ in fields
    ]
    return rows.select("line_id", *cells)


LOCATED = f"""SELECT e.*, g.country, g.lat, g.lon FROM ({EV}) e LEFT JOIN ({GEO_RANGES}) g ON
 CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) BETWEEN lo AND hi"""


def located(spark, sf):
    return lookup.locate(parsed_lines(spark, sf).drop("country"), derived.geo_ranges(spark, sf))


@query("geo_range_join", f"SELECT line_id, source_ip, country, lat, lon FROM ({LOCATED})")
def geo_range_join(spark, sf):
    return located(spark, sf).select("line_id", "source_ip", "country", "lat", "lon")


@query(
    "geo_distance",
    f"""WITH l AS ({LOCATED}), c AS (SELECT username, country, lat, lon, count(*) AS n FROM l WHERE lat IS NOT NULL AND username <> '' GROUP BY ALL),
 h AS (SELECT username, lat AS hlat, lon AS hlon FROM c QUALIFY row_number() OVER (PARTITION BY username ORDER BY n DESC, country) = 1)
 SELECT line_id, CASE WHEN lat IS NULL OR hlat IS NULL THEN 0 ELSE round(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - hlat) / 2), 2) + cos(radians(hlat)) * cos(radians(lat)) * pow(sin(radians(lon - hlon) / 2), 2)))), 4) END AS geographic_distance_km FROM l LEFT JOIN h USING (username)""",
)
def geo_distance(spark, sf):
    found = located(spark, sf)
    km = F.round("geographic_distance_km", 4).alias("geographic_distance_km")
    return lookup.with_distance(found, lookup.usual_places(found)).select("line_id", km)


HIGH_RISK_IPS = "SELECT DISTINCT '10.0.' || CAST(user_id % 2 AS VARCHAR) || '.' || CAST(user_id % 8 AS VARCHAR) AS source_ip FROM events WHERE user_id < 3"


def risky_ips(spark, sf):
    bought = derived.read_table(spark, sf, "events").filter("user_id < 3")
    return bought.select(F.expr("'10.0.' || cast(user_id % 2 as string) || '.' || cast(user_id % 8 as string)").alias("source_ip"))


@query("ip_allowlist_semi", f"SELECT line_id, source_ip FROM ({EV}) WHERE source_ip IN ({HIGH_RISK_IPS})")
def ip_allowlist_semi(spark, sf):
    return lookup.allowed(parsed_lines(spark, sf), risky_ips(spark, sf)).select("line_id", "source_ip")


@query("ip_allowlist_anti", f"SELECT line_id, source_ip FROM ({EV}) WHERE source_ip NOT IN ({HIGH_RISK_IPS})")
def ip_allowlist_anti(spark, sf):
    return lookup.not_blocked(parsed_lines(spark, sf), risky_ips(spark, sf)).select("line_id", "source_ip")


@query(
    "threat_intel_join",
    f"SELECT e.line_id, e.source_ip, i.threat FROM ({EV}) e JOIN (SELECT source_ip, 'scanner' AS threat FROM ({HIGH_RISK_IPS})) i USING (source_ip)",
)
def threat_intel_join(spark, sf):
    indicators = risky_ips(spark, sf).distinct().select(
        F.col("source_ip").alias("indicator_ip"), F.lit("scanner").alias("threat")
    )
    return lookup.match_indicators(parsed_lines(spark, sf), indicators).select("line_id", "source_ip", "threat")
