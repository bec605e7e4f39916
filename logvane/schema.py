"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_LINE = T.StructType(
    [
        T.StructField("line_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("log_line", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# --- fixed values: the parsed record ---
PARSED = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("status_message", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("username", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("bytes_sent", T.LongType()),
        T.StructField("bytes_received", T.LongType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("process_id", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("facility", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

# --- fixed values: order of the feature vector ---
FEATURE_NAMES = (
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_business_hours",
    "login_attempts_per_minute",
    "requests_per_second",
    "unique_ips_last_hour",
    "unique_endpoints_accessed",
    "failed_auth_rate",
    "error_rate_4xx",
    "error_rate_5xx",
    "geographic_distance_km",
    "is_known_country",
    "is_known_ip",
    "bytes_transferred",
    "time_since_last_activity_sec",
    "session_duration_sec",
    "payload_entropy",
    "is_privileged_user",
    "is_sensitive_endpoint",
    "is_known_user_agent",
)

# --- fixed values: value of a feature missing from a stored record ---
FEATURE_DEFAULTS = {
    "hour_of_day": 12.0,
    "day_of_week": 2.0,
    "is_weekend": 0.0,
    "is_business_hours": 1.0,
    "login_attempts_per_minute": 0.5,
    "requests_per_second": 0.5,
    "unique_ips_last_hour": 5.0,
    "unique_endpoints_accessed": 3.0,
    "failed_auth_rate": 0.05,
    "error_rate_4xx": 0.02,
    "error_rate_5xx": 0.01,
    "geographic_distance_km": 10.0,
    "is_known_country": 1.0,
    "is_known_ip": 1.0,
    "bytes_transferred": 6.90875477931522,
    "time_since_last_activity_sec": 60.0,
    "session_duration_sec": 300.0,
    "payload_entropy": 4.5,
    "is_privileged_user": 0.0,
    "is_sensitive_endpoint": 0.0,
    "is_known_user_agent": 1.0,
}
