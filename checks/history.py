"""Stored anomalies, logs, feedback and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import ALERTS, ANOMALIES, AS_OF, FEEDBACK, query
from checks.windows import EV, parsed_lines
from logvane.operators import cooldown, counting
from logvane.plans import alerting, feedback, history, stats
from logvane.session import shared_checkpoint_dir
from logvane.sources import derived, sinks
from logvane.sources.store import Store

A, FB, AL = f"({ANOMALIES})", f"({FEEDBACK})", f"({ALERTS})"
LOGS = "SELECT event_id AS id, ts AS created_at, '10.0.' || CAST(user_id % 2 AS VARCHAR) || '.' || CAST(user_id % 8 AS VARCHAR) AS source_ip, 'user' || CAST(user_id AS VARCHAR) AS username, event_type, value FROM events"


def as_of():
    return F.lit(derived.AS_OF).cast("timestamp_ntz")


def logs(spark, sf):
    return spark.sql(LOGS.replace("FROM events", "FROM {events}").replace("VARCHAR", "STRING"), events=derived.read_table(spark, sf, "events"))


@query("anomalies_page", f"SELECT id, created_at, risk_score, (SELECT count(*) FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 48 HOUR AND risk_score >= 0.6) AS total, 3 AS page, 10 AS page_size FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 48 HOUR AND risk_score >= 0.6 ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 20")
def anomalies_page(spark, sf):
    found = history.anomalies_page(derived.anomalies(spark, sf), as_of(), 10, 20, 48)
    return found.select("id", "created_at", "risk_score", "total", "page", "page_size")


@query("anomalies_filtered", f"SELECT * FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 240 HOUR AND risk_level = 'high' AND source_ip = '10.0.1.3' AND is_anomaly")
def anomalies_filtered(spark, sf):
    return history.find_anomalies(derived.anomalies(spark, sf), as_of(), 240, None, "high", "10.0.1.3", True)


@query("anomaly_detail", f"SELECT id, risk_score, source_ip, username, event_type FROM {A} WHERE id = 77")
def anomaly_detail(spark, sf):
    found = history.anomaly_detail(derived.anomalies(spark, sf), 77)
    return found.select("id", "risk_score", "context.source_ip", "context.username", "context.event_type")


@query("logs_page", f"SELECT * FROM ({LOGS}) WHERE created_at >= {AS_OF} - INTERVAL 72 HOUR AND source_ip = '10.0.0.2' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 5")
def logs_page(spark, sf):
    return history.logs_page(logs(spark, sf), as_of(), 50, 5, "10.0.0.2", 72)


@query("alerts_page", f"SELECT * FROM {AL} WHERE sent AND NOT acknowledged ORDER BY created_at DESC, id DESC LIMIT 100")
def alerts_page(spark, sf):
    return history.alerts_page(derived.alerts(spark, sf), 100, 0, True, False)


@query("upsert_review", f"SELECT id, CASE WHEN id % 9 = 0 THEN 'low' ELSE risk_level END AS risk_level, risk_score, CASE WHEN id % 9 = 0 THEN true END AS reviewed FROM {A}")
def upsert_review(spark, sf):
    """A stored table after reviews have come in: only days with reviewed rows are written again."""
    reviews = derived.feedback(spark, sf).groupBy(F.col("anomaly_id").alias("id")).agg(
        F.lit("low").alias("risk_level"), F.lit(True).alias("reviewed")
    )
    rows = derived.anomalies(spark, sf).withColumns(
        {"created_at": F.col("created_at").cast("timestamp"), "reviewed": F.lit(None).cast("boolean")}
    )
    table = Store(spark, f"{shared_checkpoint_dir(spark).rstrip('/')}/reviewed-{uuid.uuid4().hex}")
    table.write(rows, "all")
    table.update(reviews)
    return table.read().select("id", "risk_level", "risk_score", "reviewed")


@query("training_pull", f"SELECT id, risk_score FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 720 HOUR AND risk_score <= 0.6")
def training_pull(spark, sf):
    return history.training_pull(derived.anomalies(spark, sf), as_of(), min_samples=100).select("id", "risk_score")


@query("stats_counts", f"SELECT count(*) AS anomalies FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 240 HOUR AND risk_score >= 0.7")
def stats_counts(spark, sf):
    return stats.count_anomalies(derived.anomalies(spark, sf), as_of(), 240, 0.7)


@query("stats_by_level", f"SELECT risk_level, count(*) AS total FROM {A} GROUP BY risk_level")
def stats_by_level(spark, sf):
    return stats.counters(derived.anomalies(spark, sf), "risk_level")


@query("top_event_types", f"SELECT event_type, count(*) AS count FROM {A} WHERE is_anomaly GROUP BY event_type ORDER BY count DESC, event_type LIMIT 10")
def top_event_types(spark, sf):
    return stats.top_counts(derived.anomalies(spark, sf).filter("is_anomaly"), "event_type")


@query("top_source_ips", f"SELECT source_ip, count(*) AS count FROM {A} WHERE is_anomaly GROUP BY source_ip ORDER BY count DESC, source_ip LIMIT 10")
def top_source_ips(spark, sf):
    return stats.top_counts(derived.anomalies(spark, sf).filter("is_anomaly"), "source_ip")


def _set(dimension, value):
    return f"(SELECT '{dimension}' AS dimension, {value} AS value, count(*) AS anomalies, round(avg(risk_score), 9) AS avg_risk FROM a GROUP BY ALL ORDER BY anomalies DESC, value LIMIT 10)"


@query("stats_grouping_sets", f"WITH a AS (SELECT * FROM {A} WHERE is_anomaly AND created_at >= {AS_OF} - INTERVAL 480 HOUR) {_set('all', chr(39) * 2)} UNION ALL {_set('risk_level', 'risk_level')} UNION ALL {_set('event_type', 'event_type')} UNION ALL {_set('source_ip', 'source_ip')}")
def stats_grouping_sets(spark, sf):
    found = stats.anomaly_stats(derived.anomalies(spark, sf), as_of(), 480)
    return found.withColumn("avg_risk", F.round("avg_risk", 9))


@query("batch_summary", f"SELECT count(*) AS total_logs, CAST(sum(CAST(is_anomaly AS INTEGER)) AS BIGINT) AS anomalies_detected, round(avg(CAST(is_anomaly AS INTEGER)), 3) AS anomaly_rate FROM {A}")
def batch_summary(spark, sf):
    return stats.batch_summary(derived.anomalies(spark, sf))


@query("system_stats", f"SELECT count(*) AS total_logs, CAST(sum(CAST(is_anomaly AS INTEGER)) AS BIGINT) AS anomalies_detected, round(avg(CAST(is_anomaly AS INTEGER)), 3) AS anomaly_rate FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR")
def system_stats(spark, sf):
    return stats.system_stats(derived.anomalies(spark, sf), as_of())


@query("timeseries_hourly", f"SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM {A} WHERE is_anomaly GROUP BY 1")
def timeseries_hourly(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return stats.hourly_counts(derived.anomalies(spark, sf).filter("is_anomaly"), start, as_of()).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def series_sql(hours, label):
    start = f"({AS_OF} - INTERVAL {hours} HOUR)"
    return f"""SELECT h AS timestamp, {label} AS hour_label, (SELECT count(*) FROM {A} WHERE is_anomaly AND created_at BETWEEN {start} AND {AS_OF} AND date_trunc('hour', created_at) = h) AS anomalies,
 (SELECT count(*) FROM events WHERE ts BETWEEN {start} AND {AS_OF} AND date_trunc('hour', ts) = h) AS logs FROM (SELECT unnest(generate_series(date_trunc('hour', {start}), {AS_OF}, INTERVAL 1 HOUR)) AS h)"""


def series(spark, sf, hours):
    found = stats.timeseries(derived.anomalies(spark, sf).filter("is_anomaly"), logs(spark, sf), as_of(), hours)
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("timeseries_gapfill", series_sql(24, "CAST(hour(h) AS VARCHAR) || 'h'"))
def timeseries_gapfill(spark, sf):
    return series(spark, sf, 24)


@query("timeseries_week", series_sql(168, "strftime(h, '%b %d %Hh')"))
def timeseries_week(spark, sf):
    return series(spark, sf, 168)


@query("timeseries_totals", f"SELECT CAST(sum(anomalies) AS BIGINT) AS total_anomalies, CAST(sum(logs) AS BIGINT) AS total_logs FROM ({series_sql(168, 'h')})")
def timeseries_totals(spark, sf):
    return stats.series_totals(series(spark, sf, 168))


@query("counters", f"SELECT source, status_code, endpoint, count(*) AS total FROM ({EV}) GROUP BY ALL")
def counters(spark, sf):
    return stats.counters(parsed_lines(spark, sf), "source", "status_code", "endpoint")


@query("latency_quantiles", "SELECT event_type, round(quantile_cont(value / 100, 0.5), 9) AS p50, round(quantile_cont(value / 100, 0.95), 9) AS p95, round(quantile_cont(value / 100, 0.99), 9) AS p99 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf):
    timed = logs(spark, sf).withColumn("duration", F.col("value") / 100)
    found = stats.latency_quantiles(timed, ["event_type"], "duration")
    return found.select("event_type", *[F.round(c, 9).alias(c) for c in ("p50", "p95", "p99")])


@query("latency_quantiles_all", "SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def latency_quantiles_all(spark, sf):
    found = stats.latency_quantiles(derived.read_table(spark, sf, "lineitem"), [], "l_extendedprice")
    return found.select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("request_rate_1m", f"SELECT date_trunc('minute', t) AS minute, source, round(count(*) / 60.0::DOUBLE, 9) AS rate FROM ({EV}) GROUP BY ALL")
def request_rate_1m(spark, sf):
    found = stats.request_rates(parsed_lines(spark, sf), "timestamp", "source")
    return found.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "source", F.round("rate", 9).alias("rate"))


@query("risk_histogram", f"SELECT CAST(least(floor(risk_score * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM {A} GROUP BY 1")
def risk_histogram(spark, sf):
    return stats.risk_histogram(derived.anomalies(spark, sf))


@query("rows_last_hour", f"SELECT count(*) AS anomalies FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 1 HOUR")
def rows_last_hour(spark, sf):
    return stats.count_anomalies(derived.anomalies(spark, sf), as_of(), 1)


@query("matrix_summary", "SELECT count(*) AS cells, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")
def matrix_summary(spark, sf):
    vectors = derived.read_table(spark, sf, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    found = stats.matrix_summary(vectors)
    return found.select("cells", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


@query("score_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS a__b, round(corr(l_quantity, l_discount), 6) AS a__c, round(corr(l_extendedprice, l_discount), 6) AS b__c FROM lineitem")
def score_correlation(spark, sf):
    items = derived.read_table(spark, sf, "lineitem").selectExpr("l_quantity AS a", "l_extendedprice AS b", "l_discount AS c")
    found = stats.score_correlation(items, ("a", "b", "c"))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("above_p99", "SELECT event_id, event_type, value, round(p, 9) AS limit FROM events JOIN (SELECT event_type, quantile_cont(value, 0.99) AS p FROM events GROUP BY event_type) USING (event_type) WHERE value > p")
def above_p99(spark, sf):
    events = derived.read_table(spark, sf, "events").select("event_id", "event_type", "value")
    return stats.above_quantile(events, ["event_type"], "value").withColumn("limit", F.round("limit", 9))


@query("anomaly_feedback", f"SELECT a.id, a.risk_score, f.id AS feedback_id, f.is_false_positive FROM {A} a LEFT JOIN {FB} f ON f.anomaly_id = a.id")
def anomaly_feedback(spark, sf):
    found = feedback.with_feedback(derived.anomalies(spark, sf), derived.feedback(spark, sf))
    return found.select("id", "risk_score", "feedback_id", "is_false_positive")


MISSED = "anomaly_id % 7 = 0"


@query(
    "feedback_quality",
    f"""SELECT a.event_type, count(*) AS judged, count_if(f.is_false_positive AND NOT {MISSED})::BIGINT AS false_positives, count_if({MISSED})::BIGINT AS false_negatives,
 round(1 - count_if(f.is_false_positive AND NOT {MISSED}) / nullif(count_if(NOT {MISSED}), 0), 9) AS precision FROM {A} a JOIN {FB} f ON f.anomaly_id = a.id GROUP BY 1""",
)
def feedback_quality(spark, sf):
    """A seventh of the judged rows were no alarms, but should have been."""
    judged = derived.feedback(spark, sf).withColumn("is_false_negative", F.expr(MISSED))
    found = feedback.feedback_quality(derived.anomalies(spark, sf), judged, "event_type")
    return found.withColumn("precision", F.round("precision", 9))


RETRAIN = "SELECT count(*) FILTER (created_at > TIMESTAMP '{0}') AS new_feedback, count(*) FILTER (created_at > TIMESTAMP '{0}') >= {3} OR {1} >= TIMESTAMP '{0}' + INTERVAL 24 HOUR AS due FROM {2}"


@query("retrain_trigger", RETRAIN.format("2024-01-30 12:00:00", AS_OF, f"(SELECT * FROM {FB} WHERE created_at <= {AS_OF})", 100))
def retrain_trigger(spark, sf):
    trained = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return feedback.retrain_due(derived.feedback(spark, sf), trained, as_of())


@query("retrain_trigger_by_age", RETRAIN.format("2024-01-20 00:00:00", AS_OF, f"(SELECT * FROM {FB} WHERE created_at <= {AS_OF})", 10**9))
def retrain_trigger_by_age(spark, sf):
    """The last training is old, and no feedback would be enough."""
    trained = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return feedback.retrain_due(derived.feedback(spark, sf), trained, as_of(), min_new=10**9)


@query("related_logs", f"""WITH a AS (SELECT id, source_ip, username, CAST(floor(epoch(created_at)) AS BIGINT) AS s FROM {A} WHERE is_anomaly), l AS (SELECT id, source_ip, username, CAST(floor(epoch(created_at)) AS BIGINT) AS s FROM ({LOGS}))
 SELECT a.id, count(*) AS related_logs FROM a JOIN l ON l.s BETWEEN a.s - 300 AND a.s + 300 AND (a.source_ip = l.source_ip OR a.username = l.username) GROUP BY a.id""")
def related_logs(spark, sf):
    found = derived.anomalies(spark, sf).filter("is_anomaly")
    return counting.related_logs(found, logs(spark, sf), 300).select("id", "related_logs")


@query("related_logs_detail", f"""WITH a AS (SELECT * FROM {A} WHERE id = 77) SELECT a.id AS anomaly_id, l.id, l.source_ip, l.username FROM a JOIN ({LOGS}) l
 ON abs(CAST(floor(epoch(a.created_at)) AS BIGINT) - CAST(floor(epoch(l.created_at)) AS BIGINT)) <= 7200 AND (a.source_ip = l.source_ip OR a.username = l.username)""")
def related_logs_detail(spark, sf):
    one = history.anomaly_detail(derived.anomalies(spark, sf), 77)
    return counting.related_logs_of(one, logs(spark, sf), 7200).select("anomaly_id", "id", "source_ip", "username")


@query("similar_anomalies", f"SELECT id, count(*) OVER (PARTITION BY event_type, source_ip ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS similar_anomalies FROM {A} WHERE is_anomaly")
def similar_anomalies(spark, sf):
    found = derived.anomalies(spark, sf).filter("is_anomaly")
    return counting.similar_before(found, ["event_type", "source_ip"]).select("id", "similar_anomalies")


@query("user_baseline", """WITH d AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_id, value FROM events)
 SELECT e.event_id, count(p.value) AS baseline_n, CASE WHEN stddev_pop(p.value) > 1e-7 THEN round((any_value(e.value) - avg(p.value)) / stddev_pop(p.value), 4) END AS deviation FROM d e LEFT JOIN d p ON p.user_id = e.user_id AND p.day BETWEEN e.day - 7 AND e.day - 1 GROUP BY e.event_id""")
def user_baseline(spark, sf):
    found = counting.user_baseline(derived.read_table(spark, sf, "events"), "user_id", "value", "ts")
    return found.select("event_id", F.coalesce("baseline_n", F.lit(0)).alias("baseline_n"), F.when(F.col("baseline_std") > 1e-4, F.round("deviation", 4)).alias("deviation"))


@query("anomalies_with_alerts", f"SELECT a.id, a.risk_score, l.id AS alert_id, l.delivery_status FROM {A} a LEFT JOIN {AL} l ON l.anomaly_id = a.id")
def anomalies_with_alerts(spark, sf):
    found = alerting.with_alerts(derived.anomalies(spark, sf), derived.alerts(spark, sf))
    return found.select("id", "risk_score", "alert_id", "delivery_status")


@query("anomalies_filtered_page", f"SELECT id, risk_score FROM {A} WHERE created_at >= {AS_OF} - INTERVAL 240 HOUR AND risk_score >= 0.5 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def anomalies_filtered_page(spark, sf):
    found = history.find_anomalies(derived.anomalies(spark, sf), as_of(), 240, 0.5, limit=20, offset=40)
    return found.select("id", "risk_score")


@query("alerts_missing", f"SELECT id, risk_score FROM {A} WHERE risk_score >= 0.8 AND id NOT IN (SELECT anomaly_id FROM {AL})")
def alerts_missing(spark, sf):
    return alerting.unalerted(derived.anomalies(spark, sf), derived.alerts(spark, sf)).select("id", "risk_score")


@query("alert_rows", f"SELECT id AS anomaly_id, risk_level AS severity, upper(risk_level[1]) || risk_level[2:] || ' risk: ' || event_type AS title, printf('%s from %s (risk %.3f)', event_type, source_ip, risk_score) AS message, 'pending' AS delivery_status FROM {A} WHERE risk_score >= 0.6")
def alert_rows(spark, sf):
    return alerting.alert_rows(derived.anomalies(spark, sf)).select("anomaly_id", "severity", "title", "message", "delivery_status")


@query("alert_cooldown", f"""WITH RECURSIVE s AS (SELECT source_ip, CAST(floor(epoch(created_at)) AS BIGINT) AS sec, min(id) AS id FROM {A} WHERE is_anomaly GROUP BY ALL),
 sent AS (SELECT source_ip, min(sec) AS sec FROM s GROUP BY source_ip UNION ALL SELECT source_ip, nxt FROM (SELECT t.source_ip, (SELECT min(sec) FROM s WHERE s.source_ip = t.source_ip AND s.sec >= t.sec + 3600) AS nxt FROM sent t) WHERE nxt IS NOT NULL)
 SELECT s.id, s.source_ip FROM sent JOIN s USING (source_ip, sec)""")
def alert_cooldown(spark, sf):
    found = derived.anomalies(spark, sf).filter("is_anomaly")
    return cooldown.cooldown(found, ["source_ip"], wait_sec=3600).select("id", "source_ip")


@query("alert_cooldown_5m", f"""WITH RECURSIVE s AS (SELECT source_ip, event_type, CAST(floor(epoch(created_at)) AS BIGINT) AS sec, min(id) AS id FROM {A} WHERE is_anomaly GROUP BY ALL),
 sent AS (SELECT source_ip, event_type, min(sec) AS sec FROM s GROUP BY ALL UNION ALL SELECT source_ip, event_type, nxt FROM (SELECT t.source_ip, t.event_type, (SELECT min(sec) FROM s WHERE s.source_ip = t.source_ip AND s.event_type = t.event_type AND s.sec >= t.sec + 300) AS nxt FROM sent t) WHERE nxt IS NOT NULL)
 SELECT s.id, s.source_ip, s.event_type FROM sent JOIN s USING (source_ip, event_type, sec)""")
def alert_cooldown_5m(spark, sf):
    found = derived.anomalies(spark, sf).filter("is_anomaly")
    return cooldown.cooldown(found, ["source_ip", "event_type"]).select("id", "source_ip", "event_type")


@query("alert_hourly_cap", f"SELECT id, risk_score FROM {A} WHERE risk_score >= 0.4 QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', created_at) ORDER BY risk_score DESC, created_at, id) <= 5")
def alert_hourly_cap(spark, sf):
    return alerting.hourly_cap(derived.anomalies(spark, sf).filter("risk_score >= 0.4"), 5).select("id", "risk_score")


@query("rate_limit_violations", f"WITH e AS ({EV}) SELECT source_ip, date_trunc('minute', t) AS window_start, count(*) AS requests, 'minute' AS period FROM e GROUP BY 1, 2 HAVING count(*) > 3 UNION ALL SELECT source_ip, date_trunc('hour', t), count(*), 'hour' FROM e GROUP BY 1, 2 HAVING count(*) > 8")
def rate_limit_violations(spark, sf):
    found = alerting.rate_violations(parsed_lines(spark, sf), per_minute=3, per_hour=8)
    return found.select("source_ip", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "period")


@query("alert_lifecycle", f"SELECT delivery_status, count(*) AS alerts, round(avg(epoch(acknowledged_at) - epoch(created_at)), 4) AS seconds_to_acknowledge FROM {AL} GROUP BY 1")
def alert_lifecycle(spark, sf):
    return alerting.lifecycle(derived.alerts(spark, sf)).withColumn("seconds_to_acknowledge", F.round("seconds_to_acknowledge", 4))


@query("incident_sessions", f"""WITH s AS (SELECT *, CAST(floor(epoch(created_at)) AS BIGINT) AS sec FROM {A} WHERE is_anomaly), g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= 1800 THEN 1 ELSE 0 END AS gap FROM s WINDOW w AS (PARTITION BY source_ip ORDER BY sec, id)),
 n AS (SELECT *, sum(gap) OVER (PARTITION BY source_ip ORDER BY sec, id) AS session FROM g)
 SELECT source_ip, min(sec) AS started, max(sec) AS ended, count(*) AS events, max(risk_score) AS max_risk, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM n GROUP BY source_ip, session""")
def incident_sessions(spark, sf):
    found = alerting.incidents(derived.anomalies(spark, sf).filter("is_anomaly"))
    return found.select("source_ip", F.unix_seconds("session_start").alias("started"), F.unix_seconds("session_end").alias("ended"), "events", "max_risk", F.array_join("event_types", ",").alias("event_types"))


@query("retention_prune", f"SELECT id FROM ({LOGS}) WHERE CAST(created_at AS DATE) >= CAST({AS_OF} AS DATE) - 10")
def retention_prune(spark, sf):
    return sinks.within_retention(logs(spark, sf), as_of(), 10, "created_at").select("id")


@query("pii_scrub", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g'), '\\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\\b|\\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?', '<ip>', 'g'), '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b', '<ip>', 'g')) AS scrubbed, sha2_key AS pseudonym FROM (SELECT doc_id, text, sha256('salt' || CAST(doc_id AS VARCHAR)) AS sha2_key FROM documents)")
def pii_scrub(spark, sf):
    docs = derived.read_table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(sinks.mask(F.col("text"))).alias("scrubbed"), sinks.pseudonym(F.col("doc_id"), "salt").alias("pseudonym"))
