"""Streams over the whole tables, run to the end; the SQL asks the batch question."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.models import trained
from checks.parsing import now
from checks.registry import ANOMALIES, AS_OF, LINES, query
from checks.windows import EV, parsed_lines, state_sql
from logvane.operators.keyed_time import KEYED_FEATURES
from logvane.plans import history
from logvane.plans.alerting import risk_decision
from logvane.session import shared_checkpoint_dir, stage
from logvane.sources import derived, ingest
from logvane.sources.store import Store
from logvane.streaming import pipeline, state


def fresh(spark, name):
    return f"{shared_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame) -> DataFrame:
    """The rows as a stream of files."""
    spark = df.sparkSession
    path = fresh(spark, "stream-in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run until all input is read, into a Parquet table."""
    spark = stream.sparkSession
    path = fresh(spark, "stream-out")
    started = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", fresh(spark, "stream-state"))
        .format("parquet")
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def parsed_stream(spark, sf):
    return as_stream(parsed_lines(spark, sf).select("line_id", "timestamp", "source_ip", "event_type", "success", "endpoint"))


CLOSING = "window_start < TIMESTAMP '2030-01-01'"


def closed_stream(spark, sf):
    """The parsed events, then the closing row as a file of its own."""
    events = parsed_lines(spark, sf).select("line_id", "timestamp", "source_ip", "event_type", "success", "endpoint")
    path = fresh(spark, "stream-in")
    events.write.parquet(path)
    end = events.limit(1).withColumn("timestamp", F.lit("2034-01-01").cast("timestamp"))
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


@query("stream_parse", f"SELECT line_id, source_ip, event_type, round(ln(1 + bytes_sent), 6) AS bytes_transferred, CAST(hour(t) AS INTEGER) AS hour_of_day FROM ({EV})")
def stream_parse(spark, sf):
    lines = as_stream(derived.lines(spark, sf))
    found = pipeline.parse_stream(lines, now(), F.lit(2024)).select("line_id", "source_ip", "event_type", "bytes_transferred", "hour_of_day")
    return run(found).withColumn("bytes_transferred", F.round("bytes_transferred", 6))


@query("stream_tumbling", f"SELECT date_trunc('hour', t) AS window_start, event_type, count(*) AS n FROM ({EV}) GROUP BY ALL")
def stream_tumbling(spark, sf):
    found = run(pipeline.tumbling_counts(closed_stream(spark, sf), by=("event_type",))).filter(CLOSING)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_sliding",
    f"SELECT to_timestamp(w * 30)::TIMESTAMP AS window_start, source_ip, count(*) AS requests, count_if(NOT success)::BIGINT AS failures FROM (SELECT *, unnest([sec // 30 - 1, sec // 30]) AS w FROM ({EV})) GROUP BY w, source_ip",
)
def stream_sliding(spark, sf):
    found = run(pipeline.sliding_rates(closed_stream(spark, sf), "60 seconds", "30 seconds")).filter(CLOSING)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY source_ip ORDER BY sec, line_id) > 1800 THEN 1 ELSE 0 END AS gap FROM ({EV})), s AS (SELECT *, sum(gap) OVER (PARTITION BY source_ip ORDER BY sec, line_id) AS session FROM g)
 SELECT source_ip, min(sec) AS started, max(sec) + 1800 AS ended, count(*) AS events FROM s GROUP BY source_ip, session""",
)
def stream_sessions(spark, sf):
    found = run(pipeline.sessions(closed_stream(spark, sf))).filter("session_start < TIMESTAMP '2030-01-01'")
    return found.select("source_ip", F.unix_seconds("session_start").alias("started"), F.unix_seconds("session_end").alias("ended"), "events")


def in_files(rows: DataFrame, ts: str, late: Column | None = None, files: int = 4) -> tuple[str, DataFrame]:
    """Rows by time in several files, one micro-batch each; `late` rows of a file's last 500 seconds come one later."""
    spark = rows.sparkSession
    path = fresh(spark, "stream-in")
    rows = stage(rows)  # every file reads them all
    steps = ", ".join(f"{k / files}D" for k in range(1, files))
    bounds = rows.select(F.expr(f"percentile_approx(unix_seconds({ts}), array({steps}))")).first()[0]
    sec = F.unix_seconds(ts)
    at = sum(F.when(sec > b, 1).otherwise(0) for b in bounds)
    if late is not None:
        at += sum(F.when(late & (sec <= b) & (sec > b - 500), 1).otherwise(0) for b in bounds)
    placed = rows.withColumn("_file", at)
    for k in range(files):  # a stream of files reads them by the time of writing
        placed.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def late_stream(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Every seventh row may come one micro-batch late, within the watermark's delay; a closing row ends the stream."""
    path, stream = in_files(events, ts, F.col("line_id") % 7 == 0)
    end = events.limit(1).withColumn(ts, F.lit("2034-01-01").cast("timestamp"))
    end.coalesce(1).write.mode("append").parquet(path)
    return stream


EVENT_COLUMNS = ("line_id", "timestamp", "source_ip", "event_type", "success", "endpoint")


@query("stream_exact_features", state_sql("extended"))
def stream_exact_features(spark, sf):
    """Five micro-batches, rows late by one of them, gaps of more than an hour, the default delay."""
    events = parsed_lines(spark, sf).select(*EVENT_COLUMNS)
    found = run(state.keyed_features_stream(late_stream(events), auth_rule="extended")).where("timestamp < TIMESTAMP '2030-01-01'")
    rounded = {c: F.round(c, 9) for c in ("requests_per_second", "failed_auth_rate")}
    return found.withColumns(rounded).select("line_id", *KEYED_FEATURES)


@query(
    "stream_session_store",
    """SELECT id, source_ip, session_id, session_data, coalesce(sec < lag(sec) OVER (PARTITION BY source_ip, session_id ORDER BY sec, id) + 3600, false) AS already_live FROM
 (SELECT event_id AS id, '10.0.' || CAST(user_id % 2 AS VARCHAR) || '.' || CAST(user_id % 8 AS VARCHAR) AS source_ip, 'user' || CAST(user_id % 40 AS VARCHAR) AS session_id, event_type AS session_data, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)""",
)
def stream_session_store(spark, sf):
    """Puts by time, in several micro-batches."""
    puts = derived.read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.expr("'10.0.' || cast(user_id % 2 as string) || '.' || cast(user_id % 8 as string)").alias("source_ip"),
        F.expr("'user' || cast(user_id % 40 as string)").alias("session_id"),
        F.col("event_type").alias("session_data"),
        F.col("ts").cast("timestamp").alias("stored_at"),
    )
    return run(state.session_store(in_files(puts, "stored_at")[1]))


@query("stream_dedup", f"SELECT line_id, source FROM ({LINES})")
def stream_dedup(spark, sf):
    lines = derived.lines(spark, sf)
    twice = lines.unionByName(lines).join(parsed_lines(spark, sf).select("line_id", "timestamp"), "line_id")
    return run(pipeline.without_resent(as_stream(twice))).select("line_id", "source")


ROWS = "id long, created_at timestamp, source_ip string, username string, event_type string, risk_score double, risk_level string, is_anomaly boolean"


def stored_anomalies(spark, sf) -> DataFrame:
    found = derived.anomalies(spark, sf)
    return found.select("id", F.col("created_at").cast("timestamp").alias("created_at"), "source_ip", "username", "event_type", "risk_score", "risk_level", "is_anomaly")


def score_batch(batch: DataFrame, _: int) -> DataFrame:
    found = batch.drop("is_anomaly", "risk_level").withColumn("_d", risk_decision())
    return found.select("id", "created_at", "source_ip", "username", "event_type", "risk_score", "_d.risk_level", "_d.is_anomaly")


def stores(spark):
    """Empty tables of logs and of anomalies."""
    return [Store(spark, fresh(spark, name), ROWS) for name in ("logs", "anomalies")]


@query(
    "stream_dual_sink",
    f"""WITH s AS (SELECT id, created_at, source_ip, username, event_type, risk_score, CAST(created_at AS DATE) AS event_date, is_anomaly, risk_level FROM ({ANOMALIES}))
 SELECT 'logs' AS name, * FROM s UNION ALL SELECT 'anomalies', * FROM s WHERE is_anomaly""",
)
def stream_dual_sink(spark, sf):
    """Every row of both tables, as several micro-batches have stored them."""
    logs, found = stores(spark)
    stream = in_files(stored_anomalies(spark, sf), "created_at")[1]
    pipeline.store_both(stream, score_batch, logs, found, fresh(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    both = [store.read().select(F.lit(name).alias("name"), "*") for name, store in (("logs", logs), ("anomalies", found))]
    return both[0].unionByName(both[1]).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


CHANGED = "CASE WHEN id % 11 = 0 THEN 0.99 ELSE risk_score END"


@query(
    "store_and_read",
    f"""WITH s AS (SELECT id, created_at, source_ip, is_anomaly, CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN {CHANGED} ELSE risk_score END AS risk_score FROM ({ANOMALIES}) WHERE created_at >= TIMESTAMP '2024-01-03'),
 page AS (SELECT id, risk_score FROM s WHERE created_at >= {AS_OF} - INTERVAL 48 HOUR ORDER BY created_at DESC, id DESC LIMIT 20)
 SELECT 'series' AS part, date_trunc('hour', created_at)::VARCHAR AS item, count(*) AS n, round(sum(risk_score), 4) AS total FROM s GROUP BY ALL
 UNION ALL SELECT 'page', id::VARCHAR, 1, round(risk_score, 4) FROM page
 UNION ALL SELECT 'pull', '', count(*), round(sum(risk_score), 4) FROM s WHERE risk_score <= 0.6 AND created_at >= {AS_OF} - INTERVAL 10 DAY
 UNION ALL SELECT 'address', source_ip, count(*), round(sum(risk_score), 4) FROM s WHERE created_at >= {AS_OF} - INTERVAL 5 DAY GROUP BY source_ip""",
)
def store_and_read(spark, sf):
    """Half of the rows stored by a stream, half as a batch that is repeated; then compacted, updated, pruned, read."""
    rows = stored_anomalies(spark, sf)
    logs, found = stores(spark)
    stream = in_files(rows.where("id % 2 = 0"), "created_at")[1]
    pipeline.store_both(stream, score_batch, logs, found, fresh(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        logs.write(rows.where("id % 2 = 1"), "by hand")
    logs.compact()
    changes = logs.read().where("id % 11 = 0 AND created_at >= TIMESTAMP '2024-01-20'")
    logs.update(changes.select("id", F.lit(0.99).alias("risk_score")))
    logs.prune(dt.date(2024, 1, 31), 28)
    stored = logs.read()
    as_of = F.lit(derived.AS_OF).cast("timestamp")
    total = [F.count("*").alias("n"), F.round(F.sum("risk_score"), 4).alias("total")]
    hour = F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH:mm:ss")
    page = history.logs_page(stored, as_of, 20, hours=48)
    pull = history.training_pull(stored, as_of, days=10, min_samples=1)
    recent = history.since(stored, as_of, 120)
    parts = [
        stored.groupBy(hour.alias("item")).agg(*total).select(F.lit("series").alias("part"), "*"),
        page.select(F.lit("page").alias("part"), F.col("id").cast("string").alias("item"), F.lit(1).cast("long").alias("n"), F.round("risk_score", 4).alias("total")),
        pull.agg(*total).select(F.lit("pull").alias("part"), F.lit("").alias("item"), "*"),
        recent.groupBy("source_ip").agg(*total).select(F.lit("address").alias("part"), F.col("source_ip").alias("item"), "n", "total"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "stream_cooldown",
    f"""WITH RECURSIVE s AS (SELECT source_ip, event_type, CAST(floor(epoch(created_at)) AS BIGINT) AS sec, min(id) AS id FROM ({ANOMALIES}) WHERE is_anomaly GROUP BY ALL),
 sent AS (SELECT source_ip, event_type, min(sec) AS sec FROM s GROUP BY ALL UNION ALL SELECT source_ip, event_type, nxt FROM (SELECT t.source_ip, t.event_type, (SELECT min(sec) FROM s WHERE s.source_ip = t.source_ip AND s.event_type = t.event_type AND s.sec >= t.sec + 7200) AS nxt FROM sent t) WHERE nxt IS NOT NULL)
 SELECT s.id, s.source_ip, s.event_type FROM sent JOIN s USING (source_ip, event_type, sec)""",
)
def stream_cooldown(spark, sf):
    rows = derived.anomalies(spark, sf).filter("is_anomaly").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return run(state.cooldown_stream(as_stream(rows), 7200))


@query("stream_late_rows", "SELECT count(*) AS late_rows FROM events WHERE ts IS NOT NULL")
def stream_late_rows(spark, sf):
    """All events after a row of 2034, in files of their own; a watermark drops rows one batch after it moved."""
    events = derived.read_table(spark, sf, "events").where("ts is not null").select(
        F.col("event_id").cast("string").alias("log_line"), F.col("event_id").alias("line_id"), F.col("ts").cast("timestamp").alias("timestamp")
    )
    path = fresh(spark, "stream-in")
    end = events.limit(1).withColumn("timestamp", F.lit("2034-01-01").cast("timestamp"))
    for _ in range(2):
        end.coalesce(1).write.mode("append").parquet(path)
    events.repartition(4).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    late = pipeline.LateRows()
    spark.streams.addListener(late)
    try:
        started = (
            pipeline.without_resent(stream)
            .writeStream.option("checkpointLocation", fresh(spark, "stream-state"))
            .format("noop")
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
        found = late.count(started)
    finally:
        spark.streams.removeListener(late)
    return spark.createDataFrame([(found,)], "late_rows long")


def grow(files, path: str, parts: list[str], first: int, last: int | None = None) -> None:
    """Append bytes of the written parts, one after the other, to the log at `path`."""
    ahead = first
    left = None if last is None else last - first
    with files.open_append_stream(path) as log:
        for part in parts:
            with files.open_input_file(part) as text:
                skip = min(ahead, text.size())
                text.seek(skip)
                ahead -= skip
                while block := text.read(1 << 20 if left is None else min(left, 1 << 20)):
                    log.write(block)
                    left = None if left is None else left - len(block)


@query(
    "tail_lines",
    f"SELECT CASE source WHEN 'firewall' THEN 'syslog' ELSE source END AS source, log_line, count(*) AS n FROM ({LINES}) GROUP BY ALL",
)
def tail_lines(spark, sf):
    """All lines, written to three logs that grow, are rotated and are truncated between runs of the stream."""
    folder = fresh(spark, "tailed")
    written, logs, out, saved = (f"{folder}/{x}" for x in ("parts", "logs", "out", "state"))
    rounds = F.pmod("line_id", F.lit(5))
    lines = derived.lines(spark, sf).select("log_line", "source", rounds.alias("round"))
    lines.write.partitionBy("source", "round").text(written)
    files, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    names = {"auth": "auth.log", "nginx": "nginx/access.log", "firewall": "messages"}
    files.create_dir(f"{root}/logs/nginx")

    def parts(source: str, at: int) -> list[str]:
        found = files.get_file_info(pafs.FileSelector(f"{root}/parts/source={source}/round={at}", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.startswith("part-"))

    def run_on() -> None:
        stream = ingest.tail_lines(spark, logs, splitBytes=str(1 << 18)).select("source", "log_line")
        writer = stream.writeStream.option("checkpointLocation", saved).format("parquet").option("path", out)
        writer.trigger(availableNow=True).start().awaitTermination()

    for at in range(5):
        for source, name in names.items():
            log = f"{root}/logs/{name}"
            if at == 2:  # renamed with nothing unread; the next round goes to a new file
                files.move(log, f"{log}.1")
            if at == 4 and source == "auth":  # copied away and truncated
                files.copy_file(log, f"{log}-20240131")
                files.open_output_stream(log).close()
            half = sum(f.size for f in files.get_file_info(parts(source, at))) // 2
            grow(files, log, parts(source, at), 0, half)
            if at != 1:  # in the second round the stream stops inside a line
                grow(files, log, parts(source, at), half)
        run_on()
        if at == 1:
            for source, name in names.items():
                half = sum(f.size for f in files.get_file_info(parts(source, at))) // 2
                grow(files, f"{root}/logs/{name}", parts(source, at), half)
    run_on()
    found = spark.read.schema("source string, log_line string").parquet(out)
    return found.groupBy("source", "log_line").agg(F.count("*").alias("n"))


CLOSING_LINE = '10.0.0.1 - - [01/Jan/2034:00:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "-"'


def scored_stream(spark, sf, models) -> tuple[Store, Store]:
    """All lines by time in several micro-batches, some of them late; a line of 2034 ends the stream."""
    times = parsed_lines(spark, sf).select("line_id", "timestamp")
    lines = derived.lines(spark, sf).join(times, "line_id")
    path, stream = in_files(lines, "timestamp", F.col("line_id") % 7 == 0)
    end = lines.limit(1).select(
        F.lit(-1).cast("long").alias("line_id"), F.lit("nginx").alias("source"), F.lit(CLOSING_LINE).alias("log_line"), "timestamp"
    )
    end.coalesce(1).write.mode("append").parquet(path)
    folder, created = fresh(spark, "scored"), F.lit(derived.AS_OF).cast("timestamp")
    writer = pipeline.score_stream(
        stream.drop("timestamp"), models, folder, fresh(spark, "stream-state"), created, now(), F.lit(2024), auth_rule="extended"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return Store(spark, f"{folder}/logs"), Store(spark, f"{folder}/anomalies")


@query("stream_score")
def stream_score(spark, sf):
    """The rows that `score_pipeline` gives, from a stream: the stored logs, and what the anomalies add."""
    logs, anomalies = scored_stream(spark, sf, trained(spark, sf))
    found = anomalies.read().select("id", "risk_level", "confidence", "recommended_action", F.array_join("reasons", "; ").alias("reasons"))
    return logs.read().select("id", "source_ip", "event_type", "risk_score", "parsed_fields").join(found, "id", "left")
