"""Files in and tables out."""

import datetime as dt

from pyspark.sql import functions as F

from logvane.functions import scalar
from logvane.sources import ingest, sinks
from logvane.streaming import pipeline


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_source_is_told_by_the_path(spark, tmp_path):
    write(tmp_path / "var/auth.log", "a\n")
    write(tmp_path / "var/nginx/access.log", "b\n")
    write(tmp_path / "var/messages", "c\n")
    write(tmp_path / "var/other.txt", "d\n")
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = ingest._with_source(reader.text(str(tmp_path)))
    got = {r["log_line"]: r["source"] for r in lines.collect()}
    assert got == {"a": "auth", "b": "nginx", "c": "syslog", "d": "custom"}


def test_watched_folder(spark, tmp_path):
    write(tmp_path / "in/auth.log", "Jan 22 08:14:09 s sshd[1]: Accepted password for petra from 1.2.3.4 port 5 ssh2\n")
    lines = ingest.watch_lines(spark, str(tmp_path / "in"))
    found = pipeline.parse_stream(lines).select("event_type", "source_ip")
    query = (
        found.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in rows] == [("ssh_auth_success", "1.2.3.4")]


def test_envelope_with_metadata(spark):
    body = '{"logs":[{"log_line":"x","source":"auth","metadata":{"username":"ann"}},{"log_line":"y","source":"nginx"}]}'
    rows = ingest.unpack_envelopes(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r["position"], r["log_line"], r["metadata"]) for r in rows] == [
        (0, "x", {"username": "ann"}),
        (1, "y", None),
    ]


def test_append_and_prune(spark, tmp_path):
    rows = [
        (dt.datetime(2024, 1, d, 3), f"ip{d}", d % 2 == 0, "mail a@b.org from 1.2.3.4") for d in range(1, 6)
    ]
    df = spark.createDataFrame(rows, "log_timestamp timestamp, source_ip string, is_anomaly boolean, raw_log string")
    sinks.append_logs(df, str(tmp_path / "logs"))
    sinks.append_logs(df, str(tmp_path / "logs"))
    sinks.append_anomalies(df, str(tmp_path / "anomalies"))
    logs = sinks.read_table(spark, str(tmp_path / "logs"))
    assert logs.count() == 10
    assert sinks.read_table(spark, str(tmp_path / "anomalies")).count() == 2
    kept = sinks.within_retention(logs, F.lit(dt.datetime(2024, 1, 5)), 2)
    assert {r["source_ip"] for r in kept.collect()} == {"ip3", "ip4", "ip5"}
    assert "PartitionFilters: [isnotnull(event_date" in kept._sc._jvm.PythonSQLUtils.explainString(
        kept._jdf.queryExecution(), "simple"
    )
    clean = sinks.scrub(df, "salt").first()
    assert clean["raw_log"] == "mail <email> from <ip>" and len(clean["source_ip"]) == 64


def test_entropy_of_odd_texts(spark):
    texts = [(0, None), (1, ""), (2, "aab"), (3, "aaaa"), (4, "éé"), (5, "ab" * 5000)]
    df = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    got = {r["id"]: r["e"] for r in df.select("id", scalar.entropy("t").alias("e")).collect()}
    assert got[0] == got[1] == 0 and got[3] == 0
    assert abs(got[2] - 0.9182958340544896) < 1e-12
    assert abs(got[5] - 1.0) < 1e-12
    # two bytes per character: each byte counts 2 of 2 characters
    assert got[4] == 0


def test_report_is_one_json_row(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(0.5,)], "accuracy double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["accuracy"] == 0.5
