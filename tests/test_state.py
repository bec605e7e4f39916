"""State features against a plain simulation, in batch and as a stream."""

import datetime as dt
import random

import pytest

from checks import streams
from logvane.operators.keyed_time import (
    KEYED_FEATURES,
    keyed_features,
    session_summary,
    unique_keys_last_hour,
)
from logvane.streaming import pipeline
from logvane.streaming.state import keyed_features_stream
from pyspark.sql import functions as F

START = 1_704_067_200
SCHEMA = "line_id long, timestamp timestamp, source_ip string, event_type string, success boolean, endpoint string"


def make_events(seed, n=600, busy=0.6):
    """Bursts, same-second events, hour borders, long gaps, and one address with most rows."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        ip = "9.9.9.9" if rng.random() < busy else f"1.1.1.{rng.randrange(3)}"
        step = rng.choice([0, 0, 1, 2, 7, 30, 59, 60, 61, 299, 300, 301, 1799, 1800, 3599, 3600, 9000])
        if rng.random() < 0.7:
            step = min(step, 30)
        clock[ip] = clock.get(ip, START + rng.randrange(5)) + step
        kind = rng.choice(["http_auth_failed", "ssh_auth_success", "http_request", "login_failed"])
        rows.append((i, clock[ip], ip, kind, rng.choice([True, False, None]), f"/{rng.randrange(6)}"))
    return rows


def simulate(rows):
    out, memory = {}, {}
    for i, sec, ip, kind, ok, endpoint in sorted(rows, key=lambda r: (r[1], r[0])):
        m = memory.setdefault(ip, {"all": set(), "auth": set(), "bad": set(), "ends": set(), "last": None, "start": sec})
        gap = None if m["last"] is None else sec - m["last"]
        if gap is not None and gap >= 3600:
            m["ends"] = set()
        if gap is not None and gap >= 1800:
            m["start"] = sec

        def count(name, width):
            return sum(1 for s in m[name] if sec - width <= s <= sec)

        attempts = count("auth", 300)
        out[i] = (
            float(count("auth", 60)),
            count("all", 60) / 60,
            count("bad", 300) / attempts if attempts else 0.0,
            len(m["ends"]),
            float(gap or 0),
            float(sec - m["start"]),
        )
        m["all"].add(sec)
        if "auth" in kind or "login" in kind:
            m["auth"].add(sec)
            if not ok:
                m["bad"].add(sec)
        m["ends"].add(endpoint)
        m["last"] = sec
    return out


def frame(spark, rows):
    data = [(i, dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None), *rest) for i, s, *rest in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_simulation(spark, seed):
    rows = make_events(seed)
    found = keyed_features(frame(spark, rows)).select("line_id", *KEYED_FEATURES).collect()
    expected = simulate(rows)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[1:]) == pytest.approx(expected[r["line_id"]]), r["line_id"]


def streamed(spark, folder, batches, **options):
    """Features of a stream that gets these rows, one list per micro-batch, and then a row of long after."""
    last = max(r[1] for rows in batches for r in rows)
    for rows in [*batches, [(-1, last + 90_000, "closing", "http_request", True, "/")]]:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    schema = frame(spark, batches[0]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    writer = keyed_features_stream(stream, **options).writeStream.outputMode("append")
    writer = writer.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True)
    writer.format("parquet").option("path", str(folder / "out")).start().awaitTermination()
    found = spark.read.parquet(str(folder / "out")).collect()
    return {r["line_id"]: tuple(r[n] for n in KEYED_FEATURES) for r in found}


def test_stream_equals_simulation(spark, tmp_path):
    """Three micro-batches; rows of the last ten minutes of each may come with the next, in any order."""
    rows = make_events(4)
    ordered, draw = sorted(rows, key=lambda r: (r[1], r[0])), random.Random(9)
    batches = [ordered[k * 200 : (k + 1) * 200] for k in range(3)]
    for before, after in zip(batches, batches[1:]):
        late = [r for r in before if r[1] > before[-1][1] - 500 and r is not before[-1] and draw.random() < 0.5]
        before[:] = [r for r in before if r not in late]
        after += late
    for batch in batches:
        draw.shuffle(batch)
    found, expected = streamed(spark, tmp_path, batches), simulate(rows)
    assert len(found) == len(rows)
    for i, features in found.items():
        assert features == pytest.approx(expected[i]), i


def test_late_rows_see_what_was_before_them(spark, tmp_path):
    """A row of second 500 that comes after one of 1 000 is idle since 100, and knows no endpoint of 1 000."""
    def row(i, sec, endpoint):
        return (i, START + sec, "1.1.1.1", "http_request", True, endpoint)

    batches = [[row(1, 100, "/a"), row(2, 1000, "/b")], [row(3, 500, "/c"), row(4, 1010, "/a")]]
    found = streamed(spark, tmp_path, batches)
    assert [found[i][4] for i in (1, 2, 3, 4)] == [0.0, 500.0, 400.0, 10.0]
    assert [found[i][3] for i in (1, 2, 3, 4)] == [0, 2, 1, 3]


def test_absences_show_unless_the_address_expires(spark, tmp_path):
    def row(i, sec):
        return (i, START + sec, None, "http_request", True, "/a")

    batches = [[row(1, 0)], [row(2, 21_600)], [row(3, 25_000)], [row(4, 28_600)]]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    kept = streamed(spark, tmp_path / "a", batches)
    assert [kept[i][3:] for i in (2, 3, 4)] == [(0, 21_600.0, 0.0), (1, 3400.0, 0.0), (0, 3600.0, 0.0)]
    gone = streamed(spark, tmp_path / "b", batches, activity_ttl_sec=3600)
    assert [gone[i][3:] for i in (2, 3, 4)] == [(0, 0.0, 0.0), (1, 3400.0, 0.0), (0, 0.0, 0.0)]


def test_no_window_over_a_whole_address(spark):
    """Every window that sees seconds or events is cut by hour, second or session as well."""
    plan = keyed_features(frame(spark, make_events(5, 20)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("], [")[1:] for line in plan.splitlines() if "Window [" in line]
    assert windows
    for keys, order, *_ in windows:
        assert "," in keys or "_hour" in order, (keys, order)


def test_unique_addresses(spark):
    rng = random.Random(7)
    events = [(START + rng.randrange(4 * 3600), f"ip{rng.randrange(30)}") for _ in range(400)]
    data = [(dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None), ip) for s, ip in events]
    found = unique_keys_last_hour(spark.createDataFrame(data, "timestamp timestamp, source_ip string"))
    for r in found.select(F.unix_seconds("minute").alias("m"), "unique_ips_last_hour").collect():
        seen = {ip for s, ip in events if r["m"] - 3600 <= s < r["m"]}
        assert r["unique_ips_last_hour"] == len(seen)


def test_session_summary(spark):
    rows = make_events(8)
    found = session_summary(
        frame(spark, rows), ["source_ip"], "timestamp", 1800, {"bad": F.count_if(~F.col("success"))}, {"bad": "sum"}
    ).collect()
    expected = {}
    for ip in {r[2] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[2] == ip), key=lambda r: r[1]):
            if last is None or r[1] - last >= 1800:
                start = r[1]
            n, bad = expected.get((ip, start), (0, 0))
            expected[ip, start] = (n + 1, bad + (r[4] is False))
            last = r[1]
    got = {
        (r["source_ip"], int(r["session_start"].replace(tzinfo=dt.UTC).timestamp())): (r["events"], r["bad"])
        for r in found
    }
    assert got == expected


def test_late_rows_of_more_batches_than_recent_progress_keeps(spark, tmp_path):
    schema = "line_id long, timestamp timestamp, log_line string"
    days = ["2024-01-02", "2024-01-05", *["2024-01-01"] * 6]
    for k, day in enumerate(days):
        row = spark.createDataFrame([(k, dt.datetime.fromisoformat(day), f"line {k}")], schema)
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late, kept = pipeline.LateRows(), "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, "2")
    spark.streams.addListener(late)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        writer = pipeline.without_resent(stream).writeStream.format("noop").trigger(availableNow=True)
        query = writer.option("checkpointLocation", str(tmp_path / "state")).start()
        query.awaitTermination()
        assert len(query.recentProgress) <= 2
        assert late.count(query) == 6
    finally:
        spark.streams.removeListener(late)
        spark.conf.unset(kept)


def test_the_files_of_a_stream_come_from_rows_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(k):
        seen.add(1)
        return k

    noted = F.udf(note, "long").asNondeterministic()
    rows = spark.range(400).select(noted("id").alias("line_id"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"))
    path, _ = streams.in_files(rows, "timestamp")
    assert seen.value == 400
    assert sorted(r[0] for r in spark.read.parquet(path).select("line_id").collect()) == list(range(400))
