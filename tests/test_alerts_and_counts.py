"""Cooldown, running totals, quantiles and range counts against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.operators import counting, evaluate, prefix
from logvane.operators.cooldown import cooldown
from logvane.plans import history, stats
from logvane.sources import sinks

START = 1_704_067_200


def at(sec):
    return dt.datetime.fromtimestamp(sec, dt.UTC).replace(tzinfo=None)


def test_cooldown_over_weeks(spark):
    rng = random.Random(2)
    rows, sec = [], START
    for i in range(3000):
        sec += rng.choice([0, 1, 40, 150, 299, 300, 301, 900, 40_000])
        rows.append((i, sec, "hot" if rng.random() < 0.8 else f"k{rng.randrange(3)}"))
    df = spark.createDataFrame([(i, at(s), k) for i, s, k in rows], "id long, created_at timestamp, k string")
    got = {r["id"] for r in cooldown(df, ["k"]).collect()}
    last, expected = {}, set()
    for i, s, k in sorted(rows, key=lambda r: (r[1], r[0])):
        if k not in last or s >= last[k] + 300:
            expected.add(i)
            last[k] = s
    assert got == expected


def test_running_totals_and_buckets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b"]), rng.random() ** 3, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, x double, v long")
    placed = prefix.even_buckets(df, "x", 16)
    got = prefix.running_totals(placed, ["k"], "_bucket", ["x"], {"t": "v"}).collect()
    for r in got:
        assert r["t"] == sum(v for _, k, x, v in rows if k == r["k"] and x < r["x"])


def test_exact_quantiles_with_ties(spark):
    rng = np.random.default_rng(6)
    values = {"a": rng.integers(0, 30, 997).astype(float), "b": rng.normal(size=313), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double")
    wanted = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in stats.exact_quantiles(df, ["k"], "x", wanted, pieces=8).collect():
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values[r["k"]], q))


def test_top_per_group_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 10 else "cold", (i * 7919) % 1009) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, x long")
    got = prefix.top_per_group(df, ["k"], [F.desc("x"), F.asc("id")], 25).collect()
    for key in ("hot", "cold"):
        expected = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))[:25]
        assert {r["id"] for r in got if r["k"] == key} == {r[0] for r in expected}


def test_around_counts_like_a_join(spark):
    rng = random.Random(9)
    logs = [(i, START + rng.randrange(20_000), f"ip{rng.randrange(2)}", f"u{rng.randrange(3)}") for i in range(500)]
    df = spark.createDataFrame([(i, at(s), ip, u) for i, s, ip, u in logs], "id long, created_at timestamp, source_ip string, username string")
    got = {r["id"]: r["related_logs"] for r in counting.related_logs(df, df, 120).collect()}
    for i, s, ip, u in logs:
        expected = sum(1 for _, t, q, v in logs if abs(t - s) <= 120 and (q == ip or v == u))
        assert got[i] == expected


def test_training_pull_wants_enough_rows(spark):
    df = spark.createDataFrame([(1, at(START), 0.1)], "id long, created_at timestamp, risk_score double")
    with pytest.raises(ValueError):
        history.training_pull(df, F.lit(at(START + 60)))


def test_leakage_raises(spark):
    a = spark.createDataFrame([(1,), (2,)], "x long")
    b = spark.createDataFrame([(2,), (3,)], "x long")
    with pytest.raises(ValueError):
        evaluate.assert_no_overlap({"a": a, "b": b}, ["x"])
    evaluate.assert_no_overlap({"a": a, "c": spark.createDataFrame([(9,)], "x long")}, ["x"])


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "is_anomaly boolean")
    assert stats.batch_summary(empty).first().asDict() == {
        "total_logs": 0,
        "anomalies_detected": 0,
        "anomaly_rate": 0.0,
    }


def test_rows_without_a_key_are_kept(spark):
    rows = [
        (k, at(START + 400 * k), None if k % 2 else "10.0.0.1", "u" if k % 3 else None, k % 4 / 4)
        for k in range(12)
    ]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, source_ip string, username string, risk_score double")
    assert counting.similar_before(df, ["source_ip"]).filter("source_ip is null").count() == 6
    assert counting.related_logs(df, df, 10).count() == 12
    assert counting.user_baseline(df, "username", "risk_score").count() == 12
    assert cooldown(df, ["source_ip"], wait_sec=300).count() == 12
    assert cooldown(df, ["source_ip"], wait_sec=0).count() == 12
    assert stats.exact_quantiles(df, ["username"], "risk_score", {"p50": 0.5}).count() == 2
    labelled = df.withColumnRenamed("username", "label")
    assert evaluate.stratified_split(labelled).count() == 12


def test_small_spread_around_a_large_value_keeps_its_digits(spark):
    rows = [(k, at(START + 86_400 * (k // 4)), "u", 1e9 + k % 2) for k in range(16)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, username string, value double")
    found = counting.user_baseline(df, "username", "value").filter("baseline_n > 0").collect()
    assert len(found) == 12 and all(abs(r.baseline_std - 0.5) < 1e-6 for r in found)


def test_top_of_each_group_with_a_map_column(spark):
    df = spark.range(20).selectExpr("id", "id % 2 as k", "map('a', id) as extra")
    assert prefix.top_per_group(df, ["k"], [F.desc("id")], 3).count() == 6


def test_scrub_leaves_no_address_user_or_mail(spark):
    df = spark.createDataFrame(
        [("10.1.2.3", "petra", "petra from 10.1.2.3 and 2001:db8::7 or fe80:1:2:3:4:5:6:7 wrote a@b.example 12:30:45")],
        "source_ip string, username string, log_line string",
    )
    text = sinks.scrub(df, "salt").first()["log_line"]
    assert not any(x in text for x in ("petra", "10.1.2.3", "2001:db8", "fe80", "a@b"))
    assert text.endswith("12:30:45")
