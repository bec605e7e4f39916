"""Sample lines with the record each must become."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logvane.operators import parsing

NOW = dt.datetime(2026, 1, 31)
PACKET = "Jan 22 12:00:00 gate kernel: [77.5] IN=eth0 OUT= SRC=203.0.113.8 DST=10.9.0.1 "
GOLDEN = [
    (
        "auth",
        "Jan 22 08:14:09 vault7 sshd[4471]: Accepted password for petra from 172.20.3.9 port 40117 ssh2",
        dict(
            event_type="ssh_auth_success",
            username="petra",
            source_ip="172.20.3.9",
            process_id=4471,
            success=True,
            severity="INFO",
            tags=["authentication"],
            timestamp=dt.datetime(2026, 1, 22, 8, 14, 9),
        ),
    ),
    (
        "auth",
        "Jan 22 05:51:33 vault7 sshd[902]: Failed password for admin from 198.51.100.77 port 33001 ssh2",
        dict(event_type="ssh_password_failed", username="admin", success=False, severity="ERROR"),
    ),
    (
        "auth",
        "Jan 22 05:51:40 vault7 sshd[903]: Failed password for invalid user nils from 198.51.100.4 port 22 ssh2",
        dict(event_type="ssh_password_failed", username=""),
    ),
    (
        "auth",
        "Jan 22 06:20:00 vault7 sudo: petra : TTY=pts/2 ; PWD=/srv ; USER=petra ; COMMAND=/usr/bin/less notes",
        dict(event_type="sudo_command_executed", username="petra", success=None, process_id=None),
    ),
    (
        "syslog",
        "Jan 22 09:00:01 edge3 kernel: [88.125] eth1: link down",
        dict(event_type="kernel_event", hostname="edge3", success=None, source_ip="unknown"),
    ),
    (
        "syslog",
        "Jan 22 02:00:05 edge3 systemd[1]: Started nightly backup",
        dict(event_type="systemd_event", success=None, severity="INFO"),
    ),
    (
        "syslog",
        "Jan 22 07:00:00 edge3 cron[321]: (backup) CMD (/opt/jobs/rotate.sh)",
        dict(event_type="cron_event", process_id=321),
    ),
    (
        "syslog",
        "Jan 22 05:51:33 vault7 sshd[902]: Failed password for admin from 198.51.100.77 port 33001 ssh2",
        dict(event_type="ssh_auth_failed"),
    ),
    (
        "syslog",
        "<34>1 2026-01-22T12:00:00Z relay su 77 ID9 - 'su root' failed for marek on /dev/pts/3",
        dict(
            event_type="syslog_generic",
            facility="auth",
            severity="CRITICAL",
            process_id=77,
            username="marek",
            success=False,
            extra={"version": "1", "msgid": "ID9"},
            timestamp=dt.datetime(2026, 1, 22, 12),
        ),
    ),
    (
        "syslog",
        "<34>broken",
        dict(event_type="unknown", payload="<34>broken", parse_status="error", timestamp=NOW),
    ),
    (
        "syslog",
        "plain text",
        dict(event_type="syslog_generic", timestamp=NOW, parse_status="generic", message="plain text"),
    ),
    (
        "nginx",
        '203.0.113.8 - - [22/Jan/2026:12:00:00 +0000] "GET /api/orders HTTP/1.1" 200 987 "-" "curl/8.5"',
        dict(
            event_type="http_api_request",
            status_code=200,
            bytes_sent=987,
            success=True,
            referer=None,
            user_agent="curl/8.5",
            timestamp=dt.datetime(2026, 1, 22, 12),
        ),
    ),
    (
        "nginx",
        '203.0.113.8 - - [22/Jan/2026:12:00:09 +0000] "GET /login HTTP/1.1" 403 61 "-" "curl/8.5"',
        dict(event_type="http_auth_failed", severity="WARNING", success=False),
    ),
    (
        "nginx",
        '203.0.113.99 - - [22/Jan/2026:22:01:02 +0000] "GET /admin\' OR 2=2-- HTTP/1.1" 403 77 "-" "x"',
        dict(event_type="http_admin_access", endpoint="/admin'", protocol="OR 2=2-- HTTP/1.1"),
    ),
    (
        "nginx",
        'Jan 22 10:31:20 web4 nginx: 203.0.113.8 - - [22/Jan/2026:10:31:20 +0000] "GET /api/orders HTTP/1.1" 200 55',
        dict(event_type="nginx_generic", source_ip="unknown"),
    ),
    (
        "nginx",
        "2026/01/22 12:00:00 [error] 4242#0: *1717 upstream timed out while connecting",
        dict(
            event_type="nginx_error",
            severity="ERROR",
            process_id=4242,
            process_name="nginx",
            success=False,
            extra={"connection_id": "1717"},
        ),
    ),
    (
        "nginx",
        '1.1.1.1 - - [13/Jan/2026 12:00:00] "GET / HTTP/1.1" 200 1 "-" "-"',
        dict(event_type="unknown", parse_status="error", source_ip="1.1.1.1"),
    ),
    (
        "firewall",
        PACKET + "LEN=60 PROTO=TCP SPT=40001 DPT=80",
        dict(
            event_type="firewall_http_drop",
            severity="WARNING",
            success=False,
            destination_port=80,
            source_port=40001,
            extra={"in_interface": "eth0", "out_interface": None, "action": "DROP"},
        ),
    ),
    ("firewall", PACKET + "LEN=84 PROTO=ICMP", dict(event_type="firewall_generic")),
    ("firewall", PACKET + "LEN=84 PROTO=ICMP TYPE=8", dict(event_type="firewall_icmp_drop")),
    ("custom", "any 9.8.7.6", dict(event_type="unknown", parse_status="error", source_ip="9.8.7.6")),
    (
        "syslog",
        "Jan 14 10:00:60 a b: leap",
        dict(parse_status="error", event_type="unknown"),
    ),
    (
        "syslog",
        "Foo 14 10:00:00 a b: no month",
        dict(parse_status="ok", timestamp=NOW, hostname="a", process_name="b"),
    ),
    (
        "syslog",
        "Jan 14 10:00:00 a b\x01c[7]: cut \x01 mark for bob",
        dict(parse_status="ok", process_name="b\x01c", process_id=7, username="bob"),
    ),
    (
        "syslog",
        "Jan 14 10:00:00 a sshd[7]: Accepted password for x from fe80:0:0:0:0:0:0:1 port 1",
        dict(source_ip="fe80:0:0:0:0:0:0:1"),
    ),
    ("auth", "<200>1 - h app - - - for me", dict(facility="unknown_25", severity="EMERGENCY")),
]


@pytest.fixture(scope="module")
def records(spark):
    lines = spark.createDataFrame(
        [(i, s, t) for i, (s, t, _) in enumerate(GOLDEN)], "line_id long, source string, log_line string"
    )
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    parsed = parsing.normalize(parsing.parse_logs(lines, now))
    return {r["line_id"]: r.asDict() for r in parsed.collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(records, i):
    expected = GOLDEN[i][2]
    assert {k: records[i][k] for k in expected} == expected


def test_modes_and_custom_parsers(spark):
    lines = spark.createDataFrame(
        [(1, "syslog", "<1>x"), (2, "syslog", "fine"), (3, "app", '{"who":"ann"}')],
        "line_id long, source string, log_line string",
    )
    assert parsing.parse_logs(lines).count() == 3
    assert [r["line_id"] for r in parsing.parse_logs(lines, mode="dropmalformed").collect()] == [2]
    parsing.register_parser("app", lambda df: parsing.parse_json_app_logs(df, {"username": "who"}))
    try:
        rows = parsing.parse_logs(lines, mode="dropmalformed").collect()
    finally:
        parsing._custom_parsers.clear()
    assert {r["line_id"]: r["username"] for r in rows} == {2: None, 3: "ann"}
    with pytest.raises(ValueError):
        parsing.parse_logs(lines, mode="strict")


def test_filters_stay_above_the_parsing(spark):
    """A filter on a parsed field must not copy the regex work into itself."""
    lines = spark.createDataFrame([(1, "auth", "x")], "line_id long, source string, log_line string")
    parsed = parsing.parse_logs(lines).filter("event_type = 'auth_event' AND source_ip <> 'x'")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 8


def test_filters_on_raw_columns_prune_the_scan(spark, tmp_path):
    lines = spark.createDataFrame(
        [(1, "auth", "x", "2026-01-01"), (2, "nginx", "y", "2026-01-02")],
        "line_id long, source string, log_line string, event_date string",
    )
    lines.write.partitionBy("event_date").parquet(str(tmp_path / "lines"))
    stored = spark.read.parquet(str(tmp_path / "lines"))
    found = parsing.parse_logs(stored).filter("source = 'auth' AND event_date = '2026-01-01'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(source,auth)" in plan
