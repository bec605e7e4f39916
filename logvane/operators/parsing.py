"""Raw lines to parsed records: one pass over the input, whatever the mix of sources.

Each line is matched once: `regexp_replace` writes all groups of its format into one
string, `split` cuts it, and every field is read from that array. The formats of all
sources share the array, so mixed input needs one scan and no union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions import clock, events, text
from logvane.functions.rules import first_match, is_in, quote, with_once
from logvane.schema import PARSED

SOURCES = ("syslog", "nginx", "auth", "firewall")
SYSLOG_SOURCES = ("syslog", "auth")
CUT = "\x01"


# every format writes its groups into the same slots, so a field is one array access
SLOTS = (
    "format",
    "time",
    "hostname",
    "process",
    "pid",
    "message",
    "ip",
    "user",
    "method",
    "endpoint",
    "protocol",
    "status",
    "bytes",
    "referer",
    "agent",
    "source_port",
    "destination",
    "destination_port",
    "in",
    "out",
    "priority",
    "version",
    "msgid",
    "level",
    "connection",
)


@dataclass(frozen=True)
class LineFormat:
    """A whole-line pattern and the slot of each of its groups (None: not kept)."""

    name: str
    pattern: str
    groups: tuple[str | None, ...]

    def capture(self, line: str) -> str:
        """Array over SLOTS; an array of one element when the line does not match."""
        number = {name: i + 1 for i, name in enumerate(self.groups) if name}
        marked = CUT.join(
            self.name if name == "format" else f"${number[name]}" if name in number else ""
            for name in SLOTS
        )
        each = ", ".join(
            quote(self.name)
            if name == "format"
            else f"regexp_extract({line}, {quote(self.pattern)}, {number[name]})"
            if name in number
            else "''"
            for name in SLOTS
        )
        pattern = quote(self.pattern)
        # a line that holds the cut mark itself takes the slow way
        return f"""CASE WHEN NOT contains({line}, '{CUT}')
            THEN split(regexp_replace({line}, {pattern}, {quote(marked)}), '{CUT}')
            WHEN {line} RLIKE {pattern} THEN array({each}) ELSE array({line}) END"""


# --- fixed values: line formats ---
RFC3164 = LineFormat(
    "rfc3164",
    r"(?dU)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?\s*:\s*(.+)$",
    ("time", "hostname", "process", "pid", "message"),
)
RFC5424 = LineFormat(
    "rfc5424",
    r"(?dU)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)$",
    ("priority", "version", "time", "hostname", "process", "pid", "msgid", None, "message"),
)
NGINX_ACCESS = LineFormat(
    "nginx_access",
    r"(?dU)^([\d\.]+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"
    r'"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"(?s:.*)$',
    (
        "ip",
        "user",
        "time",
        "method",
        "endpoint",
        "protocol",
        "status",
        "bytes",
        "referer",
        "agent",
    ),
)
NGINX_ERROR = LineFormat(
    "nginx_error",
    r"(?dU)^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#\d+:\s+(?:\*(\d+)\s+)?(.+)$",
    ("time", "level", "pid", "connection", "message"),
)
IPTABLES = LineFormat(
    "iptables",
    r"(?dU)^(?s:.*?)IN=(\S*)\s+OUT=(\S*)\s+.*?SRC=([\d\.]+)\s+DST=([\d\.]+)\s+"
    r".*?PROTO=(\S+)\s+(?:SPT=(\d+)\s+)?(?:DPT=(\d+))?(?s:.*)$",
    ("in", "out", "ip", "destination", "protocol", "source_port", "destination_port"),
)
FORMATS = (RFC3164, RFC5424, NGINX_ACCESS, NGINX_ERROR, IPTABLES)
SYSLOG_PREFIX = r"(?U)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
YEAR_FIRST = r"(?U)^\d{4}/"
TIME_CUT = r"[\s/:]+"


def slot(name: str) -> str:
    """A captured field; '' counts as absent."""
    return f"nullif(get(_f, {SLOTS.index(name)}), '')"


def is_a(*formats: LineFormat) -> str:
    return is_in("_fmt", [f.name for f in formats])


def match_lines(df: DataFrame, formats: tuple[LineFormat, ...] = FORMATS) -> DataFrame:
    """Add `_f` (captured fields) and `_fmt` (format name, `generic` or `error`)."""
    from_syslog = is_in("source", SYSLOG_SOURCES)
    tagged = f"({from_syslog} AND startswith(log_line, '<'))"
    attempts = [
        (tagged, RFC5424),
        (from_syslog, RFC3164),
        # an error line starts with its year, which no access line does
        (f"source = 'nginx' AND log_line RLIKE {quote(YEAR_FIRST)}", NGINX_ERROR),
        ("source = 'nginx'", NGINX_ACCESS),
        ("source = 'firewall'", IPTABLES),
    ]
    tried = first_match(
        [(condition, f.capture("log_line")) for condition, f in attempts if f in formats],
        "array(log_line)",
    )
    name = first_match(
        [
            (f"size(_f) = {len(SLOTS)}", "get(_f, 0)"),
            (f"{is_in('source', SOURCES)} AND NOT {tagged}", "'generic'"),
        ],
        "'error'",
    )
    return with_once(with_once(df, {"_f": tried}), {"_fmt": name})


def _stamp(df: DataFrame) -> DataFrame:
    """Add `timestamp` and `parse_status`; an impossible date makes the line unparseable."""
    prefix = f"regexp_extract(log_line, {quote(SYSLOG_PREFIX)}, 1)"
    read = first_match(
        [
            (is_a(RFC3164, IPTABLES), clock.syslog_time("_t", "_year", "_now")),
            (is_a(NGINX_ACCESS), clock.access_time("_time", "_t")),
            (is_a(NGINX_ERROR), clock.error_time("_t")),
            (is_a(RFC5424), clock.iso_time("_time", "_now")),
            ("_fmt = 'generic'", "_now"),
        ]
    )
    timed = with_once(df, {"_time": first_match([(is_a(IPTABLES), prefix)], slot("time"))})
    timed = with_once(timed, {"_t": f"split(trim(_time), {quote(TIME_CUT)})"})
    timed = with_once(timed, {"_ts": read})
    status = first_match(
        [("_ts IS NULL", "'error'"), ("_fmt = 'generic'", "'generic'")], "'ok'"
    )
    # a broken line keeps its text and its first address, and nothing else
    return with_once(
        timed,
        {
            "parse_status": status,
            "timestamp": "coalesce(_ts, _now)",
            "_f": "CASE WHEN _ts IS NOT NULL THEN _f END",
            "_fmt": "CASE WHEN _ts IS NOT NULL THEN _fmt ELSE 'error' END",
        },
    )


def _parse(df: DataFrame, formats: tuple[LineFormat, ...], now: Column, year: Column) -> DataFrame:
    syslog, access = is_a(RFC3164, RFC5424), is_a(NGINX_ACCESS)
    unparsed = "_fmt = 'error'"

    stamped = _stamp(match_lines(df.withColumns({"_now": now, "_year": year}), formats))
    fields = {
        "message": f"CASE WHEN _fmt = 'generic' THEN log_line ELSE {slot('message')} END",
        "process_name": f"CASE WHEN {is_a(NGINX_ERROR)} THEN 'nginx' ELSE {slot('process')} END",
        "endpoint": slot("endpoint"),
        "protocol": slot("protocol"),
        "method": slot("method"),
        "status_code": f"try_cast({slot('status')} AS int)",
        "destination_port": f"try_cast({slot('destination_port')} AS int)",
        "_upper": f"CASE WHEN {is_a(IPTABLES)} THEN upper(log_line) END",
        "_priority": f"try_cast({slot('priority')} AS bigint)",
        "_user": slot("user"),
    }
    lowered = {
        "status_message": f"CASE WHEN {is_a(IPTABLES)} THEN {events.firewall_action('_upper')} END",
        "_process": "lower(process_name)",
        "_message": "lower(message)",
        "_path": "lower(endpoint)",
    }
    event = first_match(
        [
            (unparsed, "'unknown'"),
            (
                "source = 'auth'",
                events.auth_event(
                    "coalesce(process_name, '')", "coalesce(_process, '')", "_message"
                ),
            ),
            ("_fmt = 'generic'", "concat(source, '_generic')"),
            (syslog, events.syslog_event("_process", "_message")),
            (access, events.http_event("method", "endpoint", "_path", "status_code")),
            (
                is_a(IPTABLES),
                events.firewall_event("status_message", "protocol", "destination_port"),
            ),
        ],
        "'nginx_error'",
    )
    success = first_match(
        [
            (syslog, text.outcome("_message")),
            (access, "status_code >= 200 AND status_code < 400"),
            (is_a(NGINX_ERROR), "false"),
            (is_a(IPTABLES), "status_message = 'ACCEPT'"),
        ]
    )
    severity = first_match(
        [
            (is_a(RFC3164), text.severity("_message")),
            (is_a(RFC5424), events.priority_severity("_priority")),
            (access, events.http_severity("status_code")),
            (is_a(NGINX_ERROR), events.nginx_severity(slot("level"))),
            (is_a(IPTABLES), "if(status_message = 'ACCEPT', 'INFO', 'WARNING')"),
        ]
    )
    source_ip = first_match(
        [
            (unparsed, text.first_ipv4("log_line")),
            (syslog, text.first_ip("message")),
            (is_a(NGINX_ERROR), text.first_ipv4("message")),
        ],
        slot("ip"),
    )
    packet_extra = (
        f"map('in_interface', {slot('in')}, 'out_interface', {slot('out')},"
        " 'action', status_message)"
    )
    extra = first_match(
        [
            (is_a(RFC5424), f"map('version', {slot('version')}, 'msgid', {slot('msgid')})"),
            (is_a(NGINX_ERROR), f"map('connection_id', {slot('connection')})"),
            (is_a(IPTABLES), packet_extra),
        ],
        "cast(map() AS map<string,string>)",
    )
    values = {
        "timestamp": "timestamp",
        "raw_log": "log_line",
        "source_ip": source_ip,
        "source_port": f"try_cast({slot('source_port')} AS int)",
        "destination_ip": slot("destination"),
        "destination_port": "destination_port",
        "event_type": event,
        "method": "method",
        "endpoint": "endpoint",
        "protocol": "protocol",
        "status_code": "status_code",
        "status_message": "status_message",
        "success": success,
        "username": first_match(
            [(syslog, text.username("message", "_message"))], "nullif(_user, '-')"
        ),
        "bytes_sent": f"coalesce(try_cast({slot('bytes')} AS bigint), 0)",
        "bytes_received": "0",
        "hostname": slot("hostname"),
        "process_name": "process_name",
        # a process id that is no number is dropped by the cast
        "process_id": f"try_cast({slot('pid')} AS int)",
        "user_agent": f"nullif({slot('agent')}, '-')",
        "referer": f"nullif({slot('referer')}, '-')",
        "payload": f"CASE WHEN {unparsed} THEN log_line END",
        "message": "message",
        "severity": severity,
        "facility": first_match(
            [
                (is_a(RFC3164), "'syslog'"),
                (is_a(RFC5424), events.facility_name("_priority")),
            ]
        ),
        "tags": f"if({unparsed} OR source <> 'auth', array(), array('authentication'))",
        "extra": extra,
    }
    passed = [f"`{c}`" for c in df.columns if c not in PARSED.fieldNames() and c != "parse_status"]
    ready = with_once(with_once(stamped, fields), lowered)
    typed = {
        f.name: f"cast({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()})"
        for f in PARSED.fields
    }
    return with_once(ready, typed).selectExpr(
        *passed, "parse_status", *[f"`{f.name}`" for f in PARSED.fields]
    )


def _now(ingest_ts: Column | None) -> Column:
    return F.current_timestamp() if ingest_ts is None else ingest_ts


CustomParser = Callable[[DataFrame], DataFrame]
_custom_parsers: dict[str, CustomParser] = {}


def register_parser(source: str, parser: CustomParser) -> None:
    """Parse a further source with a DataFrame function; it returns the parsed columns."""
    _custom_parsers[source] = parser


def parse_logs(
    df: DataFrame,
    ingest_ts: Column | None = None,
    year: Column | None = None,
    mode: str = "permissive",
) -> DataFrame:
    """Parse lines of any source.

    `permissive` keeps unparseable lines as minimal records, `dropmalformed` drops them.
    `ingest_ts` stands for "now"; `year` completes syslog times and defaults to its year.
    """
    now = _now(ingest_ts)
    the_year = F.year(now) if year is None else year
    own = df
    if _custom_parsers:
        # a null source is nobody's, and stays with the known formats
        foreign = F.coalesce(F.col("source").isin(*_custom_parsers), F.lit(False))
        own = df.filter(~foreign)
    parsed = _parse(own, FORMATS, now, the_year)
    for source, parser in _custom_parsers.items():
        extra = parser(df.filter(F.col("source") == source))
        parsed = parsed.unionByName(extra, allowMissingColumns=True)
    if mode == "dropmalformed":
        return parsed.filter(F.col("parse_status") != "error")
    if mode != "permissive":
        raise ValueError(f"unknown mode {mode!r}")
    return parsed


def _one_source(source: str, *formats: LineFormat):
    def parse(df: DataFrame, ingest_ts: Column | None = None, year: Column | None = None) -> DataFrame:
        lines = df.withColumn("source", F.lit(source))
        now = _now(ingest_ts)
        return _parse(lines, formats, now, F.year(now) if year is None else year)

    parse.__name__ = f"parse_{source}"
    parse.__doc__ = f"Parse every line as {source}."
    return parse


parse_syslog = _one_source("syslog", RFC3164, RFC5424)
parse_auth = _one_source("auth", RFC3164, RFC5424)
parse_nginx = _one_source("nginx", NGINX_ACCESS, NGINX_ERROR)
parse_firewall = _one_source("firewall", IPTABLES)


# --- fixed values: what stands for an absent value ---
DEFAULTS = {
    "source_ip": "unknown",
    "event_type": "unknown",
    "endpoint": "",
    "username": "",
    "user_agent": "",
    "message": "",
}


def normalize(df: DataFrame) -> DataFrame:
    """Defaults for absent values; '' and 0 count as absent."""
    columns = {
        name: F.expr(f"coalesce(nullif({name}, ''), {quote(default)})")
        for name, default in DEFAULTS.items()
    }
    columns["status_code"] = F.expr("coalesce(status_code, 0)")
    columns["payload"] = F.expr("coalesce(nullif(payload, ''), raw_log)")
    return df.withColumns(columns)


def override_with_metadata(df: DataFrame) -> DataFrame:
    """A metadata entry named like a parsed field replaces it, when it casts to its type."""
    simple = [f for f in PARSED.fields if f.name not in ("raw_log", "tags", "extra")]
    return df.withColumns(
        {
            f.name: F.expr(
                f"coalesce(try_cast(try_element_at(metadata, '{f.name}')"
                f" AS {f.dataType.simpleString()}), `{f.name}`)"
            )
            for f in simple
        }
    )


JSON_FIELDS = {f.name: f.dataType.simpleString() for f in PARSED.fields if f.name != "raw_log"}


def parse_json_app_logs(
    df: DataFrame, field_map: dict[str, str] | None = None, ingest_ts: Column | None = None
) -> DataFrame:
    """JSON application lines; `field_map` names the JSON key of each parsed field."""
    names = field_map or {}
    keys = {name: names.get(name, name) for name in JSON_FIELDS}
    layout = ", ".join(f"`{key}` string" for key in dict.fromkeys(keys.values()))
    record = df.withColumn("_json", F.from_json("log_line", layout))
    got = F.col("_json")
    broken = F.coalesce(
        reduce(lambda a, b: a & b, [got[k].isNull() for k in dict.fromkeys(keys.values())]),
        F.lit(True),
    )
    now = _now(ingest_ts)
    columns = []
    for field in PARSED.fields:
        if field.name == "raw_log":
            value = F.col("log_line")
        elif field.name in ("tags", "extra"):
            value = F.from_json(got[keys[field.name]], field.dataType)
        else:
            value = got[keys[field.name]].try_cast(field.dataType)
        if field.name == "timestamp":
            value = F.coalesce(value, now)
        if field.name == "event_type":
            value = F.when(broken, F.lit("unknown")).otherwise(value)
        columns.append(value.alias(field.name))
    passed = [c for c in df.columns if c not in PARSED.fieldNames()]
    return record.select(
        *passed, F.when(broken, "error").otherwise("ok").alias("parse_status"), *columns
    )
