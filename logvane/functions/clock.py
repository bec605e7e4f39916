"""Log times as SQL expressions. All are read as UTC; null means an impossible date.

`parts` is the time cut at blanks, slashes and colons.
"""

from __future__ import annotations

from logvane.functions.rules import quote

# --- fixed values ---
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
ACCESS_TIME = r"^\s*\d{1,2}/\w{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}(\s|$)"


def _number(parts: str, index: int) -> str:
    return f"try_cast(get({parts}, {index}) AS int)"


def _month(name: str) -> str:
    """1..12, or null when `name` is no three-letter month."""
    return f"nullif(array_position(array({', '.join(map(quote, MONTHS))}), {name}), 0)"


def _instant(year: str, month: str, day: str, parts: str, first: int) -> str:
    hour, minute, second = [_number(parts, first + i) for i in range(3)]
    made = f"try_make_timestamp({year}, {month}, {day}, {hour}, {minute}, {second})"
    # a sixtieth second would roll over to the next minute instead of being refused
    return f"CASE WHEN {second} < 60 THEN {made} END"


def syslog_time(parts: str, year: str, now: str) -> str:
    """`Mon d HH:MM:SS`; the ingest time for any other month name."""
    month = _month(f"get({parts}, 0)")
    at = _instant(year, month, _number(parts, 1), parts, 2)
    return f"CASE WHEN {month} IS NULL THEN {now} ELSE {at} END"


def iso_time(text: str, now: str) -> str:
    """ISO 8601, else the ingest time; a date that looks right but is none counts as absent."""
    read = f"CASE WHEN {text} RLIKE {quote(ISO_TIME)} THEN try_to_timestamp({text}) END"
    return f"coalesce({read}, {now})"


def access_time(text: str, parts: str) -> str:
    """`dd/Mon/yyyy:HH:MM:SS zone`; the zone is ignored."""
    month = _month(f"initcap(get({parts}, 1))")
    at = _instant(_number(parts, 2), month, _number(parts, 0), parts, 3)
    return f"CASE WHEN {text} RLIKE {quote(ACCESS_TIME)} THEN {at} END"


def error_time(parts: str) -> str:
    """`yyyy/mm/dd HH:MM:SS`."""
    return _instant(_number(parts, 0), _number(parts, 1), _number(parts, 2), parts, 3)
