"""Fields read out of a free-text log message, as SQL expressions."""

from __future__ import annotations

from logvane.functions.rules import contains_any, first_match, group, is_in, quote

# --- fixed values: patterns and word lists ---
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?U)\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
USER_AFTER_FOR = r"(?U)\bfor\s+(\S+)"
USER_ASSIGNED = r"(?iU)\buser=(\S+)"
NOT_A_USER = ("invalid", "illegal", "unknown")
SUCCESS_WORDS = ("accepted", "success", "granted", "allowed")
FAILURE_WORDS = ("failed", "failure", "denied", "rejected", "invalid", "illegal", "error")
SEVERITY_WORDS = (
    ("EMERGENCY", ("emergency", "panic")),
    ("CRITICAL", ("alert", "critical")),
    ("ERROR", ("error", "failed", "failure")),
    ("WARNING", ("warning", "warn")),
)


def first_ipv4(text: str) -> str:
    """First dotted quad; the cheap `contains` keeps the regex off lines without a dot."""
    return f"CASE WHEN contains({text}, '.') THEN {group(text, IPV4, 0)} END"


def first_ip(text: str) -> str:
    ipv6 = f"CASE WHEN contains({text}, ':') THEN {group(text, IPV6, 0)} END"
    return f"coalesce({first_ipv4(text)}, {ipv6})"


def username(text: str, lowered: str) -> str:
    """Name after "for", else the value of "user=" in any case."""
    named = f"CASE WHEN contains({text}, 'for') THEN {group(text, USER_AFTER_FOR)} END"
    real = f"CASE WHEN NOT {is_in('_named', NOT_A_USER)} THEN _named END"
    assigned = f"CASE WHEN contains({lowered}, 'user=') THEN {group(text, USER_ASSIGNED)} END"
    return f"coalesce({real.replace('_named', f'({named})')}, {assigned})"


def outcome(lowered: str) -> str:
    """True, false or null; words of success win over words of failure."""
    return first_match(
        [
            (contains_any(lowered, SUCCESS_WORDS), "true"),
            (contains_any(lowered, FAILURE_WORDS), "false"),
        ]
    )


def severity(lowered: str) -> str:
    return first_match(
        [(contains_any(lowered, words), quote(name)) for name, words in SEVERITY_WORDS], "'INFO'"
    )
