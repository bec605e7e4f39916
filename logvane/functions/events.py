"""Event names: ordered rules over process, message, request and port, as SQL expressions."""

from __future__ import annotations

from logvane.functions.rules import contains_any, first_match, is_in, lookup, quote

# --- fixed values: (part of the process name, any of these in the message, event) ---
SYSLOG_EVENTS = (
    ("sshd", ("failed password", "authentication failure"), "ssh_auth_failed"),
    ("sshd", ("accepted",), "ssh_auth_success"),
    ("sshd", ("invalid user",), "ssh_invalid_user"),
    ("sshd", ("connection closed",), "ssh_connection_closed"),
    ("sshd", (), "ssh_event"),
    ("sudo", ("command",), "sudo_command"),
    ("sudo", ("authentication failure",), "sudo_auth_failed"),
    ("sudo", (), "sudo_event"),
    ("kernel", (), "kernel_event"),
    ("cron", (), "cron_event"),
    ("systemd", (), "systemd_event"),
)
SSH_AUTH_EVENTS = (
    (("failed password",), "ssh_password_failed"),
    (("authentication failure",), "ssh_auth_failure"),
    (("accepted password", "accepted publickey"), "ssh_auth_success"),
    (("invalid user",), "ssh_invalid_user"),
    (("connection closed", "received disconnect"), "ssh_disconnect"),
)
SUDO_AUTH_EVENTS = (
    (("command",), "sudo_command_executed"),
    (("incorrect password", "authentication failure"), "sudo_auth_failed"),
    (("pam",), "sudo_pam_event"),
)
SU_PROCESSES = ("su", "su[")
SU_EVENTS = (
    (("authentication failure", "incorrect password"), "su_auth_failed"),
    (("session opened",), "su_session_opened"),
    (("session closed",), "su_session_closed"),
)
PAM_EVENTS = (
    (("authentication failure",), "pam_auth_failure"),
    (("session opened",), "pam_session_opened"),
    (("session closed",), "pam_session_closed"),
)
LOGIN_EVENTS = (
    (("failed", "failure"), "login_failed"),
    (("logged in", "session opened"), "login_success"),
)
ACCOUNT_EVENTS = (
    (("useradd", "userdel", "usermod", "groupadd"), "user_management"),
    (("passwd", "chpasswd", "password changed"), "password_change"),
    (("locked", "account locked"), "account_locked"),
)
AUTH_PATHS = ("/login", "/auth", "/signin", "/signup")
UPLOAD_METHODS = ("POST", "PUT")
UPLOAD_SUFFIXES = (".php", ".jsp", ".asp")
SQL_WORDS = ("union", "select", "drop", "insert", "' or ")
SCRIPT_WORDS = ("<script", "javascript:", "onerror=")
PORT_EVENTS = {
    22: "ssh",
    80: "http",
    443: "http",
    8080: "http",
    8443: "http",
    3389: "rdp",
    139: "smb",
    445: "smb",
    53: "dns",
    3306: "database",
    5432: "database",
    1433: "database",
    27017: "database",
}
NAMED_PROTOCOLS = ("icmp", "tcp", "udp")
FIREWALL_ACTIONS = ("ACCEPT", "DROP", "REJECT")
NGINX_LEVELS = {
    "emerg": "EMERGENCY",
    "alert": "ALERT",
    "crit": "CRITICAL",
    "error": "ERROR",
    "warn": "WARNING",
    "notice": "NOTICE",
    "info": "INFO",
    "debug": "DEBUG",
}
FACILITIES = {
    0: "kern",
    1: "user",
    2: "mail",
    3: "daemon",
    4: "auth",
    5: "syslog",
    6: "lpr",
    7: "news",
    8: "uucp",
    9: "cron",
    10: "authpriv",
    11: "ftp",
    16: "local0",
    17: "local1",
    18: "local2",
    19: "local3",
    20: "local4",
    21: "local5",
    22: "local6",
    23: "local7",
}
SEVERITIES = {
    0: "EMERGENCY",
    1: "ALERT",
    2: "CRITICAL",
    3: "ERROR",
    4: "WARNING",
    5: "NOTICE",
    6: "INFO",
    7: "DEBUG",
}


def _by_message(lowered: str, table, default: str) -> str:
    rules = [(contains_any(lowered, words), quote(event)) for words, event in table]
    return first_match(rules, quote(default))


def syslog_event(process: str, message: str) -> str:
    """Both arguments lower-cased."""
    rules = []
    for program, words, event in SYSLOG_EVENTS:
        condition = contains_any(process, (program,))
        if words:
            condition += " AND " + contains_any(message, words)
        rules.append((condition, quote(event)))
    return first_match(rules, "'syslog_generic'")


def auth_event(process: str, lowered_process: str, message: str) -> str:
    """`su` is matched in its own case; everything else lower-cased."""

    def about(word: str, word_in_message: str | None = None) -> str:
        condition = contains_any(lowered_process, (word,))
        if word_in_message:
            condition += " OR " + contains_any(message, (word_in_message,))
        return condition

    families = [
        (about("sshd"), _by_message(message, SSH_AUTH_EVENTS, "ssh_event")),
        (about("sudo"), _by_message(message, SUDO_AUTH_EVENTS, "sudo_event")),
        (is_in(process, SU_PROCESSES), _by_message(message, SU_EVENTS, "su_event")),
        (about("pam", "pam_"), _by_message(message, PAM_EVENTS, "pam_event")),
        (about("login", "login"), _by_message(message, LOGIN_EVENTS, "login_event")),
    ]
    return first_match(families, _by_message(message, ACCOUNT_EVENTS, "auth_event"))


def http_event(method: str, endpoint: str, path: str, status: str) -> str:
    """`path` is the lower-cased endpoint."""
    upload = f"{is_in(method, UPLOAD_METHODS)} AND {contains_any(path, UPLOAD_SUFFIXES)}"
    climbs = f"contains({endpoint}, '../') OR contains({path}, '..%2f')"
    return first_match(
        [
            (
                contains_any(path, AUTH_PATHS),
                f"if({status} < 400, 'http_auth_success', 'http_auth_failed')",
            ),
            (f"contains({path}, '/admin')", "'http_admin_access'"),
            (f"contains({path}, '/api/')", "'http_api_request'"),
            (upload, "'http_file_upload'"),
            (contains_any(path, SQL_WORDS), "'http_sql_injection_attempt'"),
            (climbs, "'http_path_traversal_attempt'"),
            (contains_any(path, SCRIPT_WORDS), "'http_xss_attempt'"),
        ],
        "'http_request'",
    )


def http_severity(status: str) -> str:
    return first_match([(f"{status} >= 500", "'ERROR'"), (f"{status} >= 400", "'WARNING'")], "'INFO'")


def nginx_severity(level: str) -> str:
    return lookup(f"lower({level})", NGINX_LEVELS, "'INFO'")


def firewall_action(upper_line: str) -> str:
    return first_match(
        [(f"contains({upper_line}, '{a}')", f"'{a}'") for a in FIREWALL_ACTIONS], "'DROP'"
    )


def firewall_event(action: str, protocol: str, port: str) -> str:
    named = f"CASE WHEN {is_in(f'lower({protocol})', NAMED_PROTOCOLS)} THEN lower({protocol}) END"
    return f"concat_ws('_', 'firewall', {lookup(port, PORT_EVENTS, named)}, lower({action}))"


def facility_name(priority: str) -> str:
    unknown = f"concat('unknown_', {priority} DIV 8)"
    return lookup(f"{priority} DIV 8", FACILITIES, unknown)


def priority_severity(priority: str) -> str:
    return lookup(f"{priority} % 8", SEVERITIES)
