"""Parsing in DuckDB SQL: one CASE per field, written against each format separately."""

from __future__ import annotations

from checks.registry import AS_OF

P3164 = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?\s*:\s*(.+)$"
P5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+(.+)$"
ACCESS = (
    r'^([\d\.]+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\d+)\s+'
    r'"([^"]*)"\s+"[^"]*"'
)
AGENT = (
    r'^[\d\.]+\s+-\s+\S+\s+\[[^\]]+\]\s+"\S+\s+\S+\s+[^"]+"\s+\d+\s+\d+\s+"[^"]*"\s+"([^"]*)"'
)
NERROR = (
    r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#\d+:\s+(?:\*(\d+)\s+)?(.+)$"
)
PACKET = (
    r"IN=(\S*)\s+OUT=(\S*)\s+.*?SRC=([\d\.]+)\s+DST=([\d\.]+)\s+.*?PROTO=(\S+)\s+"
    r"(?:SPT=(\d+)\s+)?(?:DPT=(\d+))?"
)
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _g(pattern: str, index: int, column: str = "log_line") -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {index}), '')"


def _by_fmt(**cases: str) -> str:
    return "CASE fmt " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END"


SYSLOG_EVENT = f"""CASE
 WHEN contains(lp,'sshd') THEN CASE WHEN {_has('lm', 'failed password', 'authentication failure')} THEN 'ssh_auth_failed' WHEN contains(lm,'accepted') THEN 'ssh_auth_success' WHEN contains(lm,'invalid user') THEN 'ssh_invalid_user' WHEN contains(lm,'connection closed') THEN 'ssh_connection_closed' ELSE 'ssh_event' END
 WHEN contains(lp,'sudo') THEN CASE WHEN contains(lm,'command') THEN 'sudo_command' WHEN contains(lm,'authentication failure') THEN 'sudo_auth_failed' ELSE 'sudo_event' END
 WHEN contains(lp,'kernel') THEN 'kernel_event' WHEN contains(lp,'cron') THEN 'cron_event' WHEN contains(lp,'systemd') THEN 'systemd_event' ELSE 'syslog_generic' END"""
AUTH_EVENT = f"""CASE
 WHEN contains(lp,'sshd') THEN CASE WHEN contains(lm,'failed password') THEN 'ssh_password_failed' WHEN contains(lm,'authentication failure') THEN 'ssh_auth_failure' WHEN {_has('lm', 'accepted password', 'accepted publickey')} THEN 'ssh_auth_success' WHEN contains(lm,'invalid user') THEN 'ssh_invalid_user' WHEN {_has('lm', 'connection closed', 'received disconnect')} THEN 'ssh_disconnect' ELSE 'ssh_event' END
 WHEN contains(lp,'sudo') THEN CASE WHEN contains(lm,'command') THEN 'sudo_command_executed' WHEN {_has('lm', 'incorrect password', 'authentication failure')} THEN 'sudo_auth_failed' WHEN contains(lm,'pam') THEN 'sudo_pam_event' ELSE 'sudo_event' END
 WHEN process IN ('su','su[') THEN CASE WHEN {_has('lm', 'authentication failure', 'incorrect password')} THEN 'su_auth_failed' WHEN contains(lm,'session opened') THEN 'su_session_opened' WHEN contains(lm,'session closed') THEN 'su_session_closed' ELSE 'su_event' END
 WHEN contains(lp,'pam') OR contains(lm,'pam_') THEN CASE WHEN contains(lm,'authentication failure') THEN 'pam_auth_failure' WHEN contains(lm,'session opened') THEN 'pam_session_opened' WHEN contains(lm,'session closed') THEN 'pam_session_closed' ELSE 'pam_event' END
 WHEN contains(lp,'login') OR contains(lm,'login') THEN CASE WHEN {_has('lm', 'failed', 'failure')} THEN 'login_failed' WHEN {_has('lm', 'logged in', 'session opened')} THEN 'login_success' ELSE 'login_event' END
 WHEN {_has('lm', 'useradd', 'userdel', 'usermod', 'groupadd')} THEN 'user_management'
 WHEN {_has('lm', 'passwd', 'password changed')} THEN 'password_change'
 WHEN contains(lm,'locked') THEN 'account_locked' ELSE 'auth_event' END"""
HTTP_EVENT = f"""CASE
 WHEN {_has('le', '/login', '/auth', '/signin', '/signup')} THEN CASE WHEN status_code < 400 THEN 'http_auth_success' ELSE 'http_auth_failed' END
 WHEN contains(le,'/admin') THEN 'http_admin_access' WHEN contains(le,'/api/') THEN 'http_api_request'
 WHEN method IN ('POST','PUT') AND {_has('le', '.php', '.jsp', '.asp')} THEN 'http_file_upload'
 WHEN {_has('le', 'union', 'select', 'drop', 'insert')} OR contains(le, chr(39) || ' or ') THEN 'http_sql_injection_attempt'
 WHEN contains(endpoint,'../') OR contains(le,'..%2f') THEN 'http_path_traversal_attempt'
 WHEN {_has('le', '<script', 'javascript:', 'onerror=')} THEN 'http_xss_attempt' ELSE 'http_request' END"""
PACKET_EVENT = """'firewall_' || CASE
 WHEN dpt = 22 THEN 'ssh_' WHEN dpt IN (80,443,8080,8443) THEN 'http_' WHEN dpt = 3389 THEN 'rdp_' WHEN dpt IN (139,445) THEN 'smb_' WHEN dpt = 53 THEN 'dns_' WHEN dpt IN (3306,5432,1433,27017) THEN 'database_'
 WHEN lower(protocol) IN ('icmp','tcp','udp') THEN lower(protocol) || '_' ELSE '' END || lower(act)"""
FACILITY = """CASE WHEN pri // 8 BETWEEN 0 AND 11 THEN ['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp'][CAST(pri // 8 + 1 AS INTEGER)]
 WHEN pri // 8 BETWEEN 16 AND 23 THEN 'local' || CAST(pri // 8 - 16 AS VARCHAR) ELSE 'unknown_' || CAST(pri // 8 AS VARCHAR) END"""


def parsed(lines: str, year: str = "2024", mode: str = "permissive") -> str:
    """SQL text of the parsed and normalised lines, one row per line."""
    keep = "" if mode == "permissive" else "WHERE parse_status <> 'error'"
    return f"""
SELECT line_id, source, log_line, parse_status, ts AS "timestamp", coalesce(ip, 'unknown') AS source_ip, source_port, dst AS destination_ip, dpt AS destination_port,
 event_type, method, coalesce(endpoint, '') AS endpoint, protocol, coalesce(status_code, 0) AS status_code, act AS status_message, success, coalesce(username, '') AS username,
 bytes_sent, hostname, process AS process_name, pid AS process_id, coalesce(agent, '') AS user_agent, referer, log_line AS payload, coalesce(message, '') AS message, severity, facility,
 CASE WHEN source = 'auth' AND fmt <> 'error' THEN 'authentication' ELSE '' END AS tag,
 CASE WHEN fmt = 'rfc5424' THEN 'version=' || version || ',msgid=' || msgid WHEN fmt = 'nginx_error' THEN 'connection_id=' || coalesce(conn, '') WHEN fmt = 'iptables' THEN 'in_interface=' || coalesce(iface_in, '') || ',out_interface=' || coalesce(iface_out, '') || ',action=' || act ELSE '' END AS extra
FROM (SELECT *,
  CASE WHEN fmt = 'error' THEN 'unknown' WHEN source = 'auth' THEN {AUTH_EVENT} WHEN fmt = 'generic' THEN source || '_generic' WHEN fmt IN ('rfc3164','rfc5424') THEN {SYSLOG_EVENT} WHEN fmt = 'nginx_access' THEN {HTTP_EVENT} WHEN fmt = 'nginx_error' THEN 'nginx_error' ELSE {PACKET_EVENT} END AS event_type,
  CASE WHEN fmt IN ('rfc3164','rfc5424') THEN CASE WHEN {_has('lm', 'accepted', 'success', 'granted', 'allowed')} THEN true WHEN {_has('lm', 'failed', 'failure', 'denied', 'rejected', 'invalid', 'illegal', 'error')} THEN false END
   WHEN fmt = 'nginx_access' THEN status_code BETWEEN 200 AND 399 WHEN fmt = 'nginx_error' THEN false WHEN fmt = 'iptables' THEN act = 'ACCEPT' END AS success,
  CASE fmt WHEN 'rfc3164' THEN CASE WHEN {_has('lm', 'emergency', 'panic')} THEN 'EMERGENCY' WHEN {_has('lm', 'alert', 'critical')} THEN 'CRITICAL' WHEN {_has('lm', 'error', 'failed', 'failure')} THEN 'ERROR' WHEN contains(lm, 'warn') THEN 'WARNING' ELSE 'INFO' END
   WHEN 'rfc5424' THEN ['EMERGENCY','ALERT','CRITICAL','ERROR','WARNING','NOTICE','INFO','DEBUG'][CAST(pri % 8 + 1 AS INTEGER)]
   WHEN 'nginx_access' THEN CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END
   WHEN 'nginx_error' THEN CASE lower(level) WHEN 'emerg' THEN 'EMERGENCY' WHEN 'alert' THEN 'ALERT' WHEN 'crit' THEN 'CRITICAL' WHEN 'error' THEN 'ERROR' WHEN 'warn' THEN 'WARNING' WHEN 'notice' THEN 'NOTICE' WHEN 'debug' THEN 'DEBUG' ELSE 'INFO' END
   WHEN 'iptables' THEN CASE WHEN act = 'ACCEPT' THEN 'INFO' ELSE 'WARNING' END END AS severity,
  CASE fmt WHEN 'rfc3164' THEN 'syslog' WHEN 'rfc5424' THEN {FACILITY} END AS facility,
  CASE WHEN fmt IN ('rfc3164','rfc5424') THEN CASE WHEN nullif(for_user, '') IS NOT NULL AND for_user NOT IN ('invalid','illegal','unknown') THEN for_user ELSE nullif(regexp_extract(message, '(?i)\\buser=(\\S+)', 1), '') END ELSE nullif(access_user, '-') END AS username,
  CASE WHEN fmt = 'error' THEN nullif(regexp_extract(log_line, '{IPV4}'), '') WHEN fmt IN ('rfc3164','rfc5424','nginx_error') THEN nullif(regexp_extract(message, '{IPV4}'), '') ELSE raw_ip END AS ip
 FROM (SELECT *, lower(process0) AS lp, lower(coalesce(message, '')) AS lm, lower(endpoint) AS le, regexp_extract(message, '\\bfor\\s+(\\S+)', 1) AS for_user, CASE WHEN process0 = '' THEN NULL ELSE process0 END AS process
 FROM (SELECT line_id, source, log_line, fmt, coalesce(ts0, {AS_OF}) AS ts, CASE fmt WHEN 'error' THEN 'error' WHEN 'generic' THEN 'generic' ELSE 'ok' END AS parse_status,
  coalesce({_by_fmt(rfc3164=_g(P3164, 3), rfc5424=_g(P5424, 5), nginx_error="'nginx'")}, '') AS process0,
  {_by_fmt(rfc3164=_g(P3164, 5), rfc5424=_g(P5424, 8), nginx_error=_g(NERROR, 5), generic='log_line')} AS message,
  {_by_fmt(rfc3164=_g(P3164, 2), rfc5424=_g(P5424, 4))} AS hostname,
  TRY_CAST({_by_fmt(rfc3164=_g(P3164, 4), rfc5424=_g(P5424, 6), nginx_error=_g(NERROR, 3))} AS INTEGER) AS pid,
  TRY_CAST({_by_fmt(rfc5424=_g(P5424, 1))} AS BIGINT) AS pri, {_by_fmt(rfc5424=_g(P5424, 2))} AS version, {_by_fmt(rfc5424=_g(P5424, 7))} AS msgid,
  {_by_fmt(nginx_error=_g(NERROR, 2))} AS level, {_by_fmt(nginx_error=_g(NERROR, 4))} AS conn,
  {_by_fmt(nginx_access=_g(ACCESS, 1), iptables=_g(PACKET, 3))} AS raw_ip, {_by_fmt(nginx_access=_g(ACCESS, 2))} AS access_user,
  {_by_fmt(nginx_access=_g(ACCESS, 4))} AS method, {_by_fmt(nginx_access=_g(ACCESS, 5))} AS endpoint, {_by_fmt(nginx_access=_g(ACCESS, 6), iptables=_g(PACKET, 5))} AS protocol,
  CAST({_by_fmt(nginx_access=_g(ACCESS, 7))} AS INTEGER) AS status_code, coalesce(CAST({_by_fmt(nginx_access=_g(ACCESS, 8))} AS BIGINT), 0) AS bytes_sent,
  nullif({_by_fmt(nginx_access=_g(ACCESS, 9))}, '-') AS referer, nullif({_by_fmt(nginx_access=_g(AGENT, 1))}, '-') AS agent,
  CAST({_by_fmt(iptables=_g(PACKET, 6))} AS INTEGER) AS source_port, CAST({_by_fmt(iptables=_g(PACKET, 7))} AS INTEGER) AS dpt, {_by_fmt(iptables=_g(PACKET, 4))} AS dst,
  {_by_fmt(iptables=_g(PACKET, 1))} AS iface_in, {_by_fmt(iptables=_g(PACKET, 2))} AS iface_out,
  CASE WHEN fmt = 'iptables' THEN CASE WHEN contains(upper(log_line), 'ACCEPT') THEN 'ACCEPT' WHEN contains(upper(log_line), 'DROP') THEN 'DROP' WHEN contains(upper(log_line), 'REJECT') THEN 'REJECT' ELSE 'DROP' END END AS act
 FROM (SELECT line_id, source, log_line, ts0, CASE WHEN fmt0 IN ('rfc3164','rfc5424','nginx_access','nginx_error','iptables') AND ts0 IS NULL THEN 'error' ELSE fmt0 END AS fmt
 FROM (SELECT *, CASE fmt0 WHEN 'rfc3164' THEN try_strptime('{year} ' || regexp_replace(regexp_extract(log_line, '{P3164}', 1), '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')
   WHEN 'rfc5424' THEN coalesce(try_strptime(regexp_extract(log_line, '{P5424}', 3), '%Y-%m-%dT%H:%M:%SZ'), {AS_OF})
   WHEN 'nginx_access' THEN try_strptime(regexp_extract(regexp_extract(log_line, '{ACCESS}', 3), '^\\S+'), '%d/%b/%Y:%H:%M:%S')
   WHEN 'nginx_error' THEN try_strptime(regexp_extract(log_line, '{NERROR}', 1), '%Y/%m/%d %H:%M:%S')
   WHEN 'iptables' THEN CASE WHEN regexp_matches(log_line, '^\\w{{3}}\\s+\\d{{1,2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN try_strptime('{year} ' || regexp_replace(regexp_extract(log_line, '^(\\w{{3}}\\s+\\d{{1,2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}})', 1), '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') ELSE {AS_OF} END END AS ts0
 FROM (SELECT line_id, source, log_line,
  CASE WHEN source IN ('syslog','auth') AND starts_with(log_line, '<') THEN CASE WHEN regexp_matches(log_line, '{P5424}') THEN 'rfc5424' ELSE 'error' END
   WHEN source IN ('syslog','auth') THEN CASE WHEN regexp_matches(log_line, '{P3164}') THEN 'rfc3164' ELSE 'generic' END
   WHEN source = 'nginx' THEN CASE WHEN regexp_matches(log_line, '{ACCESS}') THEN 'nginx_access' WHEN regexp_matches(log_line, '{NERROR}') THEN 'nginx_error' ELSE 'generic' END
   WHEN source = 'firewall' THEN CASE WHEN regexp_matches(log_line, '{PACKET}') THEN 'iptables' ELSE 'generic' END ELSE 'error' END AS fmt0
 FROM ({lines}))))))) {keep}
"""
