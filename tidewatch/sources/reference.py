"""Reference data of the detectors and reports. Everything here is small and of fixed size, so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import cidr_bounds

# Attack types with severity and category.
ATTACK_TYPES = (
    ("ssh_bruteforce", "high", "credential_attack"),
    ("ssh_invalid_user", "medium", "reconnaissance"),
    ("ssh_connection_flood", "medium", "dos"),
    ("ssh_key_abuse", "high", "persistence"),
    ("sql_injection", "critical", "injection"),
    ("xss_attempt", "high", "injection"),
    ("path_traversal", "high", "file_access"),
    ("lfi_attempt", "high", "file_access"),
    ("rfi_attempt", "critical", "file_access"),
    ("command_injection", "critical", "injection"),
    ("ssrf_attempt", "high", "injection"),
    ("xxe_attempt", "critical", "injection"),
    ("ssti_attempt", "critical", "injection"),
    ("deserialization_attack", "critical", "injection"),
    ("ldap_injection", "high", "injection"),
    ("xml_injection", "high", "injection"),
    ("csp_bypass", "medium", "defense_evasion"),
    ("idor_attempt", "medium", "broken_access"),
    ("scanner_detected", "low", "reconnaissance"),
    ("admin_probe", "low", "reconnaissance"),
    ("sensitive_file_access", "medium", "reconnaissance"),
    ("api_enumeration", "medium", "reconnaissance"),
    ("subdomain_takeover", "medium", "reconnaissance"),
    ("shellshock_attempt", "critical", "exploit"),
    ("log4j_attempt", "critical", "exploit"),
    ("heartbleed_attempt", "critical", "exploit"),
    ("spectre_meltdown", "critical", "exploit"),
    ("eternalblue_attempt", "critical", "exploit"),
    ("cve_exploit", "critical", "exploit"),
    ("mysql_bruteforce", "high", "credential_attack"),
    ("postgres_bruteforce", "high", "credential_attack"),
    ("mongo_unauthorized", "high", "unauthorized_access"),
    ("redis_unauthorized", "high", "unauthorized_access"),
    ("oracle_bruteforce", "high", "credential_attack"),
    ("mssql_bruteforce", "high", "credential_attack"),
    ("smtp_bruteforce", "high", "credential_attack"),
    ("imap_bruteforce", "high", "credential_attack"),
    ("pop3_bruteforce", "high", "credential_attack"),
    ("relay_attempt", "medium", "abuse"),
    ("spoofing_attempt", "medium", "social_engineering"),
    ("ftp_bruteforce", "high", "credential_attack"),
    ("anonymous_ftp", "low", "misconfiguration"),
    ("port_scan", "medium", "reconnaissance"),
    ("service_probe", "low", "reconnaissance"),
    ("dns_tunneling", "high", "exfiltration"),
    ("dns_amplification", "high", "dos"),
    ("smb_enumeration", "medium", "reconnaissance"),
    ("ldap_enumeration", "medium", "reconnaissance"),
    ("kerberoasting", "high", "credential_access"),
    ("ntlm_relay", "critical", "credential_access"),
    ("syn_flood", "high", "dos"),
    ("udp_flood", "high", "dos"),
    ("icmp_flood", "medium", "dos"),
    ("http_flood", "high", "dos"),
    ("slowloris_attack", "high", "dos"),
    ("sudo_failure", "medium", "privilege_escalation"),
    ("su_failure", "medium", "privilege_escalation"),
    ("privilege_escalation", "high", "privilege_escalation"),
    ("ssh_key_added", "high", "persistence"),
    ("cron_persistence", "high", "persistence"),
    ("rc_modification", "high", "persistence"),
    ("service_creation", "high", "persistence"),
    ("registry_persistence", "high", "persistence"),
    ("log_clearing", "high", "defense_evasion"),
    ("process_injection", "critical", "defense_evasion"),
    ("rootkit_indicator", "critical", "defense_evasion"),
    ("fileless_attack", "critical", "defense_evasion"),
    ("password_spray", "high", "credential_access"),
    ("credential_dumping", "critical", "credential_access"),
    ("keylogging", "critical", "credential_access"),
    ("webshell_upload", "critical", "backdoor"),
    ("reverse_shell", "critical", "remote_access"),
    ("crypto_miner", "critical", "cryptocurrency"),
    ("ransomware_indicator", "critical", "impact"),
    ("botnet_indicator", "critical", "botnet"),
    ("wmi_lateral", "high", "lateral_movement"),
    ("winrm_lateral", "high", "lateral_movement"),
    ("psexec_abuse", "high", "lateral_movement"),
    ("aws_api_abuse", "high", "cloud"),
    ("s3_bucket_exposure", "high", "cloud"),
    ("cloud_key_exposure", "critical", "cloud"),
    ("k8s_unauthorized", "high", "container"),
    ("container_escape", "critical", "container"),
    ("privilege_container", "high", "container"),
    ("data_exfiltration", "critical", "exfiltration"),
    ("suspicious_upload", "high", "exfiltration"),
    ("honeypot_connection", "critical", "deception"),
    ("honeyfile_access", "critical", "deception"),
)

# The protocol that attacks of a type are counted under; others are OTHER.
TYPE_PROTOCOLS = {
    "ssh_bruteforce": "SSH",
    "ssh_invalid_user": "SSH",
    "ssh_connection_flood": "SSH",
    "ssh_login_success_after_failures": "SSH",
    "mysql_bruteforce": "MYSQL",
    "postgres_bruteforce": "POSTGRES",
    "mssql_bruteforce": "MSSQL",
    "oracle_bruteforce": "ORACLE",
    "mongodb_bruteforce": "MONGODB",
    "redis_bruteforce": "REDIS",
    "ftp_bruteforce": "FTP",
    "ftp_anonymous": "FTP",
    "pop3_bruteforce": "POP3",
    "imap_bruteforce": "IMAP",
    "smtp_bruteforce": "SMTP",
    "snmp_bruteforce": "SNMP",
    "telnet_bruteforce": "TELNET",
    "rdp_bruteforce": "RDP",
    "sql_injection": "HTTP",
    "xss_attempt": "HTTP",
    "xss": "HTTP",
    "path_traversal": "HTTP",
    "lfi_attempt": "HTTP",
    "rfi_attempt": "HTTP",
    "command_injection": "HTTP",
    "ssrf_attempt": "HTTP",
    "xxe_attempt": "HTTP",
    "ssti_attempt": "HTTP",
    "deserialization_attack": "HTTP",
    "ldap_injection": "LDAP",
    "scanner_detected": "HTTP",
    "admin_probe": "HTTP",
    "sensitive_file_access": "HTTP",
    "api_enumeration": "HTTP",
    "shellshock_attempt": "HTTP",
    "log4j_attempt": "HTTP",
    "heartbleed_attempt": "HTTPS",
    "eternalblue_attempt": "SMB",
    "spectre_attempt": "HTTP",
    "dns_tunneling": "DNS",
    "port_scan": "OTHER",
    "port_hopping": "OTHER",
    "broadcast_storm": "OTHER",
    "timing_evasion": "OTHER",
    "ipv6_tunnel": "OTHER",
    "covert_channel": "OTHER",
    "session_correlated_sql_attack": "HTTP",
    "session_correlated_cmd_attack": "HTTP",
    "session_correlated_traversal_attack": "HTTP",
    "reverse_shell": "OTHER",
    "privilege_escalation_attempt": "OTHER",
    "webshell_creation": "HTTP",
    "credential_access": "OTHER",
    "log_tampering": "OTHER",
}

# Techniques of an attack type.
ATTACK_TECHNIQUES = (
    ("ssh_bruteforce", ("T1110", "T1078")),
    ("ssh_invalid_user", ("T1110", "T1078")),
    ("web_bruteforce", ("T1110",)),
    ("sql_injection", ("T1190", "T1059")),
    ("xss_attempt", ("T1189", "T1059")),
    ("path_traversal", ("T1190",)),
    ("lfi_attempt", ("T1190",)),
    ("rfi_attempt", ("T1190",)),
    ("command_injection", ("T1059", "T1190")),
    ("reverse_shell", ("T1059", "T1053")),
    ("webshell", ("T1505", "T1059")),
    ("download_execute", ("T1105", "T1059")),
    ("scheduled_task", ("T1053",)),
    ("cron_job", ("T1053",)),
    ("ssh_key_added", ("T1098", "T1543")),
    ("cron_persistence", ("T1053",)),
    ("rc_modification", ("T1547",)),
    ("registry_persistence", ("T1547",)),
    ("privilege_escalation_attempt", ("T1548",)),
    ("sudo_abuse", ("T1548",)),
    ("suid_abuse", ("T1068",)),
    ("kernel_exploit", ("T1068",)),
    ("log_clearing", ("T1070",)),
    ("process_hiding", ("T1562", "T1036")),
    ("rootkit_indicator", ("T1014", "T1068")),
    ("password_dump", ("T1003",)),
    ("keylogging", ("T1056",)),
    ("credential_theft", ("T1555", "T1111")),
    ("/etc/passwd_access", ("T1005",)),
    ("/etc/shadow_access", ("T1005",)),
    ("port_scan", ("T1595", "T1082")),
    ("network_enum", ("T1595",)),
    ("user_enum", ("T1087",)),
    ("file_discovery", ("T1083",)),
    ("process_discovery", ("T1057",)),
    ("honeypot_connection", ("T1595", "T1589")),
    ("honeyfile_access", ("T1595", "T1083")),
    ("remote_service", ("T1021",)),
    ("ssh_lateral", ("T1021", "T1078")),
    ("smb_lateral", ("T1021",)),
    ("data_collection", ("T1560", "T1119")),
    ("screenshot", ("T1113",)),
    ("keylog_collection", ("T1056",)),
    ("data_exfiltration", ("T1041", "T1048")),
    ("dns_exfiltration", ("T1041", "T1573")),
    ("high_port_exfil", ("T1041",)),
    ("process_termination", ("T1489",)),
    ("service_stop", ("T1489",)),
    ("ransomware_indicator", ("T1486",)),
    ("disk_wipe", ("T1485",)),
    ("suspicious_connection", ("T1071", "T1573")),
    ("high_port_connection", ("T1573",)),
    ("external_ssh", ("T1071",)),
    ("irc_c2", ("T1071",)),
    ("crypto_miner", ("T1496",)),
)

# The tactic of a technique.
TECHNIQUE_TACTIC = (
    ("T1190", "initial_access"),
    ("T1133", "initial_access"),
    ("T1566", "initial_access"),
    ("T1059", "execution"),
    ("T1204", "execution"),
    ("T1203", "execution"),
    ("T1547", "persistence"),
    ("T1136", "persistence"),
    ("T1543", "persistence"),
    ("T1053", "persistence"),
    ("T1078", "persistence"),
    ("T1548", "privilege_escalation"),
    ("T1068", "privilege_escalation"),
    ("T1562", "defense_evasion"),
    ("T1070", "defense_evasion"),
    ("T1036", "defense_evasion"),
    ("T1014", "defense_evasion"),
    ("T1110", "credential_access"),
    ("T1003", "credential_access"),
    ("T1555", "credential_access"),
    ("T1056", "credential_access"),
    ("T1595", "discovery"),
    ("T1082", "discovery"),
    ("T1087", "discovery"),
    ("T1083", "discovery"),
    ("T1057", "discovery"),
    ("T1021", "lateral_movement"),
    ("T1210", "lateral_movement"),
    ("T1560", "collection"),
    ("T1119", "collection"),
    ("T1113", "collection"),
    ("T1041", "exfiltration"),
    ("T1048", "exfiltration"),
    ("T1486", "impact"),
    ("T1489", "impact"),
    ("T1485", "impact"),
    ("T1496", "impact"),
    ("T1071", "command_and_control"),
    ("T1573", "command_and_control"),
)

# Tactic identifiers and names.
TACTICS = {
    "initial_access": ("TA0001", "Initial Access"), "execution": ("TA0002", "Execution"), "persistence": ("TA0003", "Persistence"),
    "privilege_escalation": ("TA0004", "Privilege Escalation"), "defense_evasion": ("TA0005", "Defense Evasion"), "credential_access": ("TA0006", "Credential Access"),
    "discovery": ("TA0007", "Discovery"), "lateral_movement": ("TA0008", "Lateral Movement"), "collection": ("TA0009", "Collection"),
    "exfiltration": ("TA0010", "Exfiltration"), "command_and_control": ("TA0011", "Command and Control"), "impact": ("TA0040", "Impact"),
}

# Services by port, and application protocols by port.
SERVICES = {20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 110: "pop3", 123: "ntp", 143: "imap", 389: "ldap", 443: "https", 445: "smb", 465: "smtps", 993: "imaps", 995: "pop3s", 1433: "mssql", 1521: "oracle", 2049: "nfs", 3306: "mysql", 3389: "rdp", 5432: "postgresql", 5900: "vnc", 6379: "redis", 8080: "http-alt", 8443: "https-alt", 27017: "mongodb"}
APP_PORTS = {80: "http", 443: "tls", 22: "ssh", 53: "dns", 21: "ftp", 25: "smtp", 110: "pop3", 143: "imap", 3306: "mysql", 5432: "postgresql", 6379: "redis", 27017: "mongodb", 8080: "http", 8081: "http", 8082: "http", 8443: "tls", 8888: "http", 8000: "http", 3000: "http", 5000: "http"}

# Address ranges by label, in the order in which they are tried.
RANGES = {
    "cloudflare": (
        "173.245.48.0/20",
        "103.21.244.0/22",
        "103.22.200.0/22",
        "103.31.4.0/22",
        "141.101.64.0/18",
        "108.162.192.0/18",
        "190.93.240.0/20",
        "188.114.96.0/20",
        "197.234.240.0/22",
        "198.41.128.0/17",
        "162.158.0.0/15",
        "104.16.0.0/13",
        "104.24.0.0/14",
        "172.64.0.0/13",
        "131.0.72.0/22",
        "2400:cb00::/32",
        "2606:4700::/32",
        "2803:f800::/32",
        "2405:b500::/32",
        "2405:8100::/32",
        "2a06:98c0::/29",
        "2c0f:f248::/32",
    ),
    "google": (
        "8.8.8.0/24",
        "8.8.4.0/24",
        "142.250.0.0/15",
        "172.217.0.0/16",
        "216.58.192.0/19",
        "74.125.0.0/16",
        "173.194.0.0/16",
    ),
    "aws": (
        "13.32.0.0/15",
        "13.224.0.0/14",
        "18.32.0.0/12",
        "52.84.0.0/15",
        "54.230.0.0/16",
        "99.84.0.0/16",
        "205.251.192.0/19",
    ),
    "private": (
        "10.0.0.0/8",
        "172.16.0.0/12",
        "192.168.0.0/16",
        "127.0.0.0/8",
        "169.254.0.0/16",
        "100.64.0.0/10",
        "224.0.0.0/4",
        "240.0.0.0/4",
        "::1/128",
        "fc00::/7",
        "fe80::/10",
        "ff00::/8",
    ),
}

# Log line patterns in the order in which they are tried: name, pattern, and the fields of its groups.
LOG_PATTERNS = (
    ("ssh_failed", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+sshd(?:-session)?\[\d+\]:\s+Failed\s+password\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+([\d.]+)\s+port\s+(\d+)", ("user", "ip", "port")),
    ("ssh_accepted", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+sshd(?:-session)?\[\d+\]:\s+Accepted\s+\S+\s+for\s+(\S+)\s+from\s+([\d.]+)\s+port\s+(\d+)", ("user", "ip", "port")),
    ("ssh_invalid_user", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+sshd(?:-session)?\[\d+\]:\s+Invalid\s+user\s+(\S+)\s+from\s+([\d.]+)", ("user", "ip")),
    ("ssh_connection_closed", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+sshd(?:-session)?\[\d+\]:\s+Connection\s+closed\s+by\s+(?:authenticating user \S+ )?([\d.]+)\s+port\s+(\d+)", ("ip", "port")),
    ("web_access", r'([\d.]+)\s+-\s+(\S+)\s+\[[^\]]+\]\s+"(\w+)\s+(\S+)\s+[^"]+"\s+(\d+)\s+\d+\s+"[^"]*"\s+"([^"]*)"', ("ip", "user", "method", "path", "status", "ua")),
    ("mysql_failed", r"(?i)\d{4}-\d{2}-\d{2}\s+[\d:]+\s+\d+\s+\[Warning\]\s+Access\s+denied\s+for\s+user\s+'(\S+)'@'([\d.]+)'", ("user", "ip")),
    ("mysql_failed2", r"(?i)\d{4}-\d{2}-\d{2}\s+[\d:]+\s+\d+\s+\[Warning\]\s+Access\s+denied\s+for\s+user\s+(\S+)@([\d.]+)", ("user", "ip")),
    ("postgres_failed", r'\w+\s+\d+\s+[\d:.]+\s+\S+\s+postgres\[\d+\]:\s+.*FATAL:\s+password\s+authentication\s+failed\s+for\s+user\s+"(\S+)".*\s+host=([\d.]+)', ("user", "ip")),
    ("postfix_sasl", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+postfix/smtpd\[\d+\]:\s+warning:\s+\S+\[([\d.]+)\]:\s+SASL\s+\S+\s+authentication\s+failed", ("ip",)),
    ("dovecot_failed", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+dovecot:\s+auth:\s+Error:\s+Password\s+verification\s+failed\s+for\s+user\s+(\S+):\s+.*\s+rip=([\d.]+)", ("user", "ip")),
    ("pop3_failed", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+dovecot:\s+(?:pop3|pop3-login):\s+.*Password\s+verification\s+failed\s+for\s+user\s+(\S+).*\s+rip=([\d.]+)", ("user", "ip")),
    ("ftp_failed", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+\S+ftp[d]?\[\d+\]:\s+\S+\s+FAIL\s+Login\s+from\s+([\d.]+)\s+for\s+'(\S+)'", ("ip", "user")),
    ("ftp_anonymous", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+\S+ftp[d]?\[\d+\]:\s+.*ANONYMOUS\s+LOGIN.*\s+([\d.]+)", ("ip",)),
    ("mongo_unauthorized", r"\d{4}-\d{2}-\d{2}T[\d:.]+\s+.*\s+Authentication\s+failed.*\s+client=([\d.]+)", ("ip",)),
    ("redis_unauthorized", r"\d+\s+\w+\s+[\d:]+\s+\S+\s+redis-server.*\s+Authentication\s+failed.*\s+client=([\d.]+)", ("ip",)),
    ("k8s_forbidden", r'\d{4}-\d{2}-\d{2}T[\d:.]+.*\s+"verb":"\S+".*"responseCode":(?:403|401).*\s+"sourceIPs":\["([\d.]+)"\]', ("ip",)),
    ("sudo_failed", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+sudo:\s+(\S+)\s+:\s+.*\s+COMMAND=.*\s+USER=\S+\s+TTY=\S+\s+PWD=\S+\s+WORKDIR=\S+", ("user",)),
    ("sudo_used", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+sudo:\s+(\S+)\s+:\s+TTY=\S+\s+PWD=\S+\s+USER=\S+\s+COMMAND=(.+)", ("user", "cmd")),
    ("auth_failure", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+(?:sshd|login|pam)\[\d+\]:\s+FAILED\s+(?:login|authentication)\s+for\s+(\S+)\s+from\s+([\d.]+)", ("user", "ip")),
    ("service_failure", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+systemd\[\d+\]:\s+(\S+).*failed", ("service",)),
    ("disk_error", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+(?:kernel|ext4|xfs).*:\s+(?:I/O|read|write)\s+error", ()),
    ("network_anomaly", r"\w+\s+\d+\s+[\d:.]+\s+\S+\s+kernel:.*:\s+.*(?:drop|block|reject|deny).*\s+([\d.]+)", ("ip",)),
)

# Web signatures in the order in which they are tried, and the attack type of each.
WEB_SIGNATURES = (
    ("sql_injection", r"""(?i)(union[\s/*]+select|select[\s/*]+.*[\s/*]+from|insert\s+into|update\s+.*\s+set|delete\s+from|drop\s+table|;\s*--|'\s*--|"\s*--|'\s*#|"\s*#|'\s*or\s*'|"\s*or\s*"|'\s*and\s*'|1\s*=\s*1|1\s*=\s*2|0x[0-9a-f]+)""", "sql_injection"),
    ("xss", r"(?i)(<script|javascript:|on\w+\s*=|<iframe|<svg|<body|<img.*onerror|alert\(|eval\(|innerHTML)", "xss_attempt"),
    ("path_traversal", r"(?i)(\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|\.\.%2f|%2e%2e%5c|%252e%252e%252f|%c0%ae%c0%ae|%252e%252e/)", "path_traversal"),
    ("lfi_attempt", r"(?i)(etc/passwd|etc/shadow|etc/group|proc/self/environ|proc/self/cmdline|proc/self/status)", "lfi_attempt"),
    ("rfi_attempt", r"(?i)(php://|file://|data://|expect://|ftp://|http://|https://)", "rfi_attempt"),
    ("command_injection", r"(?i)(;\s*\w+|&&\s*\w+|\|\s*\w+|`[^`]+`|\$\([^)]+\)|\|/bin/|/usr/bin/)", "command_injection"),
    ("ssrf_attempt", r"(?i)(127\.0\.0\.1|localhost|169\.254\.169\.254|metadata\.google|metadata\.aws|internal|localhos)", "ssrf_attempt"),
    ("xxe_attempt", r"""(?i)(<!DOCTYPE|<!ENTITY|SYSTEM|PUBLIC\s+"-//|DATA\s+TYPE)""", "xxe_attempt"),
    ("ssti_attempt", r"(?i)(\{\{|\{%|\{\{=|__|jinja|twig|smarty|blade)", "ssti_attempt"),
    ("deserialization", r"(?i)(base64_decode|unserialize|ObjectInputStream|__destruct|__construct|pyimport)", "deserialization_attack"),
    ("ldap_injection", r"(?i)(\*\)|\)\(|\(\||\*\(|\(&\(|admin\*)", "ldap_injection"),
    ("scanner_signature", r"(?i)(nikto|nmap|sqlmap|dirbuster|gobuster|wpscan|nuclei|masscan|zgrab|burp|acunetix|netsparker|appscan)", "scanner_detected"),
    ("admin_probe", r"(?i)(/admin|/wp-admin|/wp-login|/phpmyadmin|/phpMyAdmin|/manager|/console|/solr|/actuator|/\.env|/\.git|/config\.php|/wp-config|/xmlrpc\.php|/graphql|/api)", "admin_probe"),
    ("sensitive_file", r"(?i)(\.env|\.git/config|\.htaccess|\.DS_Store|package\.json|composer\.json|\.sql|\.bak|\.log|\.tar)", "sensitive_file_access"),
    ("api_enumeration", r"(?i)(/api/v|/api/|\.json|\.xml|/swagger|/openapi|/docs)", "api_enumeration"),
    ("shellshock", r"(?i)(\(\)\s*\{|\}\s*\(\)|/bin/bash|/bin/sh.*-i)", "shellshock_attempt"),
    ("log4j", r"(?i)(\$\{jndi:|\$\{lower:|\$\{env:|\$\{sys:)", "log4j_attempt"),
    ("heartbleed", r"\x17\x03\x03", "heartbleed_attempt"),
    ("eternalblue", r"(\x00\x00\x00\x31\xff\x53\x4d\x42|\x00\x00\x00\x63\xff\x53\x4d\x42)", "eternalblue_attempt"),
    ("spectre_meltdown", r"(?i)(spectre|meltdown|CVE-2017-5753|CVE-2017-5715|CVE-2017-5754)", "spectre_meltdown"),
    ("webshell_pattern", r"(?i)(eval\(|base64_decode|shell_exec|system\(|passthru|exec\(|assert\(|preg_replace.*/e)", "webshell_upload"),
    ("reverse_shell", r"(?i)(bash\s+-i|sh\s+-i|/dev/tcp|nc\s+-e|ncat\s+-e|python.*socket|mkfifo)", "reverse_shell"),
    ("crypto_miner", r"(?i)(stratum\+tcp|xmrig|coinhive|cryptonight|monero)", "crypto_miner"),
)

# Syslog keywords in the order in which they are tried.
SYSLOG_KEYWORDS = (
    ("bruteforce", r"(?i)Failed password|Authentication failure|Invalid user"), ("intrusion", r"(?i)BREAK IN|successful logout"), ("firewall_block", r"(?i)denied|rejected|blocked|firewall"),
    ("attack", r"(?i)POSSIBLE BREAK-IN|Buffer overflow|SQL injection|XSS"), ("port_scan", r"(?i)scan|nmap|masscan|port.*探测"), ("dos", r"(?i)DDoS|distributed.*denial|flood"),
    ("privilege_escalation", r"(?i)root.*login|su:|sudo:"), ("malware", r"(?i)malware|trojan|ransomware|backdoor"), ("unauthorized_access", r"(?i)unauthorized|access.*denied|forbidden"),
    ("system_compromise", r"(?i)kernel.*panic|out.*of.*memory|OOM"),
)
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp")
LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")

# Named entities and what they stand for, in the order in which they are replaced.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))

# Request headers that override what a proxy saw.
OVERRIDE_HEADERS = ("x-forwarded-for", "x-original-url", "x-rewrite-url", "x-http-method-override", "x-forwarded-host")

# Headers that proxies add.
PROXY_HEADERS = ("x-forwarded-for", "x-real-ip", "x-forwarded-proto", "via", "proxy-authorization", "proxy-connection", "x-proxy-user", "x-proxy-agent")

# Files whose opening counts, with attack type and severity, in the order in which they are tried; web folders and endings of scripts.
SENSITIVE_PATHS = (
    ("/etc/passwd", "credential_access", "medium"), ("/etc/shadow", "credential_access", "high"), ("/.ssh/", "credential_access", "medium"), ("/.aws/", "credential_access", "medium"),
    ("/var/log/", "log_tampering", "medium"), ("/proc/self/", "process_memory_access", "medium"),
)
WEB_FOLDERS = ("/var/www/", "/home//public_html", "/srv/http")
SCRIPT_ENDINGS = (".php", ".phtml", ".phar", ".php5", ".php7", ".jsp", ".jspx", ".asp", ".aspx", ".exe", ".sh", ".bat", ".cmd", ".ps1")

# Fragments of attacks that count over a session, by class; the star of an Accept header opens no comment.
FRAGMENTS = (
    ("sql", r"(?i)(\bunion\b|\bselect\b|\bfrom\b|\bwhere\b|\bdrop\b|\binsert\b|\bdelete\b|'|--|(?<!\*)/\*|@@|0x[0-9a-f]|\bor\b|\band\b)"),
    ("xss", r"(?i)(script|javascript|on\w+\s*=|alert\(|eval\(|prompt|document\.)"),
    ("cmd", r"(?i)(;|\||`|\$\(|&&|\|\||/bin/|/usr/|\.sh|cmd|powershell|wget|curl)"),
    ("traversal", r"(?i)(\.\.|etc/|passwd|shadow|\.env|boot\.ini|win\.ini)"),
)


def attack_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ATTACK_TYPES), "attack_type string, severity string, category string")


def attack_techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(kind, t, i) for kind, techniques in ATTACK_TECHNIQUES for i, t in enumerate(techniques)], "attack_type string, technique string, place int")


def technique_tactics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, tactic, *TACTICS[tactic]) for t, tactic in TECHNIQUE_TACTIC], "technique string, tactic string, tactic_id string, tactic_name string")


def ports(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "port int, service string")


def ranges(spark: SparkSession, labels: tuple[str, ...] = tuple(RANGES)) -> DataFrame:
    rows = [(i, label, cidr, *cidr_bounds(cidr)) for i, (label, cidr) in enumerate((label, c) for label in labels for c in RANGES[label])]
    return spark.createDataFrame(rows, "ord int, label string, cidr string, lo long, hi long, lo6 string, hi6 string")


def sql_values(rows: list[tuple], columns: tuple[str, ...]) -> str:
    """Rows as a VALUES relation for a SQL twin."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({', '.join(columns)}))"


def attack_types_sql() -> str:
    return sql_values(list(ATTACK_TYPES), ("attack_type", "severity", "category"))


def attack_techniques_sql() -> str:
    return sql_values([(kind, t, i) for kind, techniques in ATTACK_TECHNIQUES for i, t in enumerate(techniques)], ("attack_type", "technique", "place"))


def technique_tactics_sql() -> str:
    return sql_values([(t, tactic, *TACTICS[tactic]) for t, tactic in TECHNIQUE_TACTIC], ("technique", "tactic", "tactic_id", "tactic_name"))

#: Place of the last web signature; those after it are exploits of other kinds.
WEB_LAST = [name for name, *_ in WEB_SIGNATURES].index("api_enumeration")

# Parts of log types in the order in which they are tried, and the attack that a line of that type is by itself.
DIRECT_LOG_TYPES = (
    ("ssh_connection_closed", None), ("ssh_invalid_user", "ssh_invalid_user"), ("ssh_failed", None), ("mysql", None), ("postgres", None),
    ("mongo", "mongo_unauthorized"), ("redis", "redis_unauthorized"), ("postfix", None), ("dovecot", None), ("pop3", None),
    ("ftp_anonymous", "anonymous_ftp"), ("ftp", None), ("sudo_failed", "sudo_failure"), ("k8s", "k8s_unauthorized"),
)
