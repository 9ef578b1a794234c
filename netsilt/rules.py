"""Fixed values of the log analytics: word lists, patterns, lookup tables, thresholds.

Everything in this module is data. The values decide results, so they are kept
exactly as specified and in their specified order (order matters wherever "first
match wins"). Operators take these tables as default arguments.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# severities
# --------------------------------------------------------------------------

SYSLOG_SEVERITIES = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]

FEATURE_SEVERITY_RANK = {
    "DEBUG": 0, "INFO": 1, "NOTICE": 2, "WARNING": 3, "ERROR": 4, "CRITICAL": 5, "ALERT": 6, "EMERGENCY": 7,
}
ANOMALY_SEVERITY_RANK = {"DEBUG": 0, "INFO": 1, "NOTICE": 2, "WARNING": 3, "ERROR": 4, "CRITICAL": 5}
DEVICE_SEVERITY_RANK = {"DEBUG": 0, "INFO": 1, "WARNING": 3, "ERROR": 4, "CRITICAL": 5}
DEFAULT_SEVERITY_RANK = 1

WORST_SEVERITY_ORDER = ["DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL"]

IMPACT_WEIGHT = {"DEBUG": 0.1, "INFO": 0.2, "WARNING": 0.5, "ERROR": 0.8, "CRITICAL": 1.0}
DEFAULT_IMPACT_WEIGHT = 0.2

ZABBIX_SEVERITY = {0: "INFO", 1: "INFO", 2: "WARNING", 3: "ERROR", 4: "ERROR", 5: "CRITICAL"}

# --------------------------------------------------------------------------
# Syslog component patterns (first match wins)
# --------------------------------------------------------------------------

SYSLOG_COMPONENTS = [
    ("BGP", r"%BGP[-\w]+:"),
    ("OSPF", r"%OSPF[-\w]+:"),
    ("STP", r"%STP[-\w]+:"),
    ("INTERFACE", r"%LINK[-\w]+:|GigabitEthernet|TenGigE|Ethernet"),
    ("SECURITY", r"%ASA[-\w]+:|%SEC[-\w]+:|firewall|ACL"),
    ("HARDWARE", r"%CPU|%MEMORY|%ENVIRONMENT|chassis"),
    ("QOS", r"%QOS[-\w]+:|queue|bandwidth"),
]

# --------------------------------------------------------------------------
# Feature word lists
# --------------------------------------------------------------------------

SEVERITY_KEYWORDS = {
    "CRITICAL": ["critical", "crash", "fatal", "emergency", "down", "failed", "failure"],
    "ERROR": ["error", "err", "fault", "unreachable", "timeout", "reset"],
    "WARNING": ["warning", "warn", "high", "degraded", "slow", "delay"],
    "INFO": ["up", "established", "connected", "success", "normal", "restored"],
}

COMPONENT_KEYWORDS = {
    "BGP": ["bgp", "neighbor", "as-path", "route-reflector", "ibgp", "ebgp"],
    "OSPF": ["ospf", "adjacency", "lsa", "spf", "area", "dr/bdr"],
    "STP": ["stp", "rstp", "mstp", "topology change", "bpdu", "root bridge"],
    "INTERFACE": ["interface", "link", "port", "ethernet", "gigabit", "tengig", "physical", "duplex", "bandwidth"],
    "SECURITY": ["firewall", "acl", "asa", "ids", "scan", "intrusion", "brute force", "attack", "exploit",
                 "vulnerability"],
    "HARDWARE": ["cpu", "memory", "temperature", "fan", "power", "hardware", "chassis", "module", "linecard"],
    "QOS": ["qos", "queue", "traffic shaping", "policing", "dscp", "cos"],
    "DNS": ["dns", "query", "resolver", "zone", "nxdomain", "servfail"],
    "DHCP": ["dhcp", "lease", "discover", "offer", "request", "ack"],
    "VPN": ["vpn", "ipsec", "tunnel", "ikev2", "esp", "crypto"],
}

# first match wins
THREAT_PATTERNS = [
    ("port_scan", r"port.{0,20}scan|scan.{0,20}port"),
    ("brute_force", r"brute.?force|failed.login|auth.fail"),
    ("dos_attack", r"dos|flood|syn.flood|icmp.flood"),
    ("dns_amplification", r"dns.amp|amplification|dns.flood"),
    ("unauthorized", r"unauthorized|permission.denied|privilege"),
]

# --------------------------------------------------------------------------
# Classification rules (first match wins)
# (pattern, category, subcategory, action)
# --------------------------------------------------------------------------

CLASSIFICATION_RULES = [
    (r"%BGP|bgp.neighbor|hold.timer", "BGP", "neighbor_down",
     "Check BGP timers and verify peer reachability"),
    (r"%OSPF|ospf.adjacency|lsa.flood", "OSPF", "adjacency_change",
     "Verify OSPF hello intervals and authentication"),
    (r"%STP|topology.change|bpdu", "STP", "topology_change",
     "Investigate root bridge changes and rogue switches"),
    (r"%LINK|interface.*down|link.down", "INTERFACE", "link_down",
     "Check physical layer: cable, SFP, remote interface state"),
    (r"port.scan|scan.*port", "SECURITY", "port_scan",
     "Block source IP, review firewall ACLs"),
    (r"brute.force|auth.*fail|failed.login", "SECURITY", "brute_force",
     "Enable account lockout, alert SOC team"),
    (r"%CPU|cpu.utilization.*8[5-9]|cpu.utilization.*9\d", "HARDWARE", "high_cpu",
     "Identify high-CPU processes; consider load balancing"),
    (r"%MEMORY|memory.alert|memory.*9[0-9]%", "HARDWARE", "high_memory",
     "Clear unused processes; consider hardware upgrade"),
    (r"dns.*spike|dns.*amplification|dns.*flood", "DNS", "dns_amplification",
     "Enable DNS rate limiting; restrict ANY queries"),
    (r"%QOS|packet.drop.*queue|voice.queue", "QOS", "queue_overflow",
     "Review QoS policy; increase voice queue bandwidth"),
    (r"IDS|snort|intrusion|signature", "SECURITY", "ids_alert",
     "Review IDS alert; correlate with firewall logs"),
    (r"vpn|ipsec|tunnel.*down|ikev2", "VPN", "tunnel_down",
     "Verify IKE proposals and check peer configuration"),
]
RULE_CONFIDENCE = 0.85
NO_RULE = ("GENERAL", "informational", "No immediate action required")
NO_RULE_CONFIDENCE = 0.50
ML_CONFIDENCE_THRESHOLD = 0.65

# --------------------------------------------------------------------------
# Entity patterns
# --------------------------------------------------------------------------

IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV4_LOOSE = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
PORT = r":(\d{2,5})\b"
PORT_PRESENT = r":\d{2,5}\b"
DOMAIN = r"\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|gov|edu)\b"
FILE_HASH = r"\b[0-9a-f]{32,64}\b"
NAMED_INTERFACE = r"(?:GigabitEthernet|TenGigE|FastEthernet|Ethernet|Port-channel|Vlan)[\d/]+"
TEMPLATE_HEX = r"\b[0-9a-f]{4,}\b"
TEMPLATE_INTERFACE = r"(?:GigabitEthernet|TenGigE|Ethernet|Port-channel)[\d/]+"
TEMPLATE_NUMBER = r"\b\d+\b"
VERSION_PATTERNS = [
    r"IOS-XE\s[\d\.]+",
    r"NX-OS\s[\d\.]+",
    r"IOS\s[\d\.]+",
    r"ASA\s[\d\.]+",
    r"v[\d]+\.[\d]+\.[\d]+",
]
UNKNOWN_VERSION = "Unknown"
SYSLOG_PRI = r"^<(\d+)>"

MAX_COMPONENTS = 10
MAX_COMPONENT_IPS = 3
MAX_PORT = 65535

# --------------------------------------------------------------------------
# Per-log threat scores and recommended actions
# --------------------------------------------------------------------------

THREAT_SCORE = {"CRITICAL": 0.95, "ERROR": 0.80, "WARNING": 0.65, "INFO": 0.40}
DEFAULT_THREAT_SCORE = 0.60
THREAT_CPU_LIMIT = 80
THREAT_CPU_BONUS = 0.05

THREAT_ACTION = {
    "port_scan": "🔒 Block source IP immediately. Review ACLs and enable IPS.",
    "brute_force": "🔒 Lockout source IP. Enforce MFA. Alert security team.",
    "dos_attack": "🔒 Activate DDoS mitigation. Rate-limit traffic from source.",
    "dns_amplification": "🔒 Restrict DNS ANY queries. Implement DNS rate limiting.",
    "unauthorized": "🔒 Audit privilege escalation attempts. Rotate credentials.",
}
DEFAULT_THREAT_ACTION = "🔒 Investigate and contain the security incident."

CATEGORY_ACTION = {
    "BGP": "Verify BGP peer reachability and check routing table integrity.",
    "OSPF": "Check OSPF hello intervals, authentication, and MTU mismatches.",
    "STP": "Investigate topology change: look for rogue switches or BPDU storms.",
    "INTERFACE": "Check physical: cable integrity, SFP module, and remote port state.",
    "QOS": "Review QoS policies; increase bandwidth allocation for critical queues.",
    "DNS": "Inspect DNS server logs; check for misconfigurations or attacks.",
    "VPN": "Check IKE proposals, PSK/certificates, and IP routing to peer.",
    "GENERAL": "Log recorded for baseline; no immediate action required.",
}
HARDWARE_ACTION = {
    "high_cpu": "Identify top processes (show proc cpu); consider process restart.",
    "high_memory": "Identify memory consumers; plan maintenance window for reload.",
}
DEFAULT_HARDWARE_ACTION = "Investigate HARDWARE issue."
DEFAULT_ACTION = "Review log details and consult network runbook."

# --------------------------------------------------------------------------
# Recurring patterns and cascades
# --------------------------------------------------------------------------

MIN_PATTERN_FREQUENCY = 3
PATTERN_DESCRIPTION_LENGTH = 150
PATTERN_ACTION = {
    "HARDWARE": "Schedule maintenance; monitor resource trends for degradation.",
    "SECURITY": "Escalate to SOC; review firewall rules and access controls.",
    "BGP": "Monitor BGP stability; check peer AS health.",
    "INTERFACE": "Audit physical plant; check for intermittent hardware faults.",
}
DEFAULT_PATTERN_ACTION = "Monitor the pattern; review logs for root cause."

# (cause, effect, hypothesis, confidence)
CASCADE_RULES = [
    ("INTERFACE", "BGP", "Interface failure causing BGP session drop", 0.90),
    ("INTERFACE", "OSPF", "Interface failure causing OSPF adjacency loss", 0.88),
    ("HARDWARE", "INTERFACE", "High CPU/memory degrading interface performance", 0.75),
    ("HARDWARE", "BGP", "Hardware stress destabilising routing protocols", 0.70),
    ("SECURITY", "HARDWARE", "Security attack causing resource exhaustion", 0.80),
    ("DNS", "SECURITY", "DNS anomaly indicating potential DDoS", 0.72),
]
CASCADE_WINDOW_MINUTES = 60

# --------------------------------------------------------------------------
# Anomaly scoring
# --------------------------------------------------------------------------

BASELINE_WINDOW = 100
BASELINE_MIN_SAMPLES = 10
BASELINE_MIN_STD = 1e-6
Z_SCORE_LIMIT = 2.5
BURST_WINDOW_MINUTES = 5
BURST_HISTORY_WINDOWS = 5
BURST_MIN_EVENTS = 5
BURST_RATIO = 3.0
ANOMALY_THRESHOLD = 0.65
SEVERITY_UPGRADE_SCORE = 0.80
SECURITY_CATEGORIES = ["SECURITY", "IDS"]
SECURITY_BOOST = {"CRITICAL": 0.30, "ERROR": 0.15, "WARNING": 0.05}
CONTAMINATION = 0.05
ISOLATION_TREES = 100
ISOLATION_SAMPLE = 256
MIN_TRAINING_LOGS = 20

# --------------------------------------------------------------------------
# Security incidents
# --------------------------------------------------------------------------

MIN_INCIDENT_SCORE = 0.30
INCIDENT_SEVERITY = [("CRITICAL", 0.85), ("HIGH", 0.70), ("MEDIUM", 0.50), ("LOW", 0.30)]
EVENT_SCORE_STEP = 0.05

MITRE_TACTICS = {
    "port_scan": ["TA0043 - Reconnaissance", "T1595 - Active Scanning"],
    "brute_force": ["TA0006 - Credential Access", "T1110 - Brute Force"],
    "dos_attack": ["TA0040 - Impact", "T1498 - Network DoS"],
    "ddos_attack": ["TA0040 - Impact", "T1498.002 - Reflection Amplification"],
    "dns_amplification": ["TA0040 - Impact", "T1498.002 - Reflection Amplification"],
    "unauthorized": ["TA0001 - Initial Access", "T1078 - Valid Accounts"],
    "data_exfiltration": ["TA0010 - Exfiltration", "T1048 - Exfiltration Over Alt Protocol"],
    "arp_spoofing": ["TA0007 - Discovery", "T1557 - Adversary-in-the-Middle"],
}
DEFAULT_MITRE = ["TA0000 - Unknown"]

# %s stands for the first three addresses of the incident
INCIDENT_ACTIONS = {
    "port_scan": [
        "Block source IP(s): %s at perimeter firewall.",
        "Enable IPS signature for reconnaissance activity.",
        "Review open ports and disable unnecessary services.",
    ],
    "brute_force": [
        "Immediately block %s at firewall.",
        "Enforce multi-factor authentication on all remote access.",
        "Audit user account lockout policies.",
        "Alert SOC and review authentication logs for compromise.",
    ],
    "dos_attack": [
        "Activate upstream DDoS scrubbing if available.",
        "Rate-limit traffic from %s.",
        "Enable SYN cookies / connection rate limiting.",
    ],
    "dns_amplification": [
        "Restrict DNS ANY query responses.",
        "Implement DNS rate limiting (RRL).",
        "Verify resolver is not open to the internet.",
    ],
    "unauthorized": [
        "Revoke potentially compromised credentials immediately.",
        "Audit privilege escalation paths and sudo rules.",
        "Review authentication logs for successful breaches.",
    ],
}
DEFAULT_INCIDENT_ACTIONS = [
    "Investigate and contain the incident.",
    "Review related logs for additional context.",
]
CRITICAL_INCIDENT_ACTION = "🚨 CRITICAL: Engage incident response team immediately."
UNKNOWN_SOURCE = "unknown source"

# --------------------------------------------------------------------------
# Predictive maintenance
# --------------------------------------------------------------------------

DEVICE_WINDOW = 50
DEVICE_MIN_SAMPLES = 5
ALERT_THRESHOLD = 0.70
HORIZON_HOURS = 24
RISK_LEVELS = [("CRITICAL", 0.85), ("HIGH", 0.65), ("MEDIUM", 0.40)]
LOWEST_RISK = "LOW"

MAINTENANCE_ACTIONS = {
    "interface_down": [
        "Schedule cable/SFP inspection during low-traffic window.",
        "Verify interface error counters and clean physical connections.",
        "Prepare standby interface or failover path.",
    ],
    "hardware_failure": [
        "Identify and terminate unnecessary high-CPU processes.",
        "Review memory allocation; consider module replacement.",
        "Schedule controlled reload in next maintenance window.",
        "Ensure redundant hardware is available.",
    ],
    "routing_instability": [
        "Review routing protocol timers and authentication.",
        "Check for configuration drift against baseline.",
        "Verify route table consistency across peer devices.",
    ],
}
CRITICAL_MAINTENANCE_ACTION = "⚠️ URGENT: Schedule maintenance within 4 hours."
HIGH_MAINTENANCE_ACTION = "Schedule maintenance within next 24 hours."
DEFAULT_MAINTENANCE_ACTIONS = ["Review device health metrics."]
DEFAULT_SIGNAL = "Cumulative metric degradation pattern detected"
CRITICAL_WINDOW = "Within 4 hours (by %s UTC)"
HIGH_WINDOW = "Next maintenance window: %s 02:00-04:00 UTC"
ROUTINE_WINDOW = "Routine maintenance before %s UTC"

# --------------------------------------------------------------------------
# Device features and the signals an alert names
# --------------------------------------------------------------------------

# feature, signal, statistic, divisor; the order is the feature vector's order
DEVICE_FEATURES = [
    ("cpu_mean", "cpu_usage", "mean", 100.0),
    ("cpu_std", "cpu_usage", "std", 100.0),
    ("cpu_trend", "cpu_usage", "trend", 10.0),
    ("cpu_last", "cpu_usage", "last", 100.0),
    ("mem_mean", "memory_usage", "mean", 100.0),
    ("mem_std", "memory_usage", "std", 100.0),
    ("mem_trend", "memory_usage", "trend", 10.0),
    ("mem_last", "memory_usage", "last", 100.0),
    ("err_mean", "interface_errors", "mean", 100.0),
    ("err_std", "interface_errors", "std", 100.0),
    ("err_trend", "interface_errors", "trend", 10.0),
    ("err_last", "interface_errors", "last", 100.0),
    ("sev_mean", "severity_num", "mean", 7.0),
    ("sev_trend", "severity_num", "trend", 2.0),
    ("sev_last", "severity_num", "last", 7.0),
    ("cnt_mean", "error_count", "mean", 20.0),
    ("cnt_trend", "error_count", "trend", 5.0),
]
# (feature, limit, text, features shown in it as percent with that many digits)
DEVICE_SIGNALS = [
    ("cpu_last", 0.75, "CPU at %s%% (mean %s%%)", [("cpu_last", 0), ("cpu_mean", 0)]),
    ("cpu_trend", 0.02, "CPU increasing at +%s%%/sample", [("cpu_trend", 1)]),
    ("mem_last", 0.80, "Memory at %s%% (mean %s%%)", [("mem_last", 0), ("mem_mean", 0)]),
    ("err_last", 0.05, "Interface errors at %s/sample", [("err_last", 0)]),
    ("err_trend", 0.01, "Error count trending up (+%s/sample)", [("err_trend", 1)]),
]

# --------------------------------------------------------------------------
# Health report
# --------------------------------------------------------------------------

THREAT_DEDUCTION = {"CRITICAL": 15, "HIGH": 10, "MEDIUM": 5, "LOW": 2}
RISK_DEDUCTION = {"CRITICAL": 12, "HIGH": 8, "MEDIUM": 4, "LOW": 1}
HEALTHY_SCORE = 80
DEGRADED_SCORE = 50
THREAT_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
REC_CRITICAL_HEALTH = "🔴 Network health is CRITICAL. Immediate intervention required."
REC_THREATS = "🔴 %d critical security threat(s) active. Engage SOC team immediately."
REC_DEVICES = "⚠️ Imminent failure predicted for: %s. Schedule emergency maintenance."
REC_ANOMALIES = "📊 %d devices showing high anomaly scores. Investigate for systemic issues."
REC_PATTERNS = "🔍 %d recurring security patterns detected. Review firewall and access policies."
REC_NORMAL = "✅ Network operating within normal parameters. Continue monitoring."
NO_RECOMMENDATIONS = "No recommendations at this time."
NO_CRITICAL_ALERTS = "No critical alerts."
NO_DATA = "No data"
NO_ANOMALOUS_DEVICES = "No anomalous devices detected."
NO_MAINTENANCE_ALERTS = "No maintenance alerts."
