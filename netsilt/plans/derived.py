"""The log table derived from the ``events`` table (a deterministic projection).

Each event becomes one device log: the event number picks the message template,
the user becomes the device. The same projection exists as SQL text in
``oracles/base.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsilt.functions.columns import sql_literal
from netsilt.sources.readers import spread_input

# (description, raw_message) by event_id % 15; {A} = user_id % 10, {B} = event_id % 250
TEMPLATES = [
    ("BGP neighbor 10.0.{A}.{B} left the established state",
     "rpd: hold timer of peer 10.0.{A}.{B} ran out"),
    ("OSPF adjacency lost on area {B}", "%OSPF-5-ADJCHG: Process 1, Nbr 10.1.{A}.{B}"),
    ("Topology change received on port {B}", "%STP-4-TCN: bpdu seen, root bridge moved"),
    ("Interface TenGigE0/{A}/{B} went down", "xcvr: no light on TenGigE0/{A}/{B}"),
    ("Horizontal port scan by 203.0.113.{B}", "gw: 40 hosts probed within 10 s"),
    ("Repeated failed login over ssh by 198.51.100.{B}",
     "sshd: peer 198.51.100.{B}:5{A}022 at 10.8.{A}.9:22, likely brute force"),
    ("Processor busy: CPU utilization at 9{A}%", "poll: cpu utilization 9{A}%"),
    ("Memory alert: pool usage 9{A}%", "%MEMORY-2-LOW: processor pool"),
    ("DNS query spike from resolver ns{A}.example.com", "dns amplification suspected, ANY zone query"),
    ("Voice queue overflow", "%QOS-4-POLICER: packet drop on queue {A}"),
    ("IDS signature match: syn flood from 192.0.2.{B}",
     "snort[{B}]: intrusion attempt hash d41d8cd98f00b204e9800998ecf8427e"),
    ("IPsec tunnel to 172.16.{A}.{B} down", "ikev2 negotiation timeout, crypto map"),
    ("Configuration saved by operator", "sys: running IOS-XE 17.3.{A} normal"),
    ("DHCP lease offered", "dhcpd: offer to 10.2.{A}.{B}"),
    ("Unauthorized access: permission denied for admin", "firewall auth failed-login ACL 101"),
]
SEVERITIES = {"error": "CRITICAL", "purchase": "ERROR", "signup": "WARNING", "view": "NOTICE", "click": "INFO"}
PLATFORMS = ["syslog", "api", "snmp", "nms_zabbix"]
EPOCH = "2024-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _fill(template: str) -> str:
    """'text {A} text' as SQL: concat('text ', _a, ' text')."""
    parts, rest = [], template
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(sql_literal(rest))
            break
        parts += [sql_literal(rest[:at])] if at else []
        parts.append("_" + rest[at + 1].lower())
        rest = rest[at + 3:]
    return f"concat({', '.join(parts)})"


def _padded(number: str, width: int):
    """Zero-padded to at least ``width`` digits; longer numbers stay whole."""
    text = F.col(number).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _by_template(position: int):
    arms = " ".join(f"WHEN {i} THEN {_fill(pair[position])}" for i, pair in enumerate(TEMPLATES))
    return F.expr(f"CASE event_id % 15 {arms} END")


def logs_from_events(ev: DataFrame) -> DataFrame:
    """Works on batch and streaming frames of the ``events`` schema."""
    at = F.col("ts").cast("timestamp")
    severity = None
    for kind, name in SEVERITIES.items():
        hit = F.col("event_type") == kind
        severity = F.when(hit, name) if severity is None else severity.when(hit, name)
    # whole and part days since the epoch, in the session time zone
    days = (F.unix_micros(at) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(86400000000.0)
    errors = (
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("double"))
        .when(F.col("user_id") % 5 == 0, F.floor(2 * days).cast("double"))
        .otherwise((F.col("event_id") % 20).cast("double"))
    )
    memory = F.get_json_object("props", "$.k").cast("double")
    metrics = F.map_filter(
        F.create_map(
            F.lit("cpu_usage"), F.least(F.col("value"), F.lit(100.0)),
            F.lit("memory_usage"), memory,
            F.lit("interface_errors"), errors,
        ),
        lambda _, v: v.isNotNull(),
    )
    parts = ev.withColumns({
        "_a": (F.col("user_id") % 10).cast("string"),
        "_b": (F.col("event_id") % 250).cast("string"),
    })
    return parts.select(
        F.concat(F.lit("LOG-"), _padded("event_id", 8)).alias("log_id"),
        at.alias("timestamp"),
        F.concat(F.lit("dev-"), _padded("user_id", 3)).alias("source"),
        F.when(F.col("event_id") % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("10.9."), (F.col("user_id") % 250).cast("string"), F.lit(".1")))
        .alias("source_ip"),
        F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), (F.col("event_id") % 4 + 1).cast("int"))
        .alias("platform"),
        F.lit("UNKNOWN").alias("component"),
        F.lit("").alias("version"),
        severity.alias("severity"),
        _by_template(0).alias("description"),
        _by_template(1).alias("raw_message"),
        metrics.alias("metrics"),
        F.array().cast("array<string>").alias("tags"),
        at.alias("collected_at"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(spread_input(events(spark, sf_dir)))
