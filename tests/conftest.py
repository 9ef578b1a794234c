import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netsilt.schema import RAW_LOG  # noqa: E402
from netsilt.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
START = datetime(2025, 3, 9, 1, 0, 0)

# a night on a campus: minute, id, device, platform, severity, description, raw message, cpu, memory, errors
NIGHT = [
    (0, "N-1", "ns-lab", "nms_zabbix", "ERROR", "Resolver overloaded, dns query spike", "named[77]: 9000 questions in one second", 64, 35, 0),
    (4, "N-2", "probe-k", "syslog", "CRITICAL", "Signature 4021, syn flood out of 198.51.100.9",
     "payload 198.51.100.9:4444 to 10.20.0.7 at files.bad-host.net", 22, 20, 0),
    (5, "N-3", "probe-k", "syslog", "WARNING", "Signature 4021, syn flood out of 198.51.100.9", "repeated, from 198.51.100.9:4445", 85, 20, 0),
    (9, "N-4", "box-m", "snmp", "ERROR", "Memory pool at 93%", "free list is short", 40, 93, 2),
    (30, "N-5", "gate-q", "api", "WARNING", "Site tunnel to the annex is down", "no answer from 192.0.2.200", 12, 15, 1),
    (31, "N-6", "acc-w", "syslog", "NOTICE", "Unexpected bpdu on port 12", "bridge id 8000.001a", 9, 10, 0),
    (95, "N-7", "phone-z", "syslog", "WARNING", "Voice queue is full", "40 calls waiting", 33, 30, 7),
    (96, "N-8", "lease-1", "syslog", "INFO", "Lease renewed for a printer", "offer repeated twice", 3, 5, 0),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "netsilt-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def raw_row(log_id, source, platform, severity, description, raw, cpu, mem, err, at, ip=""):
    metrics = {"cpu_usage": float(cpu), "memory_usage": float(mem), "interface_errors": float(err)}
    return (log_id, at, source, ip, platform, "", "", severity, description, raw, metrics, [], at)


def night_rows(minutes=None):
    minutes = minutes or {}
    return [raw_row(*row, at=START + timedelta(minutes=minutes.get(row[0], m)), ip=f"172.30.0.{10 * (i + 1)}")
            for i, (m, *row) in enumerate(NIGHT)]


@pytest.fixture(scope="session")
def night(spark):
    return spark.createDataFrame(night_rows(), RAW_LOG)


@pytest.fixture(scope="session")
def night_classified(night):
    from netsilt.operators.classify import classify

    return classify(night)
