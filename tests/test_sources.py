"""Readers, normalisers, result tables and report files."""

import json
from datetime import datetime

import pytest
from netsilt.operators import search
from netsilt.plans import analysis
from netsilt.schema import RAW_LOG
from netsilt.sources import payloads, readers, sinks
from netsilt.sources.syslog import parse_syslog
from pyspark.sql import functions as F

NOW = datetime(2025, 9, 2)
RECORDS = [
    {"log_id": "LOG-001", "timestamp": "2025-09-01T08:00:00Z", "source": "router", "severity": "warning",
     "description": "BGP session closed", "raw_message": "%BGP-4-PEER: y", "metrics": {"cpu_usage": 45, "bad": "x"}},
    {"source": "switch", "severity": None, "timestamp": "not a time"},
    {"description": "no time at all"},
]


def check(rows):
    by_source = {r["source"]: r for r in rows}
    assert len(rows) == 3
    full, few, none = by_source["router"], by_source["switch"], by_source[""]
    assert full["timestamp"] == datetime(2025, 9, 1, 8) and full["severity"] == "WARNING"
    assert full["metrics"] == {"cpu_usage": 45.0} and full["platform"] == "file" and full["component"] == "UNKNOWN"
    assert few["timestamp"] is None and few["severity"] == "INFO" and few["log_id"].startswith("LOG-")
    assert json.loads(few["raw_message"])["source"] == "switch"
    assert none["timestamp"] is not None


def test_json_array_and_lines(spark, tmp_path):
    array, lines = tmp_path / "logs.json", tmp_path / "logs.jsonl"
    array.write_text(json.dumps(RECORDS))
    lines.write_text("\n".join(json.dumps(r) for r in RECORDS) + "\n\n")
    for path in (array, lines):
        df = readers.read_logs(spark, str(path))
        assert df.columns == RAW_LOG.names
        check(df.collect())


def test_syslog_file(spark, tmp_path):
    path = tmp_path / "messages.log"
    path.write_text("<34>Mar 07 21:10:05 edge-a %BGP-4-PEER: session with 192.0.2.9 closed\n\n"
                    "  \t<999999999999999999999>long priority firewall \nno priority\n<7>" + "x" * 300 + "\n")
    rows = {r["raw_message"][:6]: r for r in readers.read_logs(spark, str(path)).collect()}
    assert len(rows) == 4
    bgp = rows["<34>Ma"]
    assert (bgp["severity"], bgp["component"], bgp["platform"], bgp["source_ip"]) == ("CRITICAL", "BGP", "syslog", "file")
    assert rows["<99999"]["severity"] == "DEBUG" and rows["<99999"]["component"] == "SECURITY"
    assert rows["no pri"]["severity"] == "INFO" and rows["no pri"]["component"] == "UNKNOWN"
    assert len(rows["<7>xxx"]["description"]) == 200 and len(rows["<7>xxx"]["raw_message"]) == 303


def test_api_records(spark):
    text = spark.createDataFrame([(json.dumps({"severity": "warning", "tags": ["a"]}),)], "t string")
    row = readers.api_logs(readers.with_record(text, "t")).first()
    assert (row["log_id"], row["platform"], row["component"], row["severity"], row["raw_message"]) == (
        "", "api", "", "warning", "")
    filled = readers.with_ids(readers.api_logs(readers.with_record(text, "t"), NOW)).first()
    assert filled["log_id"].startswith("LOG-")


def test_rest_shapes_and_cap(spark):
    item = {"message": "m", "metrics": {"cpu_usage": 1}}
    texts = [json.dumps([item]), json.dumps({"results": [item, item]}), json.dumps({"logs": [item] * 3}), json.dumps({})]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    rows = payloads.normalise(df, "rest", default_source="http://x").collect()
    assert len(rows) == 6 and {r["source"] for r in rows} == {"http://x"} and {r["description"] for r in rows} == {"m"}
    assert payloads.normalise(df, "rest", batch_size=2).count() == 5


def test_zabbix_and_unknown(spark):
    text = json.dumps({"result": [{"clock": "0", "hosts": [], "severity": "5", "name": "n"},
                                  {"clock": "60", "hosts": [{"host": "h"}], "severity": "9"}]})
    df = spark.createDataFrame([(text,)], "payload string")
    rows = sorted(payloads.normalise(df, "zabbix").collect(), key=lambda r: r["source"])
    assert [(r["source"], r["severity"], r["timestamp"]) for r in rows] == [
        ("h", "INFO", datetime(1970, 1, 1, 0, 1)), ("unknown", "CRITICAL", datetime(1970, 1, 1))]
    empty = payloads.normalise(df, "prtg")
    assert empty.count() == 0 and empty.columns == RAW_LOG.names


def test_merge(spark):
    lines = spark.createDataFrame([("<1>a",)], "m string")
    merged = readers.merge_sources(parse_syslog(lines, "m", F.lit("x")), parse_syslog(lines, "m", F.lit("y")))
    assert merged.count() == 2


def test_store_and_search(spark, night_classified, tmp_path):
    store = str(tmp_path / "store")
    sinks.append_logs(night_classified.limit(0), store)
    sinks.append_logs(night_classified, store)
    logs = sinks.read_table(spark, store, "classified_logs")
    assert logs.count() == 8
    found = search.search_logs(logs, limit=1, offset=1, category="security", severity="critical", source="PROBE")
    assert found["total"].first()["total"] == 1 and found["logs"].count() == 0
    assert search.log_by_id(logs, "N-4").first()["category"] == "HARDWARE"
    out = analysis.analyse_classified(logs, analysis.at("2025-03-10 00:00:00"))
    for _ in range(2):  # replacing is repeatable
        sinks.replace_results(store, security_threats=out.tables["threats"], anomaly_results=out.tables["anomalies"])
    assert sinks.read_table(spark, store, "security_threats").count() == 1
    assert search.anomaly_view(out.tables["anomalies"])["total"].first()["total"] == 0
    assert search.threat_view(out.tables["threats"])["summary"].count() > 4
    with pytest.raises(ValueError):
        sinks.table_path(store, "other")


def test_report_files(spark, night_classified, tmp_path):
    report = analysis.analyse_classified(night_classified, analysis.at("2025-03-10 00:00:00")).report(
        analysis.at("2025-03-10 00:00:00"))
    paths = sinks.write_report(report, str(tmp_path), NOW)
    saved = spark.read.json(paths["json"]).first()
    assert saved["overall_health_score"] == 83.5 and saved["summary"]["total_logs"] == 8
    assert spark.read.json(paths["sections"]).filter("section = 'recommendations'").count() == 1


def test_whole_run_reuses_base(spark, night):
    out = analysis.analyse(night, analysis.at("2025-03-10 00:00:00"))
    assert out.base.is_cached and out.enriched().count() == 8 and out.correlations().count() == 3
    out.report(analysis.at("2025-03-10 00:00:00")).collect()
    out.release()
    assert not out.base.is_cached and not out.kept


def test_equal_lines_are_different_logs(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("<34>same line\n" * 3 + "<34>other\n" * 4)
    logs = readers.read_logs(spark, str(path))
    ids = [r["log_id"] for r in logs.collect()]
    assert len(set(ids)) == len(ids) == 7 and ids == [r["log_id"] for r in logs.select("log_id").collect()]
    frame = spark.createDataFrame([("same",)] * 5, "message string")
    from netsilt.sources.syslog import parse_syslog
    assert parse_syslog(frame, "message", F.lit("x")).select("log_id").distinct().count() == 5


def test_array_file_keeps_unknown_fields(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"note": "port scan seen"}, {"severity": "error", "x": 1}]')
    assert sorted(r["raw_message"] for r in readers.read_logs(spark, str(path)).collect()) == [
        '{"note":"port scan seen"}', '{"severity":"error","x":1}']


def test_all_items_of_a_response(spark):
    payload = "[" + ",".join('{"source": "s%d"}' % k for k in range(600)) + "]"
    df = spark.createDataFrame([(payload,)], "payload string")
    assert payloads.normalise(df, "rest").count() == 600
    assert payloads.normalise(df, "rest", batch_size=500).count() == 500
