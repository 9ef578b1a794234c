"""Archives read back, and the order of the index."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from netsilt.llm import warc as W
from netsilt.llm.common import new_folder

SCHEMA = "page_id long, url string, html string"


def test_loser_tree():
    rng = random.Random(1)
    for runs in range(12):
        lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(runs)]
        assert list(W.LoserTree(lists, lambda x: x)) == sorted(x for run in lists for x in run)


def test_url_key():
    assert W.url_key("http://A.Example.com:80/p/q?x=1#top") == "com,example,a)/p/q?x=1"
    assert W.url_key("") == ")/" and W.url_key("http://[bad") == "http://[bad"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    big = ["<p>" + "é" * 600 + str(k) for k in range(5)]
    rows = [(k, f"http://h{rng.randrange(4)}.example.com/{rng.randrange(9)}", rng.choice(big) if rng.random() < 0.5 else f"small {k % 7}")
            for k in range(400)]
    return rows + [(1000, None, None), (1001, "a\r\nWARC-Type: x", "\r\n\r\n"), (1002, "http://h/", ""), (None, "http://h/", big[0]),
                   (None, "http://h/", "z" * 2000), (1003, "u", "y" * 2_000_000), (5000, "u", big[1]), (5000, "u", big[1])]


def test_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 20_000)
    df = spark.createDataFrame(pages, SCHEMA).repartition(3).withColumn("digest", F.lit("clash")).withColumn("run", F.lit(1))
    history, folder = W.archive(df, F.timestamp_seconds(F.col("page_id")))
    got = W.read_archives(history, folder, payloads=True).collect()
    largest = {}
    for i, _, html in pages:
        if html and len(html.encode()) >= 1000 and i is not None:
            largest[html] = max(i, largest.get(html, i))
    want = []
    for i, _, html in pages:
        payload = (html or "").encode()
        to = largest.get(html)
        to = None if to == i else to
        want.append((str(i), len(payload), hashlib.sha1(payload).hexdigest(), "response" if to is None else "revisit", str(to),
                     payload if to is None else None))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to),
                    None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    index = history.orderBy("range", "place").collect()
    keys = [(r.url_key, r.stamp, r.page_id is None, r.page_id or 0) for r in index]
    assert keys == sorted(keys) and len({r.run for r in index}) > 3
    assert len({(r.run, r.start) for r in index}) == len(pages)


def test_empty_table(spark):
    history, folder = W.archive(spark.createDataFrame([], SCHEMA), F.lit(None).cast("timestamp"), new_folder(spark, "warc"))
    assert W.read_archives(history, folder).collect() == []


def test_changed_payload_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "x" * 10)], SCHEMA)
    history, folder = W.archive(df, F.lit(None).cast("timestamp"))
    entry = history.first()
    system, path = W.filesystem(folder)
    raw = system.open_input_file(f"{path}/{entry.run}").read()
    broken = W.warc_record(1, "u", "19700101000000", b"y" * 10, hashlib.sha1(b"x" * 10).digest(), None)
    with system.open_output_stream(f"{path}/{entry.run}", compression=None) as f:
        f.write(broken + b"\0" * (len(raw) - len(broken)))
    with pytest.raises(Exception, match="does not have its digest"):
        W.read_archives(history, folder).collect()
