import hashlib
import tempfile

import pytest

from emberlake.llm import warc as W

LONG = "<p>" + "é" * 100


def archive(spark, rows, schema="page_id long, url string, html string"):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/archive"
    W.write_archive(spark.createDataFrame(rows, schema), root)
    return root


def test_records_come_back_byte_for_byte(spark):
    rows = [(1, "http://a", "x"), (2, "http://b", LONG), (3, "http://b\r\nX: y", LONG), (4, None, None), (5, "u", ""), (6, "u", "x"), (7, "u", "y" * 300_000)]
    root = archive(spark, rows)
    for r in W.read_records(spark, root).collect():
        body = (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
        assert bytes(r.payload) == body and r.digest == hashlib.sha256(body).hexdigest()
        assert bytes(r.record) == bytes(r.header) + (b"" if r.page_id == 3 else body) + b"\r\n\r\n"
        assert bytes(r.header).startswith(b"WARC/1.1\r\n") and bytes(r.header).endswith(b"\r\n\r\n")
    facts = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in W.parse_records(W.read_records(spark, root)).collect()}
    assert facts == {1: ("response", None, 1), 2: ("response", None, 203), 3: ("revisit", 2, 203), 4: ("response", None, 0), 5: ("response", None, 0), 6: ("response", None, 1), 7: ("response", None, 300_000)}
    assert spark.read.parquet(f"{root}/payloads").count() == 4


def test_repeats_and_null_ids(spark):
    rows = [(None, "u", LONG, 1), (9, "u", LONG, 2), (9, "u", LONG, 3), (9, None, LONG, 4)]
    root = archive(spark, rows, "page_id long, url string, html string, digest int")
    facts = sorted((str(r.page_id), r.record_type, r.refers_to) for r in W.parse_records(W.read_records(spark, root)).collect())
    assert facts == [("9", "response", None), ("9", "revisit", 9), ("9", "revisit", 9), ("None", "revisit", 9)]


def test_empty_table(spark):
    root = archive(spark, [])
    assert W.parse_records(W.read_records(spark, root)).count() == 0


def test_damaged_payload_is_found(spark):
    root = archive(spark, [(1, "u", LONG)])
    bad = spark.read.parquet(f"{root}/payloads").selectExpr("digest", "binary('other') AS payload")
    bad = spark.createDataFrame(bad.collect(), bad.schema)
    bad.write.mode("overwrite").parquet(f"{root}/payloads")
    with pytest.raises(Exception, match="digest"):
        W.parse_records(W.read_records(spark, root)).collect()
