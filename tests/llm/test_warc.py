import base64
import glob
import gzip
import hashlib
import io

from pyspark.sql import functions as F

import pytest

from sparkloom.llm import warc
from sparkloom.llm.warc import base32_sha1, checked_records, read_records, read_warc, verify, write_warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_and_revisits(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://x\r\ny", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "n", "only"), (6, "l", "x" * 200_000)]
    write_warc(pages(spark, rows), f"file://{tmp_path}/w")
    got = {r.record_id: r for r in read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert len(got) == 7
    for i, _, html in rows:
        r, data = got[f"urn:row:{'null' if i is None else i}"], (html or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == ("revisit" if i in (2, 4) else "response")
        assert r.refers_to == {2: "urn:row:1", 4: "urn:row:3"}.get(i)
        assert r.payload is None if i in (2, 4) else bytes(r.payload) == data and verify(r.asDict())
    assert got["urn:row:4"].target_uri == "http://x%0D%0Ay" and got["urn:row:3"].target_uri == "urn:none"


def test_small_payloads_are_responses(spark, tmp_path):
    write_warc(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), f"file://{tmp_path}/w", revisit_from=3)
    assert sorted((r.record_id[-1], r.record_type) for r in read_warc(spark, f"file://{tmp_path}/w").collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_hot_payload(spark, tmp_path):
    write_warc(pages(spark, [(i, "u", "same" if i % 3 == 0 else f"p{i}") for i in range(90)]), f"file://{tmp_path}/w")
    df = read_warc(spark, f"file://{tmp_path}/w")
    assert df.where("record_type = 'revisit'").count() == 29 and df.where("refers_to = 'urn:row:0'").count() == 29


def test_empty(spark, tmp_path):
    write_warc(pages(spark, []), f"file://{tmp_path}/w")
    assert read_warc(spark, f"file://{tmp_path}/w").count() == 0


def test_filters_are_pushed_and_skipped_blocks_are_not_read(spark, tmp_path):
    write_warc(pages(spark, [(i, "u", f"p{i}") for i in range(20)]), f"file://{tmp_path}/w")
    df = read_warc(spark, f"file://{tmp_path}/w").where("record_type = 'response'").where(F.col("record_id").isin("urn:row:3", "urn:row:4"))
    assert sorted(bytes(r.payload) for r in df.collect()) == [b"p3", b"p4"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter " not in plan

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    block = b"HTTP/1.1 200 OK\r\nContent-Length: 1000\r\n\r\n" + b"y" * 1000
    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    data = record % b"request" + record % b"response"
    stream = io.BufferedReader(Counting(data), 16)
    assert [r["record_type"] for r in read_records(stream, {"record_type": {"response"}}, False)] == ["response"]
    assert Counting.taken < 200


def test_payloads_that_nobody_asks_for_are_not_read(spark, tmp_path):
    write_warc(pages(spark, [(i, "u", f"p{i % 7}") for i in range(20)]), f"file://{tmp_path}/w")
    names = ["record_id", "record_type", "payload_bytes"]
    df = read_warc(spark, f"file://{tmp_path}/w", names)
    assert df.columns == names and df.count() == 20 and df.where("record_type = 'revisit'").count() == 13
    reader = warc.WarcReader("p", warc.StructType([warc.SCHEMA[c] for c in names]))
    assert "payload" not in reader.names


def test_payloads_are_held_against_their_headers(spark, tmp_path):
    write_warc(pages(spark, [(i, "u", f"page {i % 7}") for i in range(20)]), f"file://{tmp_path}/w")
    found = checked_records(spark, f"file://{tmp_path}/w").collect()
    assert len(found) == 20 and sum(r.record_type == "revisit" for r in found) == 13
    for f in tmp_path.glob("w/part-*"):
        f.write_bytes(f.read_bytes().replace(b"page 3", b"page 8"))
        for crc in tmp_path.glob("w/.part-*.crc"):
            crc.unlink()
    with pytest.raises(Exception, match="differs from its header"):
        checked_records(spark, f"file://{tmp_path}/w").collect()


def test_stores_that_only_spark_reaches(spark, tmp_path):
    rows = [(i, "u", f"page {i % 7}") for i in range(20)] + [(90, "u", None), (91, "l", "x" * 300_000)]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./warc", f"file://{tmp_path}")
    write_warc(pages(spark, rows), "viewfs://store/warc/w")
    assert not warc._opens("viewfs://store/warc/w") and warc._opens(f"file://{tmp_path}/w")
    there, here = (sorted(map(repr, read_warc(spark, p).collect())) for p in ("viewfs://store/warc/w", f"file://{tmp_path}/w"))
    assert there == here and len(there) == 22
    assert sorted(map(repr, checked_records(spark, "viewfs://store/warc/w").collect())) == sorted(map(repr, checked_records(spark, f"file://{tmp_path}/w").collect()))


def test_large_archives_are_split(spark, tmp_path):
    write_warc(pages(spark, [(i, "u", f"p{i}") for i in range(40)]).coalesce(1), f"file://{tmp_path}/w", most_records=10)
    assert len(list(tmp_path.glob("w/part-*"))) >= 4 and read_warc(spark, f"file://{tmp_path}/w").count() == 40


def test_gzip_members_and_other_records(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one))
    assert sorted((r.record_type, bytes(r.payload)) for r in read_warc(spark, str(tmp_path)).collect()) == [("resource", b"hello"), ("warcinfo", b"a: b")]


def test_base32(spark):
    rows = spark.createDataFrame([(x,) for x in ["", "a", "é" * 99]], "s string").select("s", base32_sha1(F.col("s")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.s.encode()).digest()).decode() for r in rows)


def test_file_names(spark, tmp_path):
    write_warc(pages(spark, [(1, "u", "p")]), f"file://{tmp_path}/w")
    assert glob.glob(f"{tmp_path}/w/part-*")
