import base64
import hashlib

from genospark.llm import warc_archive as W
from genospark.llm.storage import Scratch

ROWS = [(1, "http://a/", "x" * 50), (2, "http://b/", "x" * 50), (3, None, None), (4, "http://c d\n/", ""), (5, "http://é/", "é<html>\r\n\r\nWARC/1.0\r\n"), (5, "http://é/", "é<html>\r\n\r\nWARC/1.0\r\n"), (6, "u", "z" * 200_000), (None, "n", "x" * 50)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, tmp_path):
    scratch = Scratch(spark, "w")
    heads, payloads = W.write_archive(pages(spark), scratch)
    assert payloads.count() == 4  # one per distinct payload
    got = W.read_archive(heads, payloads, contents=True).collect()
    assert len(got) == len(ROWS)
    largest = {}
    for i, _, h in ROWS:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    by = {i: h or "" for i, _, h in ROWS}
    for r in got:
        payload = by[r["page_id"]].encode()
        assert bytes(r["payload"]) == payload and r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        response = largest[payload.decode()] == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", largest[payload.decode()]))
        assert bytes(r["record"]).endswith(b"\r\n\r\n") and (payload in bytes(r["record"])) >= response
    W.export_warc(W.read_archive(heads, payloads, contents=True), str(tmp_path / "warc"))
    again = W.import_warc(spark, str(tmp_path / "warc"))
    mine = sorted((bytes(r["head"]), bytes(r["payload"])) for r in again.collect())
    want = sorted((bytes(r["record"])[: -4 - len(p)], p) for r in got for p in [bytes(r["payload"]) if r["record_type"] == "response" else b""])
    assert mine == want


def test_changed_payload_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    heads, payloads = W.write_archive(pages(spark, ROWS[:2]), Scratch(spark, "w"))
    with pytest.raises(Exception, match="changed"):
        W.read_archive(heads, payloads.withColumn("payload", F.lit(b"y"))).collect()


def test_empty(spark):
    assert W.read_archive(*W.write_archive(pages(spark, []), Scratch(spark, "w"))).count() == 0


def test_no_payload_is_shuffled_to_be_read(spark):
    """The tables' buckets meet without an exchange, so a record is rebuilt where its payload lies."""
    heads, payloads = W.write_archive(pages(spark), Scratch(spark, "w"))
    got = W.read_archive(heads.where("response"), payloads, contents=True)
    got.collect()
    responses = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in responses and "Exchange" not in responses
