import io

import pytest
from llm_cases import folder
from pyspark.sql import functions as F

from evalspark.llm import op2_warc_chunks as op

RECORDS = "record_id string, rank bigint, target string, payload binary, record_type_x string"


def test_round_trip_by_chunks(spark, tmp_dir):
    payloads = {"a": b"x" * 3000, "b": b"x" * 3000, "c": b"", "d": None, "e": b"\r\n\r\nWARC/1.1\r\n" * 300,
                "f": bytes(range(256)) * 20, "g": b"small", "h": b"small"}
    rows = [(k, i, None if k == "b" else f"http://{k}\r\n", v, "extra")
            for i, (k, v) in enumerate(payloads.items())]
    records = op.mark_revisits(spark.createDataFrame(rows, RECORDS))
    manifest = op.write_archives(op.to_chunks(records, 700), tmp_dir + "/w")
    assert manifest.agg(F.sum("records")).first()[0] == len(payloads)
    chunks = op.read_archives(manifest, 512)
    got = {}
    for r in chunks.orderBy("record_id", "chunk_no").collect():
        assert len(r["chunk"]) <= 512
        got[r["record_id"]] = got.get(r["record_id"], b"") + bytes(r["chunk"])
    assert got == {k: b"" if k == "a" else v or b"" for k, v in payloads.items()}
    done = {r["record_id"]: r for r in op.checked(chunks).collect()}
    assert done["a"]["record_type"] == "revisit" and done["a"]["refers_to"] == "b"
    assert done["a"]["payload_bytes"] == 3000 and done["a"]["payload_digest"] == done["b"]["payload_digest"]
    assert done["g"]["record_type"] == done["h"]["record_type"] == "response"  # under 1000 bytes


def test_damage_is_seen():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: 9\r\n\r\n"
    rows = list(op.read_records(io.BytesIO(head + b"123456789\r\n\r\n"), 4))
    assert [r[7] for r in rows] == [b"1234", b"5678", b"9"] and rows[-1][-1]
    with pytest.raises(ValueError):
        list(op.read_records(io.BytesIO(head + b"1234"), 4))
    with pytest.raises(ValueError):
        list(op.read_records(io.BytesIO(b"junk\r\n"), 4))


def test_wrong_digest_fails(spark, tmp_dir):
    records = spark.createDataFrame([("a", "response", "t", None, b"xy")],
                                    "record_id string, record_type string, target string, refers_to string, payload binary")
    chunks = op.to_chunks(records).withColumn("digest", F.lit("00"))
    with pytest.raises(Exception, match="digest differs"):
        op.checked(op.read_archives(op.write_archives(chunks, tmp_dir + "/w"))).collect()


def test_query_on_odd_pages(spark, tmp_dir):
    big = "y" * 1200
    pages = spark.createDataFrame([(1, "u", big, 0), (5, "u", big, 0), (5, "u", big, 0), (None, None, big, 0),
                                   (7, "u", None, 0), (8, "u", "", 0)],
                                  "page_id bigint, url string, html string, payload int")
    got = op.query(spark, folder(spark, tmp_dir, pages=pages)).collect()
    assert len(got) == 6 and sum(r["record_type"] == "response" for r in got) == 3
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {5}
    empty = folder(spark, tmp_dir, "e", pages=pages.limit(0))
    assert op.query(spark, empty).collect() == []
