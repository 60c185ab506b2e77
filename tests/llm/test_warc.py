"""Archives written and read back, their pages against brute force, and what the reader leaves undecoded."""

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from fieldloom.llm import queries, warc  # noqa: E402

SCHEMA = "page_id long, url string, html string, payload string, sha string"


def odd_pages():
    long = "<p>ü" * 200_000
    texts = [None, "", "", "same", "same", "same", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "a\r\n\r\nb", long, long, "ünï", "\x00\r\n\r\n"]
    rows = [(n * 3 % 17, f"https://a.example/{n}", t) for n, t in enumerate(texts)]
    rows += [(None, "https://b.example/", "same"), (None, None, "alone"), (40, "x\r\nWARC-Type: revisit\r\ny", "own"), (41, "", "twice"), (41, "", "twice"), (42, "é", "twice")]
    return rows


def expected(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        payload = (t or "").encode()
        again = len(payload) >= least and first.get(t or "", i) != i
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if again else "response", first[t or ""] if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, compression, least):
    rows = odd_pages()
    place = warc.write_pages(frame(spark, rows).repartition(3), str(tmp_path / "archive"), least, compression=compression, fileBytes="50000")
    back = warc.read_archives(spark, place, verify="true", partitionBytes="100000").where("record_type != 'warcinfo'").cache()
    found = back.select(warc.page_id("record_id").alias("i"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("r")).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows, least)
    kept = {(t or "").encode() for _, _, t in rows}
    assert {bytes(r.payload) for r in back.where("record_type = 'response'").collect()} == kept
    assert back.where("record_type = 'revisit' and payload is not null").count() == 0
    assert back.where("target_uri like 'x\\%0D\\%0AWARC-Type%'").count() == 1


def test_query(spark, tmp_path):
    frame(spark, odd_pages()).write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op12_warc(spark, str(tmp_path))
    assert sorted((tuple(r[n] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found.collect()), key=str) == expected(odd_pages())
    frame(spark, []).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert queries.op12_warc(spark, str(tmp_path / "none")).count() == 0


def test_filters_are_pushed_and_payloads_left(spark, tmp_path):
    rows = [(n, f"https://a.example/{n % 5}", "same" if n % 2 else f"page {n}") for n in range(40)]
    place = warc.write_pages(frame(spark, rows), str(tmp_path / "archive"))
    all_of = warc.read_archives(spark, place)
    pushed = all_of.where("record_type = 'revisit' and target_uri like 'https://a.example/3%' and payload_bytes > 2")
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    # Only what needs the HTTP header is left to Spark.
    assert "payload_bytes" in plan.split("Filter")[1].split("\n")[0] and "record_type" not in plan.split("Filter")[1].split("\n")[0].split("payload_bytes#")[0]
    # Of the 20 odd pages, 3, 13, 23 and 33 have this url.
    assert pushed.count() == 4 and all_of.where("refers_to is null and record_type in ('response', 'warcinfo')").where("not record_type = 'warcinfo'").count() == 21
    reader = warc.WarcReader(all_of.schema, {"path": place})
    files, _ = warc.opened(place)
    for columns, verify, decoded in ((True, False, 21), (False, False, 0), (False, True, 21)):
        counts = {}
        for path, size in warc.listed(place):
            with files.open_input_file(path) as source:
                list(warc.records(source, size, lambda f: f["record_type"] in ("response", "revisit"), columns, True, verify, counts))
        assert counts.get("payloads", 0) == decoded and counts["headers"] == 40 + len(warc.listed(place))
    assert len(reader.partitions()) == 1 and len(warc.WarcReader(all_of.schema, {"path": place, "partitionBytes": "1"}).partitions()) == len(warc.listed(place))


def test_filter_values():
    found = {c: None for c in warc.FIELDS} | {"record_type": "response", "content_length": 7}
    one = lambda kind, c, *v: kind((c,), *v)
    assert warc.holds(one(warc.EqualTo, "record_type", "response"), found) and warc.holds(one(warc.LessThan, "content_length", 8), found)
    assert warc.holds(one(warc.EqualTo, "refers_to", "x"), found) is None and warc.holds(warc.Not(one(warc.EqualTo, "refers_to", "x")), found) is None
    assert warc.holds(one(warc.IsNull, "refers_to"), found) and not warc.holds(one(warc.IsNotNull, "refers_to"), found)
    assert warc.holds(one(warc.EqualNullSafe, "refers_to", None), found)
    assert not warc.on_header(one(warc.In, "record_type", ("a", None))) and not warc.on_header(one(warc.EqualTo, "payload_bytes", 3))


def test_foreign_archives(spark, tmp_path):
    """Members without lengths, several headers' worth of other records, one file by its path."""
    body = [warc.record_bytes({"record_type": t, "record_id": f"<urn:x:{n}>", "content_type": "text/plain"}, b"z" * size) for n, (t, size) in enumerate([("warcinfo", 3), ("resource", 200_000), ("metadata", 0), ("resource", 5)])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(b) for b in body))
    (tmp_path / "b.warc").write_bytes(b"".join(body))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    both = warc.read_archives(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert sorted((r.record_id, r.payload_bytes, len(r.payload)) for r in both) == sorted([("<urn:x:1>", 200_000, 200_000), ("<urn:x:3>", 5, 5)] * 2)
    assert warc.read_archives(spark, str(tmp_path / "a.warc.gz"), "record_type string").count() == 4
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.warc.gz").write_bytes((tmp_path / "a.warc.gz").read_bytes()[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()


def test_lost_attempts_and_damage(spark, tmp_path):
    place = warc.write_pages(frame(spark, [(1, "u", "text"), (2, "v", "more")]).coalesce(1), str(tmp_path / "archive"))
    (tmp_path / "archive" / "late-attempt.warc.gz").write_bytes(b"half a file")
    assert warc.read_archives(spark, place, verify="true").count() == 3
    warc.write_pages(frame(spark, [(3, "w", "third")]).coalesce(1), place)
    assert warc.read_archives(spark, place).where("record_type = 'response'").count() == 3
    writer = warc.WarcWriter({"path": place})
    left = writer.write(iter([pa.RecordBatch.from_pylist([dict(record_type="response", record_id="<x>", target_uri=None, refers_to=None, payload_digest=b"1" * 20, payload_bytes=1, payload=b"a")])]))
    assert (tmp_path / "archive" / left.names[0]).exists()
    writer.abort([None])
    assert not (tmp_path / "archive" / left.names[0]).exists()
    damaged = warc.WarcWriter({"path": str(tmp_path / "bad"), "compression": "none"})
    damaged.folder = "file://" + damaged.folder
    damaged.commit([damaged.write(iter([pa.RecordBatch.from_pylist([dict(record_type="response", record_id="<x>", target_uri=None, refers_to=None, payload_digest=b"1" * 20, payload_bytes=1, payload=b"a")])]))])
    assert warc.read_archives(spark, str(tmp_path / "bad"), "record_id string").count() == 2
    with pytest.raises(Exception, match="is damaged"):
        warc.read_archives(spark, str(tmp_path / "bad"), "record_id string", verify="true").collect()
