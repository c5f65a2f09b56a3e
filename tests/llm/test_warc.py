import base64
import gzip
import hashlib
import io
import random

import pytest

from tarn.llm import warc
from tarn.plans import state

SCHEMA = "page_id long, url string, html string, records string, sha1 int, first string, times long, copy string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) of each row, by dictionaries."""
    first, seen, out = {}, set(), []
    for i, _, t in rows:
        t = t or ""
        key = (i is None, i or 0)
        first[t] = min(first.get(t, key), key)
    for i, _, t in rows:
        t = t or ""
        own = (i is None, i or 0) == first[t] and t not in seen
        seen |= {t} if own else set()
        to = None if own or first[t][0] else first[t][1]
        out.append((i, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response" if own else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("<p>éa b\r\n日") for _ in range(n))
    rows = [(i, f"http://a.example/{i} x\ny", text(r.randrange(0, 900))) for i in range(60)]
    rows += [(i, "http://b.example/é", rows[7][2]) for i in range(60, 100)]  # a third are copies
    rows += [(100, None, text(70_000)), (101, "u", None), (102, "u", ""), (103, "u", ""), (3, "other", rows[7][2]), (None, "u", rows[8][2]), (None, None, text(50)), (105, "u", text(5000)), (105, "u", text(5000))]
    rows += [(104, "u", "again " * 40)] * 5 + [(-5, "u", rows[20][2]), (200, "u", "0\r\n\r\n"), (201, "u", "WARC/1.1\r\n\r\n")]
    return rows


def listed(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, "f", 2, "c") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("segment", [200, 1 << 20])
def test_pages_come_back(spark, pages, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(state, "HOT_ROWS", 10)
    monkeypatch.setattr(state, "HOT_SHARE", 0.1)
    folder = f"file://{tmp_path}/w"
    warc.write(frame(spark, pages), folder, segment, archive=8000)
    names = sorted(p.name for p in (tmp_path / "w").iterdir())
    assert len(names) > 3 and all(n.endswith(".warc.gz") for n in names)  # nothing but whole archives
    found = warc.captures(spark, folder).cache()
    assert not found.where("error is not null").count()
    assert sorted(map(tuple, warc.resolve(found).select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()), key=str) == plain(pages)
    texts = {r["payload"].decode() for r in found.where("type = 'response'").select("payload").collect()}
    assert texts == {t or "" for _, _, t in pages}
    assert (found.agg({"segments": "max"}).first()[0] > 100) == (segment == 200)


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write(frame(spark, pages), folder, least=260)
    got = warc.resolve(warc.captures(spark, folder, payloads=False)).collect()
    assert {r["type"] for r in got if r["payload_bytes"] < 260} == {"response"}
    want = [x for x in plain(pages) if x[1] >= 260]
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "type", "refers_to")) for r in got if r["payload_bytes"] >= 260), key=str) == want


def test_empty(spark, tmp_path):
    warc.write(frame(spark, [(1, "u", "x")]).limit(0), f"file://{tmp_path}/w")
    assert warc.resolve(warc.captures(spark, f"file://{tmp_path}/w")).count() == 0


def test_another_reader_agrees(spark, pages, tmp_path):
    """The archives as plain bytes: headers, lengths and order of segments, read without the operator."""
    warc.write(frame(spark, pages), f"file://{tmp_path}/w", 500)
    starts, parts, revisits = {}, {}, 0
    for p in (tmp_path / "w").iterdir():
        raw = gzip.decompress(p.read_bytes())
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            f = dict(x.split(": ", 1) for x in lines[1:])
            n = int(f["Content-Length"])
            block, end, raw = raw[:n], raw[n : n + 4], raw[n + 4 :]
            assert end == b"\r\n\r\n"
            if f["WARC-Type"] == "response":
                starts[f["WARC-Record-ID"]] = f
                parts.setdefault(f["WARC-Record-ID"], {})[1] = (block, None)
            elif f["WARC-Type"] == "continuation":
                parts.setdefault(f["WARC-Segment-Origin-ID"], {})[int(f["WARC-Segment-Number"])] = (block, f.get("WARC-Segment-Total-Length"))
            revisits += f["WARC-Type"] == "revisit"
    assert revisits == sum(r[3] == "revisit" for r in plain(pages))
    for identifier, own in parts.items():
        assert sorted(own) == list(range(1, len(own) + 1))
        block = b"".join(own[k][0] for k in sorted(own))
        assert len(own) == 1 or int(own[len(own)][1]) == len(block)
        body, payload = block.partition(b"\r\n\r\n")[2], b""
        while (size := int(body.partition(b"\r\n")[0], 16)):
            rest = body.partition(b"\r\n")[2]
            payload, body = payload + rest[:size], rest[size + 2 :]
        assert starts[identifier]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_broken_archives_are_told(spark, tmp_path):
    long = warc.response(1, "u", b"x" * 3000, 500)
    other = warc.response(2, "u", b"y" * 3000, 500)
    third = warc.response(3, "u", b"z" * 3000, 500)
    whole = gzip.decompress(warc.response(4, "u", b"w" * 90)[0])
    body = gzip.decompress(warc.response(5, "u", b"v" * 90)[0]).replace(b"5a\r\n", b"zz\r\n")
    wrong = gzip.decompress(warc.response(6, "u", b"t" * 90)[0]).replace(b"ttt", b"tTt")
    plain_body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nplain"
    plain_ = gzip.decompress(warc.record("response", "<urn:p>", plain_body, Page_ID=8))
    odd = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n5;name=value\r\nplain\r\n0\r\nTrailer: x\r\n\r\n"
    odd_ = gzip.decompress(warc.record("response", "<urn:q>", odd, Page_ID=9))
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*reversed(long), long[1], *other[:2], *other[3:], *third[:-1]]))
    (tmp_path / "b.warc").write_bytes(whole + body + wrong + plain_ + odd_ + b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    (tmp_path / "c.warc.gz").write_bytes(warc.response(7, "u", b"s" * 90)[0][:-30])
    (tmp_path / "notes.txt").write_text("no archive")
    got = {(r["page_id"], r["error"]): r for r in warc.captures(spark, f"file://{tmp_path}").collect()}
    assert got[1, None]["payload"] == b"x" * 3000 and got[1, None]["segments"] == len(long)
    assert got[4, None]["payload"] == b"w" * 90 and got[8, None]["payload"] == b"plain" == got[9, None]["payload"]
    assert {k for k in got if k[1]} == {
        (2, "segment 3 is missing"), (3, "the last segment is missing"), (5, "broken chunk"), (6, "the digest differs"), (None, "the record ends early"), (None, "the archive can't be read: EOFError"),
    }


def test_body_in_any_pieces():
    r = random.Random(1)
    payload = bytes(r.randrange(256) for _ in range(5000))
    whole = warc.HEAD + warc.chunked(payload, 700)
    for _ in range(20):
        body, at = warc.Body(keep=True), 0
        while at < len(whole):
            n = r.choice([1, 2, 3, 50, 900])
            body.feed(whole[at : at + n])
            at += n
        body.end()
        assert (body.error, body.size, b"".join(body.parts)) == (None, 5000, payload)
    assert list(warc.parse(io.BytesIO(b""))) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(warc.WarcSource)
    fails = spark.range(4, numPartitions=4).selectExpr("CASE WHEN id = 3 THEN CAST(raise_error('no') AS BINARY) ELSE CAST('x' AS BINARY) END AS data")
    with pytest.raises(Exception, match="no"):
        fails.write.format("tarn_warc").mode("append").save(f"file://{tmp_path}/w")
    assert not (tmp_path / "w").exists() or not list((tmp_path / "w").iterdir())
