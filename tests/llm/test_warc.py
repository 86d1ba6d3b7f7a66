import gzip
import hashlib
import base64
import random
import zlib

import pytest

from newsloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_records_in_pieces_of_any_size():
    members = [warc.pack(i, 0, f"http://x/{i} y", f"<p>é{i}</p>\r\n\r\n".encode() * i, (0, 0) if i % 3 == 2 else None) for i in range(8)]
    assert all(m[-1] == 0 and gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in members)
    data = b"".join(members)
    for size in (1, 7, 100, len(data)):
        found = list(warc.records(data[i:i + size] for i in range(0, len(data), size)))
        assert [r.kind for r in found] == ["revisit" if i % 3 == 2 else "response" for i in range(8)]
        assert found[1].block.endswith("<p>é1</p>\r\n\r\n".encode()) and found[2].headers["warc-refers-to"] == "<urn:page:0:0>"


def test_long_record_ends_in_zero():
    payload = random.Random(1).randbytes(1 << 24)
    member = warc.pack(1, 0, None, payload, None)
    assert member[-1] == 0
    record, = warc.records(iter([member]))
    assert record.block.endswith(payload)


@pytest.mark.parametrize("harm", [lambda b: b[:-9], lambda b: b[:40] + b"\xff" + b[41:]])
def test_broken_archives_are_errors(harm):
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(iter([harm(warc.pack(1, 0, "u", b"payload" * 50, None))])))


def test_wrong_digests_are_errors():
    plain = gzip.decompress(warc.pack(1, 0, "u", b"payload", None))
    for a, b in ((b"payload\r\n", b"paYload\r\n"), (b"Content-Length: 94", b"Content-Length: 93")):
        if a in plain:
            with pytest.raises(ValueError):
                warc.parse(plain.replace(a, b))


def expected(rows, least=0):
    groups = {}
    for p, _, h in rows:
        groups.setdefault(h or "", []).append(p)
    out = []
    for h, ids in groups.items():
        ids.sort(key=lambda p: (p is None, p))
        data = h.encode()
        for n, p in enumerate(ids):
            revisit = n > 0 and len(data) >= least
            out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(1, "http://a", "<p>one</p>"), (5, None, "two"), (3, "http://c", "<p>one</p>"), (2, "u", "two"), (9, "u", None), (8, "u", ""),
            (7, "u 7\n", "größe\x00\r\n\r\n"), (None, "n", "two"), (None, "n", "only here"), (4, "a", "x" * 300000), (6, "d", "rep"), (6, "d", "rep"), (6, "e", "rep"), (3, "q", "longer again"), (3, "q", "longer again")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copy", "2 as payload")
    got = warc.round_trip(df, min_bytes=least)
    keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*keys).collect()), key=str) == expected(rows, least)
    for r in got.filter("record_type = 'response'").collect():
        assert len(r.payload) == r.payload_bytes
    assert len({(r.page_id, r.copy, bytes(r.payload_digest, "ascii")) for r in got.collect()}) == len(rows)


def test_archives_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], SCHEMA)
    warc.write(df, f"file://{tmp_path}/w", most_records=7)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 7 and sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: response") for f in files) == 50


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
