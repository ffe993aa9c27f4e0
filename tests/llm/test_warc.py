import hashlib

import pytest

from sitespec.llm.warc import candidate_records, packed, read_archives, record, warc_round_trip, with_revisits, write_archives

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nHello\r\n\r\n"
SCHEMA = "page_id long, url string, html string, archive int"


def expected(rows):
    first = {}
    for page_id, _, html, _ in rows:
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(page_id, first.get(html, page_id))
    out = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        refers = first.get(html) if page_id is not None and len(data) >= 100 and first[html] < page_id else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def rows():
    long, magic = "é<p>" + "x" * 200, "a\r\n\r\n" + FAKE * 3 + "WARC/1.0\r\n"
    return [
        (1, "u1", long, 0), (2, "u2", long, 0), (9, None, long, 0), (3, "a\r\nb", None, 1), (4, "", "", 1), (5, "u", "short", 1),
        (6, "u", "short", 1), (7, "m", magic, 1), (8, "m", magic, 1), (None, "n", long, 1), (10, "f", FAKE * 40, 1),
        (11, "v", "y" * 300_000, 2), (12, "q", "q" * 99, 2), (13, "q", "q" * 99, 2), (14, "e", "é" * 50, 2), (15, "e", "é" * 50, 2),
        (1, "u1", long, 3),
    ]


@pytest.mark.parametrize("size, level", [(3000, None), (3000, 0), (1 << 20, 5)])
def test_round_trip_whatever_the_ranges(spark, tmp_path, size, level):
    docs = spark.createDataFrame(rows(), SCHEMA)
    archives = write_archives(with_revisits(docs).repartition(2), f"file://{tmp_path}/a", archive_bytes=100_000, level=level)
    got = read_archives(archives, range_bytes=size)
    keep = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, keep), key=str) == expected(rows())
    assert 99 not in {r.page_id for r in keep}


def test_members_inside_a_payload_are_not_records(spark, tmp_path):
    inner = packed(record(99, "x", b"inside", hashlib.sha256(b"inside").hexdigest(), None), 0)
    payload = b"a" * 300 + inner * 30
    data = b"".join(packed(record(k, "u", payload, hashlib.sha256(payload).hexdigest(), None), 0) for k in range(5))
    (tmp_path / "x.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "archive string, size long")
    assert candidate_records(archives, 4000).count() > 100
    assert sorted(r.page_id for r in read_archives(archives, 4000).collect()) == list(range(5))


def test_empty(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_broken_chain_is_found(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    archives = write_archives(with_revisits(docs).coalesce(1), f"file://{tmp_path}/b", level=None)
    path = archives.first()["archive"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    k = data.find(b"WARC/1.0\r\n", 400)
    data[k] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="broken chain"):
        read_archives(archives)
