"""WARC archives: writing pages with revisit records, and reading them back by verified record boundaries.

Reading trusts no magic bytes: a payload may hold whole records. Tasks over byte ranges emit, for each place that
looks like a record, where the next record would begin; only what the chain of successors reaches from the start
of a file is a record.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import fresh_folder, materialize, nonce

#: Payloads below this size are never replaced by a revisit record.
LEAST_REVISIT = 100
#: Bytes of an archive after which a task begins the next one, and of a range that one reading task takes.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: Copies of the narrow table of repeated payloads that a large group of equal payloads is spread over.
SALTS = 32
_MAGIC, _MEMBER = b"WARC/1.0\r\n", b"\x1f\x8b\x08"
#: Level of the compression of records, each a member by itself as the format asks; None writes them plain.
LEVEL = 5
#: A header block longer than this is not one; records written here have some hundred bytes and the URL.
HEADER_BYTES = 1 << 20
_FIELD = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PAGE = "urn:page:"
RECORDS = (
    "archive string, offset long, record_type string, page_id long, refers_to long, url string,"
    " payload_bytes long, payload_digest string, header_digest string"
)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, payload, payload_digest, refers_to).

    Of rows with equal payloads of at least ``least`` bytes the smallest page_id is the response (refers_to NULL),
    the others refer to it. NULL html is the empty payload; rows without page_id are responses, and nothing
    refers to them. Digests are counted before they are joined, only repeated ones are kept, and these are
    repeated per salt, so that a payload held by a third of all pages is spread over many tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"), F.length(payload).alias("n"))
    repeated = (
        narrow.filter(F.col("n") >= least).groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).filter("n > 1 and first_id is not null")
        .select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(repeated, ["payload_digest", "_salt"], "left")
    refers = F.when(F.col("first_id") < F.col("page_id"), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def _header(fields: list[tuple[bytes, object]], size: int) -> bytes:
    lines = [_MAGIC, *(b"%s: %s\r\n" % (k, v if isinstance(v, bytes) else str(v).encode()) for k, v in fields if v is not None)]
    return b"".join([*lines, b"Content-Length: %d\r\n\r\n" % size])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = _header(
        [
            (b"WARC-Type", "response" if refers_to is None else "revisit"),
            (b"WARC-Record-ID", None if page_id is None else f"<{PAGE}{page_id}>"),
            (b"WARC-Target-URI", None if url is None else re.sub(rb"[\r\n]", b" ", url.encode())),
            (b"WARC-Refers-To", None if refers_to is None else f"<{PAGE}{refers_to}>"),
            (b"WARC-Payload-Digest", f"sha256:{digest}"),
            (b"Content-Type", "application/http;msgtype=response"),
        ],
        len(block),
    )
    return head + block + b"\r\n\r\n"


def packed(data: bytes, level: int | None = LEVEL) -> bytes:
    """A record as it stands in the archive: a gzip member of its own, or plain."""
    return data if level is None else zlib.compress(data, level, 31)


def write_archives(
    rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int | None = LEVEL
) -> DataFrame:
    """Write rows of ``with_revisits`` as archives below ``folder``; return their list (archive, size).

    Each task writes archives of its own, under names that no other attempt uses, and an archive gets its final
    name when it is complete; the list, written to the shared folder, names those of the attempts that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt, done, out, size = TaskContext.get().partitionId(), nonce(), [], None, 0
        info = b"software: sitespec\r\nformat: WARC File Format 1.0\r\n"
        info = _header([(b"WARC-Type", "warcinfo"), (b"Content-Type", "application/warc-fields")], len(info)) + info + b"\r\n\r\n"
        info, suffix = packed(info, level), "warc" if level is None else "warc.gz"

        def close():
            out.close()
            store.move(f"{root}/{name}.open", f"{root}/{name}")
            done.append((f"{folder}/{name}", size))

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if out is not None and size >= archive_bytes:
                    close()
                    out = None
                if out is None:
                    name = f"part-{part:06d}-{len(done):04d}-{attempt}.{suffix}"
                    out, size = store.open_output_stream(f"{root}/{name}.open"), len(info)
                    out.write(info)
                data = packed(record(*row), level)
                out.write(data)
                size += len(data)
        if out is not None:
            close()
        if done:
            names, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["archive", "size"])

    columns = rows.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return materialize(columns.mapInArrow(write, "archive string, size long"), "archives")


def _plain(source, offset: int) -> tuple[bytes, int] | None:
    head, end = b"", -1
    source.seek(offset)
    while end < 0 and len(head) < HEADER_BYTES:
        more = source.read(2048)
        if not more:
            return None
        head += more
        end = head.find(b"\r\n\r\n")
    length = dict(_FIELD.findall(head[: end + 2])).get(b"Content-Length", b"") if end >= 0 else b""
    if not length.isdigit() or len(length) > 18:
        return None
    size = end + 4 + int(length) + 4
    source.seek(offset)
    data = source.read(size)
    return (data, offset + size) if len(data) == size else None


def _member(source, offset: int) -> tuple[bytes, int] | None:
    source.seek(offset)
    unpack, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not unpack.eof:
            more = source.read(1 << 15)
            if not more:
                return None
            at += len(more)
            parts.append(unpack.decompress(more))
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def parse_record(source, offset: int, plain: bool) -> tuple[dict, int] | None:
    """What a record at ``offset`` would hold, and the offset of its successor; None where there is no whole record."""
    found = (_plain if plain else _member)(source, offset)
    if found is None or not found[0].startswith(_MAGIC) or found[0][-4:] != b"\r\n\r\n":
        return None
    data, successor = found
    end = data.find(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _FIELD.findall(data[: end + 2])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18 or end + 4 + int(length) + 4 != len(data):
        return None
    block = data[end + 4 : -4]
    out = {"offset": offset, "record_type": fields.get(b"warc-type", b"").decode("utf-8", "replace")}
    for name, field in (("page_id", b"warc-record-id"), ("refers_to", b"warc-refers-to")):
        m = re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", fields.get(field, b""))
        out[name] = int(m[1]) if m else None
    out["url"] = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
    out["header_digest"] = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:")
    if out["record_type"] == "response":
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        out["payload_bytes"], out["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
    elif out["record_type"] == "revisit":
        m = re.search(rb"\r\nContent-Length: ([0-9]{1,18})\r\n", block)
        out["payload_bytes"], out["payload_digest"] = int(m[1]) if m else None, out["header_digest"]
    return out, successor


def _ranges(archives: DataFrame, range_bytes: int) -> DataFrame:
    """(archive, size, start) of the byte ranges, one a task or a few."""
    starts = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes)))
    n = max(1, math.ceil((archives.agg(F.sum("size")).first()[0] or 0) / range_bytes))
    return archives.select("archive", "size", starts.alias("start")).repartition(n, "archive", "start")


def candidate_records(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, size, start, offset, leaves): every place of the archives (archive, size) that looks like a record.

    A task takes a byte range; what begins in the range is its own, wherever it ends. ``leaves`` is where the
    chain of successors from this candidate first leaves the range: a range's own links are followed in its task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = arrow_fs.FileSystem.from_uri(archive)
                plain = name.endswith(".warc")
                magic = _MAGIC if plain else _MEMBER
                successors: dict[int, int] = {}
                with store.open_input_file(name) as source:
                    source.seek(start)
                    data = source.read(range_bytes + len(magic) - 1)
                    at = data.find(magic)
                    while 0 <= at < range_bytes:
                        if (found := parse_record(source, start + at, plain)) is not None:
                            successors[start + at] = found[1]
                        at = data.find(magic, at + 1)
                leaves: dict[int, int] = {}
                for offset in sorted(successors, reverse=True):  # a successor lies behind, so it is known already
                    leaves[offset] = leaves.get(successors[offset], successors[offset])
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * n, pa.string()), *(pa.array(v, pa.int64()) for v in ([size] * n, [start] * n, list(leaves), list(leaves.values())))],
                    ["archive", "size", "start", "offset", "leaves"],
                )

    return _ranges(archives, range_bytes).mapInArrow(read, "archive string, size long, start long, offset long, leaves long")


def chained(candidates: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive, start, offset): where the chain from the start of an archive enters each of its ranges.

    Pointer jumping over the candidates at which a chain may enter a range: each round a reached one marks the one
    its pointer names, and every pointer is replaced by that of the candidate it points at, so pointers double
    their length, and a chain through n ranges takes log2(n) rounds. Raises where a chain does not end at the end
    of its archive.
    """
    named = candidates.select("archive", F.col("leaves").alias("offset")).distinct()
    entries = candidates.join(named, ["archive", "offset"], "left_semi").filter("offset > 0").unionByName(candidates.filter("offset = 0"))
    nodes = entries.select("archive", "start", "offset", F.col("leaves").alias("to"), (F.col("offset") == 0).alias("on"))
    nodes = materialize(nodes, "chain")
    reached = -1
    while (now := nodes.filter("on").count()) != reached:
        reached = now
        marks = nodes.filter("on").select("archive", F.col("to").alias("offset"), F.lit(True).alias("hit")).distinct()
        hops = nodes.select("archive", F.col("offset").alias("to"), F.col("to").alias("next"))
        # A pointer that names no candidate (the end of the archive, or a false record's successor) stays.
        nodes = nodes.join(marks, ["archive", "offset"], "left").join(hops, ["archive", "to"], "left")
        on = F.col("on") | F.col("hit").isNotNull()
        nodes = materialize(nodes.select("archive", "start", "offset", F.coalesce("next", "to").alias("to"), on.alias("on")), "chain")
    on = nodes.filter("on")
    ends = on.groupBy("archive").agg(F.max("to").alias("end"))
    broken = archives.join(ends, "archive", "left").filter("end is null or end <> size").count()
    if broken:
        raise ValueError(f"{broken} archives have a broken chain of records")
    return on.select("archive", "start", "offset")


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Response and revisit records of the archives (archive, size); payloads are held against their digests."""
    fields = [f.strip().split(" ") for f in RECORDS.split(",")]
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in fields])
    candidates = materialize(candidate_records(archives, range_bytes), "candidates")
    entries = materialize(chained(candidates, archives), "entries")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, start, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = arrow_fs.FileSystem.from_uri(archive)
                rows = []
                with store.open_input_file(name) as source:
                    size = source.size()
                    while offset < min(size, start + range_bytes):
                        row, following = parse_record(source, offset, name.endswith(".warc"))
                        if row["record_type"] in ("response", "revisit"):
                            rows.append({"archive": archive, **row})
                        offset = following
                yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = entries.repartition(max(1, entries.count()), "archive", "start")
    records = ranges.mapInArrow(read, RECORDS)
    fits = F.col("payload_digest") == F.col("header_digest")
    wrong = F.concat(F.lit("payload and digest differ: "), "archive", F.lit(" "), F.col("offset").cast("string"))
    return records.withColumn("payload_digest", F.when(fits, F.col("payload_digest")).otherwise(F.raise_error(wrong)))


def warc_round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id long, url, html) as archives and read them back.

    Returns one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Repeated rows give
    a record each; an empty table gives no archive and no rows; NULL html is an empty payload; a NULL url is left
    out of the header; other columns are not looked at.
    """
    archives = write_archives(with_revisits(pages, least), folder or fresh_folder(pages.sparkSession, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
