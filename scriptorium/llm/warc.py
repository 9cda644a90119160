"""WARC archives: writing with segments and chunked transfer framing, and putting records together again.

A record whose block is larger than a segment is written as a response and continuations. Reading takes each record
as it comes; segments meet by origin identifier, in order of number, their length is held against the total that the
last one states, and then the chunked framing of the payload is taken off.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT, CHUNK, ROLL = 32 << 10, 4 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_shared(path: str, mode: str) -> BinaryIO:
    """A file in the folder that driver and executors share, which may be local to all or in a remote store."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if mode == "rb":
        return system.open_input_stream(at, compression=None)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


def _line(text: str | None) -> str | None:
    """A header value holds no line breaks."""
    return text if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[a : a + CHUNK] for a in range(0, len(payload), CHUNK))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload without chunked framing; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        parts.append(body[at : at + n])
        at += n + 2


def page_records(page_id: int | None, url: str | None, html: str | None, digest: str, refers: int | None, revisit: bool, unique: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The packed records of a page; unique tells rows apart that share a page_id."""
    payload, own = (html or "").encode(), f"<urn:page:{page_id}:{unique}>"
    about = [("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", refers)]
        yield _record([*kind, *about], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1 if len(parts) > 1 else None), *about], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield _record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)),
            ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total),
        ], part)


def write_pages(pages: DataFrame, folder: str, segment: int = SEGMENT, roll: int = ROLL) -> DataFrame:
    """Writes pages as archives below folder (shared by all executors) and returns their list: path, records, bytes.

    pages: page_id, url, html; null html is empty. Of records with equal payloads, that with the largest page_id is
    the response and others revisit it; rows that repeat that page_id are responses too. Only archives of tasks that
    ended well are listed. Digests that occur once need no partner, so only the repeated ones are joined; where their
    table is small, pages are not moved.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    last = pages.select("page_id", sha.alias("sha")).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count("*").alias("n"))
    last = common.stash(last.where("n > 1").select("sha", "refers"), "repeated")
    named = pages.select("page_id", "url", "html", sha.alias("sha"))
    rows = common.spread_join(named, last, ["sha"], "left").select("page_id", "url", "html", "sha", "refers")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, path, n, size, row, files = None, "", 0, 0, 0, 0
        for batch in batches:
            done = []
            for page_id, url, html, sha, refers in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                named = base64.b32encode(bytes.fromhex(sha)).decode()
                for record in page_records(page_id, url, html, named, refers, refers is not None and page_id != refers, f"{task.partitionId()}.{row}", segment):
                    if out is None:
                        path, n, size, files = f"{name}-{files:04d}.warc.gz", 0, 0, files + 1
                        out = open_shared(path, "wb")
                    out.write(record)
                    n, size = n + 1, size + len(record)
                    if size >= roll:
                        out.close()
                        out = None
                        done.append((path, n, size))
            yield _listed(done)
        if out is not None:
            out.close()
            yield _listed([(path, n, size)])

    return common.stash(rows.mapInArrow(of, "path string, records long, bytes long"), "archives")


def _listed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])


def unpacked(file: BinaryIO) -> Iterator[bytes]:
    """The bytes of an archive in pieces, whether it is packed (one member or many) or not."""
    data = file.read(1 << 20)
    packed = data[:2] == b"\x1f\x8b"
    inner = zlib.decompressobj(31) if packed else None
    while data:
        if not packed:
            yield data
            data = file.read(1 << 20)
            continue
        yield inner.decompress(data)
        data = inner.unused_data
        if inner.eof:
            inner = zlib.decompressobj(31)
        data = data or file.read(1 << 20)


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    pieces, held = unpacked(file), b""

    def more(n: int) -> bool:
        nonlocal held
        got, parts = len(held), [held]
        while got < n and (piece := next(pieces, None)) is not None:
            parts.append(piece)
            got += len(piece)
        held = b"".join(parts)
        return got >= n

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends within a header")
                return
        head = held[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        held = held[end + 4 :]
        n = int(headers["content-length"])
        if not more(n + 4):
            raise ValueError("an archive ends within a block")
        yield headers, held[:n]
        held = held[n + 4 :]


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()),
    ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("length", pa.int64()), ("payload", pa.binary()), ("block", pa.binary()), ("problem", pa.string()),
])
_READ_DDL = "page_id long, url string, record_type string, refers_to long, digest string, origin string, segment int, total long, length long, payload binary, block binary, problem string"


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP response without its framing, and the length that its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    length = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
    return (unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"").lower() else body), length


def _taken_apart(kind: str, block: bytes, stated: str | None) -> tuple[int | None, bytes | None, str | None, str | None]:
    """Length, payload, digest and problem. A revisit has the length and digest that it states."""
    try:
        payload, length = payload_of(block)
    except ValueError:
        return None, None, stated, "broken framing"
    if kind == "revisit":
        return length, None, stated, None
    own = digest(payload)
    return len(payload), payload, own, "wrong digest" if stated is not None and own != stated else None


def _whole(number: str | None) -> int | None:
    return int(number) if number and number.lstrip("-").isdigit() else None


def _read(payloads: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_shared(path, "rb") as file:
                    for headers, block in records(file):
                        kind, segment = headers.get("warc-type"), _whole(headers.get("warc-segment-number"))
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        origin = headers.get("warc-segment-origin-id") or (headers["warc-record-id"] if segment else None)
                        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        length, payload, own, problem = (None, None, stated, None) if origin else _taken_apart(kind, block, stated)
                        rows.append((
                            _whole(headers.get("page-id")), headers.get("warc-target-uri"), kind, _whole(headers.get("refers-to-page-id")), own, origin, segment,
                            _whole(headers.get("warc-segment-total-length")), length, payload if payloads else None, block if origin else None, problem,
                        ))
                        size += len(block)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _READ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)], schema=_READ)


def _reassembled(payloads: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, parts in zip(*(c.to_pylist() for c in batch.columns)):
                first = parts[0]
                block, total = b"".join(p["block"] for p in parts), parts[-1]["total"]
                length, payload, own = None, None, first["digest"]
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    problem = "missing segment"
                elif total != len(block):
                    problem = "wrong total length"
                else:
                    length, payload, own, problem = _taken_apart(first["record_type"], block, first["digest"])
                yield _batch([(first["page_id"], first["url"], first["record_type"], first["refers_to"], own, origin, None, total, length, payload if payloads else None, None, problem)])

    return of


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the listed archives, segments put together: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, problem.

    archives: path. A revisit has no payload; its length and digest are those that it states. problem is null, or
    `missing segment`, `wrong total length`, `broken framing` or `wrong digest`; then payload is as far as it is
    known, or null. Lengths and digests are of the payloads as they are read; without payloads, these are let go once
    that is done, and payload is null.
    """
    common.small_batches(archives.sparkSession)
    # dealt by number before anything else, for a list of paths is small however much stands in the archives
    files = archives.select("path").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").distinct()
    read = files.mapInArrow(common.lean(_read(payloads)), _READ_DDL)
    # both parts below come from one reading
    read = common.stash(read, "records")
    parts = read.where("origin is not null").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct(
        "segment", "page_id", "url", "record_type", "refers_to", "digest", "total", "block"
    ))).alias("parts"))
    whole = read.where("origin is null").unionByName(parts.mapInArrow(common.lean(_reassembled(payloads)), _READ_DDL))
    return whole.select("page_id", "url", "record_type", "refers_to", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "payload", "problem")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of each row of pages, read back from archives in the shared folder.

    pages: page_id, url, html; other columns are ignored whatever their names. No rows give no rows.
    """
    spark: SparkSession = pages.sparkSession
    archives = write_pages(pages, common.fresh_path(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
