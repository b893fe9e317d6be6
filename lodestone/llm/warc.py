"""Operator 3: WARC archives, written by Spark's text sink and read by a salvage reader.

Writing: every page becomes one WARC/1.1 record. Of records with equal payloads
the one with the smallest page id is the response; the others are revisit
records that refer to it and keep its HTTP header. A record is one zstd frame
followed by a skippable frame whose single data byte is the line separator of
the text sink, so archives (.warc.zst) go through Spark's commit protocol to any
store, and lost or repeated tasks leave no partial archive.

Reading: records are taken member by member (zstd frames, gzip members or plain
version lines). When a member or record fails its checks (frame checksum,
version line, header, Content-Length, payload digest, record end) the reader
searches for the next valid member or version line, goes on there, and logs the
bytes between as a quarantined gap. A member of which a record or the end is
damaged keeps its valid records: the search goes on at the next version line of
its decompressed bytes, and the gap names the offset inside the member.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch_path, settings, worker_batches

ZSTD, GZIP, VERSION = b"\x28\xb5\x2f\xfd", b"\x1f\x8b\x08", b"WARC/1."
#: A skippable zstd frame of one byte; that byte is the sink's line separator.
TAIL = b"\x50\x2a\x4d\x18\x01\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 0
#: Payload that an archive holds by default, before compression.
ARCHIVE_BYTES = 128 << 20
CUT = "ValueError: member is cut"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, in JVM expressions."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, first_id``: first_id is null unless payloads repeat.

    Null ids never win against others; if all ids of a payload are null, all are responses.
    Payloads are joined to the smallest id of their digest; a digest that many
    pages share is one row on the small side, and its pages can be split by AQE.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    firsts = own.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n"))
    firsts = firsts.where("_n > 1 and first_id is not null").select(F.col("digest").alias("_d"), "first_id")
    return own.join(firsts, F.col("digest") == F.col("_d"), "left").drop("_d")


def _header(lines: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)).encode() + b"\r\n"


def _uri(url: str | None, page_id: int | None) -> str:
    clean = "".join(c for c in url or "" if c > " " and c != "\x7f")
    return clean or f"urn:page:{page_id}"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None) -> bytes:
    """One uncompressed WARC record; a revisit if ``first_id`` is another page's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first_id is not None and page_id != first_id
    block = http if revisit else http + payload
    uid = hashlib.sha1(f"{page_id}|{url}|{digest}".encode()).hexdigest()
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uid[:8]}-{uid[8:12]}-5{uid[13:16]}-a{uid[17:20]}-{uid[20:32]}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", first_id if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ])
    return head + block + END


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, records_per_file: int | None = None) -> None:
    """Write ``pages`` (page_id, url, html) as .warc.zst archives below ``path``.

    By default an archive holds as many records as make up about ARCHIVE_BYTES
    of payload, since a reader takes an archive at once.
    """
    if records_per_file is None:
        mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
        records_per_file = max(1, min(20_000, int(ARCHIVE_BYTES / (mean + 500))))

    def members(batches):
        pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(5)))
            yield pa.record_batch([pa.array([pack.compress(encode_record(*r)) + TAIL for r in rows], pa.binary())], ["value"])

    rows = record_types(pages, least).select("page_id", "url", "payload", "digest", "first_id")
    packed = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    with worker_batches(pages.sparkSession), settings(pages.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        packed.write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


class _Record:
    """Fields of a record that passed its checks."""

    def __init__(self, raw: bytes, start: int):
        stop = raw.find(b"\r\n\r\n", start)
        if not raw.startswith(VERSION, start) or stop < 0:
            raise ValueError("no version line or header end")
        lines = raw[start:stop].decode("utf-8", "strict").split("\r\n")[1:]
        self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(self.head["content-length"])
        self.block = raw[stop + 4 : stop + 4 + n]
        self.stop = stop + 4 + n + len(END)
        if n < 0 or len(self.block) != n or raw[self.stop - len(END) : self.stop] != END:
            raise ValueError("record is cut")
        named = self.head.get("warc-block-digest", "").removeprefix("sha1:")
        if named and base64.b32encode(hashlib.sha1(self.block).digest()).decode() != named:
            raise ValueError("block digest differs")
        self.kind = self.head["warc-type"]
        head, _, self.payload = self.block.partition(b"\r\n\r\n")
        self.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
        self.digest = self.head.get("warc-payload-digest", "").removeprefix("sha1:")
        if self.kind == "response" and self.digest and base64.b32encode(hashlib.sha1(self.payload).digest()).decode() != self.digest:
            raise ValueError("payload digest differs")


def _member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """Plain bytes of the compressed member at ``at``, where the next begins, and what is wrong with it.

    Of a damaged or cut member the bytes before the damage are given, and None
    for its end.
    """
    if data.startswith(ZSTD, at):
        d = zstandard.ZstdDecompressor().decompressobj()
    elif data.startswith(GZIP, at):
        d = zlib.decompressobj(31)
    else:
        raise ValueError("no member")
    raw, pos, why = [], at, CUT
    step = 1 << 16
    while pos < len(data):
        before = d.copy() if hasattr(d, "copy") else None
        try:
            raw.append(d.decompress(data[pos : pos + step]))
        except (zlib.error, zstandard.ZstdError) as e:
            why = f"{type(e).__name__}: {e}"
            raw += _before_damage(data, at, pos, step, before)
            break
        pos = min(len(data), pos + step)
        if getattr(d, "eof", False):
            return b"".join(raw), pos - len(d.unused_data), ""
    return b"".join(raw), None, why


def _before_damage(data: bytes, at: int, pos: int, step: int, d) -> list[bytes]:
    """What the piece at ``pos`` still gives before its damage, taken in small pieces; zstd has no copies, so the member is begun anew."""
    out, fresh = [], d is None
    if fresh:
        d = zstandard.ZstdDecompressor().decompressobj()
        for i in range(at, pos, step):
            d.decompress(data[i : min(pos, i + step)])
    try:
        for i in range(pos, min(len(data), pos + step), 1 if not fresh else 64):
            out.append(d.decompress(data[i : i + (1 if not fresh else 64)]))
    except (zlib.error, zstandard.ZstdError):
        pass
    return out


def _records(raw: bytes, unsure: bool = False):
    """Yield ("record", start, stop, _Record) and ("gap", start, stop, reason) that tile the plain bytes of a member.

    ``unsure``: the member fails its own checks, so only records with a digest can be trusted.
    """
    at, bad, why = 0, None, ""
    while at < len(raw):
        try:
            r = _Record(raw, at)
            if unsure and not r.head.get("warc-block-digest") and not (r.kind == "response" and r.digest):
                raise ValueError("no digest in a damaged member")
        except (ValueError, KeyError, UnicodeDecodeError) as e:
            if bad is None:
                bad, why = at, f"{type(e).__name__}: {e}"
            at = raw.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        yield "record", at, r.stop, r
        at = r.stop
    if bad is not None:
        yield "gap", bad, len(raw), why


def _next_start(data: bytes, at: int) -> int:
    """The nearest place from ``at`` on where a member or version line may begin; the end if there is none."""
    found = [i for m in (ZSTD, GZIP, VERSION) if (i := data.find(m, at)) >= 0]
    return min(found, default=len(data))


def salvage(data: bytes):
    """Yield ("record", start, stop, _Record) and ("gap", start, stop, reason) that tile the archive.

    Records and gaps inside one compressed member bear that member's place.
    Skippable zstd frames and white space between records belong to neither.
    """
    at, bad, why = 0, None, ""
    kept = set()  # of the damaged member whose rest is searched: stored blocks would show its records again
    while at < len(data):
        if bad is None:
            if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and 0x50 <= data[at] <= 0x5F and at + 8 <= len(data):
                end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if end <= len(data):
                    at = end
                    continue
            if data[at] in b"\r\n":
                at += 1
                continue
        try:
            if data.startswith(VERSION, at):
                found, lost, hurt = [_Record(data, at)], [], ""
                end = found[0].stop
                if bad is not None and found[0].head.get("warc-record-id") in kept:
                    raise ValueError("taken already")
            else:
                raw, end, hurt = _member(data, at)
                inside = list(_records(raw, bool(hurt) and hurt != CUT))
                found = [x[3] for x in inside if x[0] == "record"]
                if not found and (hurt or inside):
                    raise ValueError(hurt or inside[0][3])
                lost = [(f"inner offset {x[1]} to {x[2]}: {x[3]}") for x in inside if x[0] == "gap"]
        except (ValueError, KeyError, zlib.error, zstandard.ZstdError, UnicodeDecodeError) as e:
            if bad is None:
                bad, why = at, f"{type(e).__name__}: {e}"[:120]
            at = _next_start(data, at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        kept = set()
        upto = end if end is not None else _next_start(data, at + 1)
        for r in found:
            yield "record", at, upto, r
        if end is not None:
            for reason in lost:
                yield "gap", at, end, reason[:120]
            at = end
        else:  # the compressed rest is searched for the next member
            bad, why = at, f"after inner offset {found[-1].stop}: {hurt}"[:120] if not lost else f"{lost[0]}; {hurt}"[:120]
            at = upto
            kept = {r.head.get("warc-record-id") for r in found} - {None}
    if bad is not None:
        yield "gap", bad, len(data), why


READ_SCHEMA = (
    "archive string, start long, stop long, status string, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives below ``path``; status is ``record`` or ``gap``.

    A revisit's payload_bytes and payload_digest are those of the full payload,
    from its HTTP header and its WARC header; its payload column is null. An
    empty archive gives no rows. An archive is read whole, by one task; Spark's
    reader of binary files fails for archives of 2 GB and more.
    """

    def parse(batches):
        schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("status", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda v: None if v is None else int(v)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for what, start, stop, x in salvage(data.as_py()):
                    if what == "gap":
                        rows.append((name, start, stop, what, x, None, None, None, None, None, None, None))
                    else:
                        size = len(x.payload) if x.kind == "response" else number(x.http.get("content-length"))
                        rows.append((name, start, stop, what, None, number(x.head.get("x-page-id")), x.head.get("warc-target-uri"), x.kind, number(x.head.get("x-refers-to-page-id")), size, x.digest, x.payload if with_payload and x.kind == "response" else None))
                        held += len(x.payload) if with_payload else 0
                    if len(rows) >= 2000 or held > 1 << 23:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, READ_SCHEMA)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back.

    Defined cases: a null html is an empty payload; a null url gets a urn; rows
    that bear the smallest id of their payload are responses, all others revisit
    it, those with a null id too; if all ids of a payload are null, its rows are
    responses; other columns are ignored; no pages give no records.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    records = read_archives(spark, path, with_payload=False).where("status = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
