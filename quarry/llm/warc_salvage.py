"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer gives every page a record; of equal payloads of at least ``revisit_bytes`` bytes the page of
the largest id is the response and the others revisit it.  Each record is a gzip member of its own.

The reader takes gzip archives, of one record or several to a member, and plain ones.  A record stands if its member
inflates and passes its checksum, its version line and headers parse, its block is as long as stated, is followed by
two line ends, and its digests, that of the block and that of a response's payload, agree.  Where a check fails, the reader
searches for the next place where a
valid member or version line begins, goes on from there, and reports the bytes skipped as a gap.  What a broken member still
yields is read too: its records stand if they bear a block digest that agrees; the member is reported as a gap all the same.

Defined results: a null ``html`` is an empty payload; a null ``page_id`` is smaller than any other and is
named ``null``; rows that repeat the id of the response of their payload are responses themselves; an empty table writes no archive.
No bytes make the reader fail: ids, lengths and digests that cannot be read count as damage or are null.  A member inflates to
``MOST`` bytes at most, beyond which it is damage; a task holds one archive at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, files, small_enough, write_once

_VERSION = b"WARC/1."
_LINE = re.compile(rb"WARC/1\.\d\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_MEMBER = b"\x1f\x8b\x08"
_PAGE = re.compile(r"<urn:x-page:(-?[0-9]{1,19})>")
_LENGTH = re.compile(r"[0-9]{1,18}")
MOST = (1 << 31) - 1
_SALTS = 16


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(urn: str | None) -> int | None:
    """The page id that a record id names; null if it names none that fits 64 bits."""
    found = _PAGE.fullmatch((urn or "").strip())
    page = int(found[1]) if found else None
    return page if page is not None and -(1 << 63) <= page < 1 << 63 else None


def digest_of(stated: str | None) -> str | None:
    """A stated SHA-1 in base 32 or hexadecimal, as hexadecimal; null if it is neither."""
    kind, _, value = (stated or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """The bytes of one record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = "".join(c for c in url or "urn:none" if c > " ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int | None:
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and (found := _LENGTH.fullmatch(value.strip().decode("latin-1"))):
                return int(found[0])
        return None


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; raises Damaged where a check fails."""
    if not _LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if "warc-type" not in headers or not _LENGTH.fullmatch(headers.get("content-length", "")):
        raise Damaged("type or length missing")
    start, size = end + 4, int(headers["content-length"])
    block = bytes(data[start : start + size])
    if len(block) < size:
        raise Damaged("block cut short")
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("no record end")
    if (digest := digest_of(headers.get("warc-block-digest"))) and digest != hashlib.sha1(block).hexdigest():
        raise Damaged("block digest differs")
    if headers["warc-type"] == "response" and (digest := digest_of(headers.get("warc-payload-digest"))) and digest != hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest():
        raise Damaged("payload digest differs")
    return headers, block, start + size + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(content, end, damage) of the gzip member at ``at``; with damage, the content is what came before it."""
    z = zlib.decompressobj(31)
    out, pos, size = [], at, 0
    try:
        while not z.eof:  # in steps, so that what follows the member is not copied
            part = z.unconsumed_tail or data[pos : pos + 65536]
            if not part:
                return b"".join(out), pos, "member cut short"
            pos += 0 if z.unconsumed_tail else len(part)
            out.append(z.decompress(part, 1 << 20))
            size += len(out[-1])
            if size > MOST:
                return b"".join(out), pos, "member too large"
    except zlib.error as e:
        return b"".join(out), pos, f"member: {e}"
    return b"".join(out), pos - len(z.unused_data), None


def _inside(content: bytes, sure: bool) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """(records, damage) of the content of a member; unless ``sure``, only records that bear a block digest."""
    found, damage, pos = [], None if content else "empty member", 0
    while pos < len(content):
        try:
            headers, block, pos = parse(content, pos)
        except Damaged as e:
            damage = damage or str(e)
            pos = content.find(_VERSION, pos + 1)
            if pos < 0:
                break
            continue
        if sure or digest_of(headers.get("warc-block-digest")):
            found.append((headers, block))
    return found, damage


def _stands(data: bytes, at: int) -> bool:
    """Whether a member or record that passes all checks begins at ``at``."""
    try:
        if data[at : at + 3] != _MEMBER:
            parse(data, at)
            return True
        content, _, damage = inflate(data, at)
        return damage is None and parse(content, 0) is not None
    except Damaged:
        return False


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """(records, gaps as (start, end, reason)) of an archive."""
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    at = 0
    while at < len(data):
        if data[at : at + 3] == _MEMBER:
            content, end, damage = inflate(data, at)
            found, inner = _inside(content, damage is None)
            records += [Record(at, h, b) for h, b in found]
            if damage is None and found:
                if inner:
                    gaps.append((at, end, f"within a member: {inner}"))
                at = end
                continue
            damage = damage or inner
        else:
            try:
                headers, block, end = parse(data, at)
                records.append(Record(at, headers, block))
                at = end
                continue
            except Damaged as e:
                damage = str(e)
        probe = at
        while probe < len(data):  # the next place where a record stands
            ahead = [x for x in (data.find(_MEMBER, probe + 1), data.find(_VERSION, probe + 1)) if x >= 0]
            probe = min(ahead, default=len(data))
            if probe < len(data) and _stands(data, probe):
                break
        gaps.append((at, probe, damage))
        at = probe
    return records, gaps


def write_archives(spark: SparkSession, pages: DataFrame, where: str, revisit_bytes: int = 1000, file_bytes: int = 16 << 20) -> int:
    """Write an archive per ``file_bytes`` and task into the folder ``where``; how many records there are.

    Only payloads that may be revisited meet the responses, whose pages are dealt with salts, as one payload may be that of many
    pages.  A task writes its rows in a fixed order, so that a repeated task writes the same files.
    """
    body = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    large, small = rows.where(F.octet_length("payload") >= revisit_bytes), rows.where(F.octet_length("payload") < revisit_bytes)
    winners = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("rows")).where("rows > 1").select(F.col("digest").alias("d"), "winner", F.lit(True).alias("shared"))
    ws = Workspace(spark, "warc-responses")
    winners = ws.table(winners, "winners")
    if small_enough(spark, winners.count(), 64):
        joined = large.join(F.broadcast(winners), F.col("digest") == F.col("d"), "left")
    else:
        salted = winners.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = large.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")).join(salted, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    marked = joined.select("page_id", "url", "payload", "digest", "winner", revisit.alias("revisit"))
    marked = marked.unionByName(small.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("winner"), F.lit(False).alias("revisit")))
    marked = marked.sortWithinPartitions("page_id", "digest", "url")

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size, wrote = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in batches:
            for page, url, payload, winner, again in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "winner", "revisit"))):
                held.append(member(record(page, url, payload, winner if again else None, "revisit" if again else "response")))
                size += len(held[-1])
                wrote += 1
                if size >= file_bytes:
                    write_once(f"{where}/pages-{part:06d}-{n:05d}.warc.gz", b"".join(held))
                    n, held, size = n + 1, [], 0
        if held:
            write_once(f"{where}/pages-{part:06d}-{n:05d}.warc.gz", b"".join(held))
        yield pa.RecordBatch.from_arrays([pa.array([wrote], pa.int64())], ["records"])

    return marked.mapInArrow(run, "records long").agg(F.sum("records")).first()[0] or 0


_READ = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string, gap_end long, gap_reason string"


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """A row per salvaged record, and one per gap (``gap_reason`` set, from ``offset`` to ``gap_end``)."""

    def run(batches):
        names = [c.split()[0] for c in _READ.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64()}
        types = [kinds[c.split()[1]] for c in _READ.split(", ")]
        for b in batches:
            for name in b.column("path").to_pylist():
                system, path = files(name)
                with system.open_input_stream(path, compression=None) as stream:
                    records, gaps = salvage(stream.read())
                rows = []
                for r in records:
                    kind, payload = r.headers["warc-type"], r.payload if r.headers["warc-type"] == "response" else None
                    digest = digest_of(r.headers.get("warc-payload-digest")) if payload is None else hashlib.sha1(payload).hexdigest()
                    size = r.http_length() if payload is None else len(payload)
                    rows.append((name, r.offset, page_of(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), kind, page_of(r.headers.get("warc-refers-to")), size, digest, None if payload is None else payload.decode("utf-8", "replace"), None, None))
                rows += [(name, start, None, None, None, None, None, None, None, end, why) for start, end, why in gaps]
                for lo in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[lo : lo + 512]), types)], names)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    return found.where(F.col("path").rlike(r"\.warc(\.gz)?$")).select("path").mapInArrow(run, _READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, read back from archives.

    Raises if the archives that were just written have a gap or lack a record.
    """
    ws = Workspace(spark, "warc")
    where = ws.path("archives")
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    wrote = write_archives(spark, pages, where)
    if not wrote:
        return spark.createDataFrame([], columns)
    names = [c.split()[0] for c in columns.split(", ")]
    back = ws.table(read_archives(spark, where).select(*names, "gap_reason"), "read")
    whole, gaps = back.agg(F.count_if(F.col("gap_reason").isNull()), F.count("gap_reason")).first()
    if gaps or whole != wrote:
        raise RuntimeError(f"{wrote} records were written, {whole} read back, with {gaps} gaps")
    return back.select(*names)
