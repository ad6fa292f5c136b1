"""Web archives: write pages as WARC files, and read archives, damaged ones too.

Every record is a gzip member of its own. Of pages with equal payloads, the
one with the smallest key is a response and the others are revisit records
that refer to it. The reader checks every member and record (gzip's crc,
version line, length, digests); where a check fails it looks for the next
member or version line that passes, inside a decompressed member too, goes on
there, and logs the bytes between
as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.shared import col, open_fs, shared_path, small_batches, written

MIN_PAYLOAD = 0
CHUNK = 1 << 18
_URN = "urn:x-page:"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_OVERLAP = 16
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(key: str | None) -> str:
    return f"<{_URN}{'' if key is None else quote(key, safe='')}>"


def record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, revisit: bool = False) -> bytes:
    """One WARC record (not compressed)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(key)), ("WARC-Date", _DATE),
              ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(Exception):
    pass


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _check(head: bytes, block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record, if its digests are right."""
    fields = _fields(head)
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", block.partition(b"\r\n\r\n")[2])):
        kind, _, value = fields.get(name, "").partition(":")
        if kind.lower() != "sha1" or name == "warc-payload-digest" and fields.get("warc-type") != "response":
            continue
        if value.upper() != base32(hashlib.sha1(data).digest()):
            raise Damaged(name)
    return fields, block


def _parse(raw: bytes, broken: bool = False) -> tuple[list[tuple[dict[str, str] | None, bytes, int]], str]:
    """Records of one decompressed member, and between them its gaps (no fields,
    the reason, the inner offset); the first reason, if any. `broken`: the
    member's data end in a gzip error, so only records with right digests count
    and the one that reaches up to the error does not."""
    out, at, why, bad = [], 0, "", None
    while at < len(raw):
        after = None
        try:
            if not _VERSION.match(raw, at):
                raise Damaged("version line")
            found = re.compile(rb"\r?\n\r?\n").search(raw, at)
            if not found:
                raise Damaged("header")
            length = _fields(raw[at:found.start()]).get("content-length", "")
            end = found.end() + int(length) if length.isdecimal() else -1
            if end < 0 or raw[end:end + 4] != b"\r\n\r\n":
                raise Damaged("length")
            after = end + 4
            fields, block = _check(raw[at:found.start()], raw[found.end():end])
            if broken and (after == len(raw) or "warc-block-digest" not in fields):
                raise Damaged("gzip")
        except Damaged as e:
            why = why or str(e)
            if bad is None:
                bad = at
                out.append((None, str(e).encode(), at))
            if after is None:
                following = _VERSION.search(raw, at + 1)
                after = following.start() if following else len(raw)
        else:
            bad = None
            out.append((fields, block, at))
        at = after
    if not any(fields is not None for fields, _, _ in out):
        raise Damaged(why or "empty member")
    return out, why


class Archive:
    """An archive opened for reading, with or without compression."""

    def __init__(self, file):
        self.file = file
        self.size = file.size()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(max(0, min(n, self.size - offset)))

    def _member(self, at: int) -> tuple[list[tuple[dict[str, str] | None, bytes, int]], int, str]:
        """Records and gaps of a member, its end, and why it has no end (else empty)."""
        z, parts, offset, why = zlib.decompressobj(31), [], at, ""
        while not z.eof and not why:
            data = self._at(offset, CHUNK)
            if not data:
                why = "cut off"
                break
            before = z.copy()
            try:
                parts.append(z.decompress(data))
            except zlib.error:
                why = "gzip"
                try:                           # what comes out before the error
                    for k in range(len(data)):
                        parts.append(before.decompress(data[k:k + 1]))
                except zlib.error:
                    pass
            offset += len(data)
        raw = b"".join(parts)
        if why and not raw:
            raise Damaged(why)
        try:
            found, _ = _parse(raw, why == "gzip")
        except Damaged as e:
            raise Damaged(why or str(e)) from e
        return found, offset - len(z.unused_data), why

    def _plain(self, at: int) -> tuple[list[tuple[dict[str, str] | None, bytes, int]], int, str]:
        head, found = b"", None
        while not found:
            data = self._at(at + len(head), 1 << 14)
            if not data or len(head) > 1 << 20:
                raise Damaged("header")
            head += data
            if not _VERSION.match(head):
                raise Damaged("version line")
            found = re.search(rb"\r?\n\r?\n", head)
        length = _fields(head[:found.start()]).get("content-length", "")
        end = at + found.end() + int(length) if length.isdecimal() else self.size + 1
        if end > self.size or self._at(end, 4) != b"\r\n\r\n":
            raise Damaged("length")
        return [_check(head[:found.start()], self._at(at + found.end(), int(length))) + (0,)], end + 4, ""

    def _next(self, at: int) -> int:
        """Place of the next member start or version line, or the end."""
        while at < self.size:
            data = self._at(at, CHUNK + _OVERLAP)
            found = _NEXT.search(data)
            if found and (found.start() < CHUNK or at + len(data) >= self.size):
                return at + found.start()
            at += CHUNK
        return self.size

    def records(self) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
        """(offset, length, fields, block) of every sound record, and
        (offset, length, None, reason) of every gap, in order. A gap inside a
        member has the member's place, and its inner offset in the reason."""
        at, gap, why = 0, None, ""
        while at < self.size:
            start = self._at(at, 3)
            try:
                if start == b"\x1f\x8b\x08":
                    found, end, broken = self._member(at)
                elif start == b"WAR":
                    found, end, broken = self._plain(at)
                else:
                    raise Damaged("no member or version line")
            except Damaged as e:
                if gap is None:
                    gap, why = at, str(e)
                at = self._next(at + 1)
                continue
            if gap is not None:
                yield gap, at - gap, None, why.encode()
                gap = None
            if broken:                         # what follows the decoded records is searched as after any damage
                end = self._next(at + 1)
            for fields, block, inner in found:
                yield at, end - at, fields, block if fields is not None else block + b" at inner offset %d" % inner
            if broken:
                yield at, end - at, None, broken.encode()
            at = end
        if gap is not None:
            yield gap, self.size - gap, None, why.encode()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"   # a retried task writes another file
        fs, inner = open_fs(path)
        sink, n = None, 0
        for batch in batches:
            for key, url, html, sha, first in zip(*(batch[c].to_pylist() for c in ("key", "url", "html", "sha", "first"))):
                if sink is None:
                    if isinstance(fs, pafs.LocalFileSystem):
                        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(inner, compression=None)
                sink.write(member(record(key, url, html.encode(), base32(bytes.fromhex(sha)), first, first is not None)))
                n += 1
        if sink is None:
            return
        size = sink.tell()
        sink.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})
    return run


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                   min_payload: int = MIN_PAYLOAD, folder: str | None = None) -> DataFrame:
    """Write one record per page; returns the manifest (path, n_records, n_bytes).

    Of pages with equal payloads of at least `min_payload` bytes, those with
    the smallest key are responses, the others revisits of it. Null html is
    an empty payload. Rows repeated with the smallest key are each a response;
    null keys are never the smallest unless all are null (then all are
    responses). Other columns are ignored; no pages, no files. Only files
    that the manifest names count; what a lost task left is ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_path(spark, "warc")
    rows = pages.select(col(key).alias("own"), col(url).cast("string").alias("url"), F.coalesce(col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = (rows.where(F.octet_length("html") >= min_payload).groupBy("sha")
              .agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "least"))
    # Left join on the payload's digest: a payload that a third of all pages share is split by AQE.
    marked = rows.join(shared, "sha", "left").select(
        F.col("own").cast("string").alias("key"), "url", "html", "sha",
        F.when(F.col("least").isNotNull() & ~F.col("own").eqNullSafe(F.col("least")), F.col("least").cast("string")).alias("first"))
    return written(marked.mapInArrow(_writer(folder), "path string, n_records bigint, n_bytes bigint"), "warc-manifest")


def _key_of(urn: str | None) -> str | None:
    from urllib.parse import unquote
    if not urn or not urn.startswith(f"<{_URN}"):
        return None
    return unquote(urn[len(_URN) + 1:-1]) or None


RECORD = ("path string, offset bigint, length bigint, record_type string, key string, refers_to string, url string, "
          "payload_bytes bigint, payload_digest string, payload binary, reason string")


def _reader(with_payload: bool):
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(f.split(" ")[1], pa.string())) for n, f in zip(names, RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in (p for batch in batches for p in batch["path"].to_pylist()):
            fs, inner = open_fs(path)
            with fs.open_input_file(inner) as file:
                for offset, length, fields, block in Archive(file).records():
                    if fields is None:
                        rows.append((path, offset, length, "gap", None, None, None, None, None, None, block.decode()))
                    elif fields.get("warc-type") in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["warc-type"] == "revisit"
                        n = int(_fields(http).get("content-length") or 0) if revisit else len(payload)
                        digest = fields.get("warc-payload-digest", "").partition(":")[2] if revisit else base32(hashlib.sha1(payload).digest())
                        rows.append((path, offset, length, fields["warc-type"], _key_of(fields.get("warc-record-id")), _key_of(fields.get("warc-refers-to")),
                                     fields.get("warc-target-uri"), n, digest, payload if with_payload and not revisit else None, None))
                        size += len(payload) if with_payload else 0
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives in column `path`, one file per task: responses,
    revisits, and a row of type "gap" for every quarantined run of bytes."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n).mapInArrow(_reader(with_payload), RECORD)


def digest(pages: DataFrame) -> DataFrame:
    """op9: every page's record, read back. Archives just written have no gaps:
    one that the reader logs stops the query."""
    found = read_archives(write_archives(pages))
    found = found.where(F.when(F.col("record_type") == "gap", F.raise_error(F.lit("an archive could not be read back whole")).cast("boolean")).otherwise(F.lit(True)))
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"))
