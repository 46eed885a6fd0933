"""WARC archives: a writer, and a reader that salvages damaged files.

The reader checks every record: the gzip member, the version line, the headers, the
length of the block, the digests, and the end of the record. After a failed check it
looks for the next place where a valid gzip member or version line begins, goes on
there, and reports the bytes in between as a quarantined gap. Bytes that only look like
the beginning of a record cost no record, since records are never searched inside.

A member may hold many records. It is inflated piece by piece, its records are salvaged one
by one in the same way, and a member that is cut off or damaged gives what comes before.
Headers have a bound, and each pattern is searched once, so time grows with the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import by_size
from tideline.scratch import materialise

VERSION = b"WARC/1.1\r\n"
_VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]\r?\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
END = b"\r\n\r\n"
#: Payload bytes of an archive; a larger record has an archive of its own.
ARCHIVE_BYTES = 1 << 24
#: Bytes of a record's headers at most, and of a member that are inflated at once.
HEADER_BYTES, PIECE = 1 << 16, 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2026-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Base32 SHA-1, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value))


def write_record(headers: dict, block: bytes, compress: bool = True) -> bytes:
    lines = [f"{k}: {_clean(v)}\r\n" for k, v in headers.items() if v is not None]
    lines.append(f"WARC-Block-Digest: sha1:{digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n")
    record = VERSION + "".join(lines).encode("utf-8") + block + END
    if not compress:
        return record
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(record) + packer.flush()


def page_record(page_id, url, payload: bytes, refers_to=None, revisit=False, compress=True) -> bytes:
    """A response with its payload, or a revisit that names the response with the same one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        headers |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return write_record(headers, http.encode() + (b"" if revisit else payload), compress)


class _Plain:
    """Bytes that are all there."""

    def __init__(self, data: bytes):
        self.data = data

    def more(self) -> bool:
        return False


class _Inflated:
    """The content of a gzip member, inflated piece by piece as far as it is whole.

    ``data`` is what has been inflated and not ``cut`` off yet; ``gone`` bytes were.
    """

    def __init__(self, source: bytes, at: int):
        self.source, self.at, self.gone, self.data = source, at, 0, b""
        self.unpacker = zlib.decompressobj(wbits=31)

    def more(self) -> bool:
        if self.unpacker is None or self.unpacker.eof:
            return False
        rest = self.unpacker.unconsumed_tail
        piece = rest or self.source[self.at : self.at + PIECE]
        before = self.unpacker.copy()
        try:
            # Without input it gives what the bound held back.
            found = self.unpacker.decompress(piece, 16 * PIECE)
        except zlib.error:
            # What comes before the damage, to the byte.
            for i in range(len(piece)):
                try:
                    self.data += before.decompress(piece[i : i + 1])
                except zlib.error:
                    break
            self.unpacker = None
            return True
        self.data += found
        self.at += 0 if rest else len(piece)
        return bool(piece or found)

    def cut(self, n: int) -> None:
        self.data, self.gone = self.data[n:], self.gone + n


def _parse(source, at: int):
    """(end of the record, headers, block) of a record at ``at``; ValueError if a check fails."""
    while len(source.data) - at < 12 and source.more():
        pass
    line = _VERSION_LINE.match(source.data, at)
    if not line:
        raise ValueError("no version line")
    headers, begin = {}, line.end()
    while True:
        stop = source.data.find(b"\r\n", begin, at + HEADER_BYTES)
        if stop < 0:
            if len(source.data) - at >= HEADER_BYTES or not source.more():
                raise ValueError("headers do not end")
            continue
        text, begin = source.data[begin:stop], stop + 2
        if not text:
            break
        name, colon, value = text.partition(b":")
        if not colon:
            raise ValueError("a header has no colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or len(size) > 18:
        raise ValueError("no length")
    end = begin + int(size)
    while len(source.data) < end + 4 and source.more():
        pass
    if source.data[end : end + 4] != END:
        raise ValueError("the record does not end where it should")
    block = source.data[begin:end]
    named = headers.get("warc-block-digest")
    if named and named.removeprefix("sha1:") != digest(block):
        raise ValueError("block digest differs")
    return end + 4, headers, block


def _extent(data: bytes, at: int):
    """(end of the gzip member at ``at``, what is wrong with it or None); keeps no content."""
    unpacker = zlib.decompressobj(wbits=31)
    while at < len(data):
        piece = data[at : at + PIECE]
        try:
            found = unpacker.decompress(piece, 16 * PIECE)
            # At the end of a member the tail stays as it was, so it does not end the loop.
            while not unpacker.eof and (unpacker.unconsumed_tail or len(found) == 16 * PIECE):
                found = unpacker.decompress(unpacker.unconsumed_tail, 16 * PIECE)
        except zlib.error as problem:
            return at, f"gzip: {problem}"
        at += len(piece)
        if unpacker.eof:
            return at - len(unpacker.unused_data), None
    return at, "gzip member does not end"


def _begins(data: bytes, at: int) -> bool:
    """Whether a valid record begins here, plain or as the first of a gzip member."""
    try:
        if data[at : at + 2] != b"\x1f\x8b":
            _parse(_Plain(data), at)
            return True
        head = zlib.decompressobj(wbits=31).decompress(data[at : at + 512], 5)
        if not head or not b"WARC/".startswith(head):
            return False
        _parse(_Inflated(data, at), 0)
        return True
    except (ValueError, zlib.error):
        return False


class _Search:
    """Places where a record may begin, each pattern searched once over the file."""

    def __init__(self, data: bytes):
        self.data, self.nexts = data, {}

    def after(self, at: int) -> int:
        """The first valid beginning at ``at`` or later, or the end of the file."""
        while at < len(self.data):
            for pattern in (_MEMBER, _VERSION_LINE):
                if self.nexts.get(pattern, -1) < at:
                    found = pattern.search(self.data, at)
                    self.nexts[pattern] = found.start() if found else len(self.data)
            at = min(self.nexts.values())
            if at == len(self.data) or _begins(self.data, at):
                return at
            at += 1
        return len(self.data)


def _inside(data: bytes, at: int, end: int):
    """Records and gaps of the member from ``at`` to ``end``; returns whether it had a record."""
    source, found = _Inflated(data, at), False
    while source.data or source.more():
        if not source.data:
            continue
        try:
            stop, headers, block = _parse(source, 0)
        except ValueError as problem:
            reason, first = str(problem), source.gone
            # The next version line with a whole record.
            while True:
                line = _VERSION_LINE.search(source.data, 1)
                if line is None:
                    # A version line may begin in the last bytes that are there.
                    source.cut(max(0, len(source.data) - 12))
                    if not source.more():
                        source.cut(len(source.data))
                        break
                    continue
                source.cut(line.start())
                try:
                    _parse(source, 0)
                    break
                except ValueError:
                    continue
            yield "gap", at, end, f"{reason} (bytes {first} to {source.gone} of the member)", None
            continue
        found = True
        yield "record", at, end, headers, block
        source.cut(stop)
    return found


def salvage(data: bytes):
    """Yield ("record", start, end, headers, block) and ("gap", start, end, reason, None).

    Places are bytes of the file; the records of a gzip member all have the places of the member,
    and so has a gap inside of it, whose reason names the bytes of the content.
    """
    at, search = 0, _Search(data)
    while at < len(data):
        start = at
        if data[at : at + 2] == b"\x1f\x8b":
            end, problem = _extent(data, at)
            if _begins(data, at) or problem is None:
                whole = yield from _inside(data, at, max(end, at + 2))
                if problem is None:
                    at = end
                    continue
                start = max(end, at + 2) if whole else at
            reason = problem or "no record in the member"
        else:
            try:
                end, headers, block = _parse(_Plain(data), at)
            except ValueError as problem:
                reason = str(problem)
            else:
                yield "record", at, end, headers, block
                at = end
                continue
        at = search.after(max(start, at + 1))
        if at > start:
            yield "gap", start, at, reason, None


def _chunks():
    """Archives of up to ARCHIVE_BYTES, one row each, but for their last byte.

    An archive ends with an empty gzip member, whose last byte is zero; the writer of
    the file puts that byte in as its line end.
    """
    packer = zlib.compressobj(6, wbits=31)
    last = packer.flush()

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("_id", "_url", "_text", "_refers")))

        weight = lambda row: len(row[2]) + 512
        for held in by_size(rows(), weight, ARCHIVE_BYTES):
            records = [
                page_record(i, url, text.encode("utf-8"), refers, refers is not None)
                for i, url, text, refers in held
            ]
            archive = b"".join(records) + last
            assert archive[-1] == 0
            yield pa.RecordBatch.from_arrays([pa.array([archive[:-1]], pa.binary())], names=["archive"])

    return run


def write_pages(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    revisit_bytes: int = 0,
) -> None:
    """Write one record per row to gzip WARC archives below ``path``.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads of at
    least ``revisit_bytes`` the one with the largest identifier is a response and the
    others are revisits of it; rows that repeat the identifier too are all responses, as
    are rows without an identifier. A null address has no header.
    """
    pages = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_text"),
    )
    sha = F.sha2("_text", 256)
    named = pages.where(F.octet_length("_text") >= revisit_bytes).select("_id", sha.alias("_sha"))
    groups = (
        named.groupBy("_sha").agg(F.max("_id").alias("_refers"), F.min("_id").alias("_least"))
        .where("_refers > _least")
    )
    groups = materialise(groups.select("_sha", "_refers"), "payloads")
    refers = F.when(F.col("_id") < F.col("_refers"), F.col("_refers"))
    revisits = materialise(
        named.join(groups, "_sha").where("_id < _refers").select("_id", "_sha", "_refers").distinct(),
        "revisits",
    )
    marked = pages.withColumn("_sha", sha).join(revisits, ["_id", "_sha"], "left").select(
        "_id", "_url", "_text", refers.alias("_refers")
    )
    archives = marked.mapInArrow(_chunks(), "archive binary").select(F.col("archive").cast("string"))
    (
        archives.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
        .option("lineSep", "\x00").text(path)
    )


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


_READ = [
    ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
]


def read_rows(path: str, data: bytes):
    """Rows of an archive as read_archives() returns them."""
    for kind, start, end, headers, block in salvage(data):
        if kind == "gap":
            yield (path, kind, start, end, headers, *[None] * 7)
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        named = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if headers.get("warc-type") == "revisit":
            found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
            size, payload = int(found[1]) if found else None, None
        else:
            size, own = len(payload), digest(payload)
            if named not in (None, own):
                yield (path, "gap", start, end, "payload digest differs", *[None] * 7)
                continue
            named = own
        yield (
            path, kind, start, end, None, _page(headers.get("warc-record-id")),
            headers.get("warc-type"), _page(headers.get("warc-refers-to")),
            headers.get("warc-target-uri"), named, size, payload,
        )


def _read():
    schema = pa.schema(_READ)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows = read_rows(path, data.as_py())
                for part in by_size(rows, lambda r: len(r[-1] or b"") + 256, 1 << 22):
                    columns = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, (_, t) in zip(columns, _READ)], schema=schema
                    )

    return run


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``, plain or gzip.

    ``kind`` is record or gap; ``start`` and ``end`` are bytes of the file. A damaged
    record costs only itself, also within a member of several; its headers have HEADER_BYTES
    at most. A file is one value of its task, so 2 GB at most. A file without any valid record is one gap; an empty
    file gives no row.
    """
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(), ", ".join(f"`{n}` {kinds[t]}" for n, t in _READ))
