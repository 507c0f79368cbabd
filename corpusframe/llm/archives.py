"""Web archives: ARC records of both header versions become WARC records, which are written and read again.

An ARC archive starts with a version block, whose first line names the file and its length and whose body tells
the version and the fields of the header lines that follow: five in version 1, ten in version 2. Each record is
one header line, as many bytes as the line declares, and a line feed. A converted record gets what ARC lacks: an
identifier made from the record's own content, a timestamp, a type, and digests of block and payload.

Archives are read as bytes through Spark's ``binaryFile`` source and written by its text writer, whose line feed
ends each record, so both work in any store that Spark knows, and a task that is lost is written anew.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, remove, table_path

#: Records with payloads of fewer bytes never revisit another.
LEAST_BYTES = 1000
#: Records in a written archive, which is read again as one row.
FILE_RECORDS = 2000
#: Digests of repeated payloads that are sent to every task (48 MB); beyond it they are joined by shuffle.
BROADCAST_DIGESTS = 400_000
#: The header that carries a row's key through an archive.
KEY_HEADER = "X-Page-Id"
#: The header of a revisit that names the key of what it revisits, beside its identifier.
REFERS_TO_KEY = "X-Refers-To-Page-Id"
#: The header of a revisit with the bytes of the payload that it leaves out, which HTTP headers need not tell.
LENGTH_HEADER = "X-Payload-Length"

# Names of the header fields of both ARC versions, in their order.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}

RECORDS = "uri string, ip string, date string, type string, mime string, key string, payload_bytes long, payload_digest string, block_digest string, record_id string, headers binary, payload binary"


class Bytes:
    """Reads lines and counted bytes from parts of an archive, gunzipped if they are gzip members, with at most
    one record and one part in memory."""

    PART = 1 << 20

    def __init__(self, content: bytes):
        self.parts, self.held, self.at = self._parts(content), bytearray(), 0

    def _parts(self, content: bytes) -> Iterator[bytes]:
        view = memoryview(content)
        if content[:2] != b"\x1f\x8b":
            for i in range(0, len(view), self.PART):
                yield bytes(view[i : i + self.PART])
            return
        member, rest, at = zlib.decompressobj(31), b"", 0
        while rest or at < len(view):
            if not rest:
                rest, at = bytes(view[at : at + self.PART]), at + self.PART
            out = member.decompress(rest, self.PART)
            rest = member.unconsumed_tail
            if member.eof:
                rest = member.unused_data or rest
                member = zlib.decompressobj(31)
            if out:
                yield out

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        if self.at:
            del self.held[: self.at]
            self.at = 0
        self.held += part
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        searched = self.at
        while (end := self.held.find(b"\n", searched)) < 0:
            searched, left = len(self.held) - self.at, len(self.held) > self.at
            if not self._more():
                if not left:
                    return None
                end = len(self.held)
                break
        line = bytes(self.held[self.at : end])
        self.at = min(end + 1, len(self.held))
        return line.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer where the archive ends before."""
        while len(self.held) - self.at < n and self._more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(headers with the empty line behind them, payload) of a block; headers are empty if it has none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def header(headers: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", headers)
    return found[1].decode("utf-8", "replace") if found else None


def iso(date: str) -> str:
    """An ARC date of up to fourteen digits as a WARC timestamp; what a shorter one lacks is its least value."""
    digits = re.sub(r"\D", "", date)[:14]
    filled = digits + "00010101000000"[len(digits) :]
    return f"{filled[:4]}-{filled[4:6]}-{filled[6:8]}T{filled[8:10]}:{filled[10:12]}:{filled[12:]}Z"


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an ARC archive, version blocks among them.

    The fields of a header line are those that the last version block names. Without one, or where a line does
    not have as many, its number of fields tells the version: ten are version 2. An address with blanks keeps
    them. A record that the archive cuts off has what is left. A line that ends in no length ends the archive.
    """
    data, fields = Bytes(content), FIELDS[1]
    while (line := data.line()) is not None:
        words = line.decode("utf-8", "replace").split(" ")
        if not line.strip():
            continue
        if line.startswith(b"filedesc:"):
            names = FIELDS[1] if len(words) < 10 else FIELDS[2]
        else:
            names = fields if len(words) >= len(fields) else FIELDS[1]
        if len(words) < len(names) or not words[-1].strip().isdigit():
            return
        cut = len(words) - len(names) + 1
        told = dict(zip(names, [" ".join(words[:cut]), *words[cut:]], strict=True))
        block = data.take(int(told["Archive-length"]))
        if line.startswith(b"filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            named = tuple(x.strip() for x in lines[1].split(" ")) if len(lines) > 1 and lines[1].strip() else ()
            fields = named if named and named[-1] == "Archive-length" else FIELDS[2 if version == "2" else 1]
        yield told, block


def converted(told: dict[str, str], block: bytes) -> tuple:
    """What a WARC record of an ARC record holds, as in ``RECORDS``.

    A version block becomes ``warcinfo``, a block with HTTP headers ``response``, any other ``resource``. The
    identifier is a name-based UUID of address, date and content: the same record always has the same one.
    """
    uri, date, mime = told["URL"], iso(told["Archive-date"]), told["Content-type"]
    headers, payload = http_parts(block)
    kind = "warcinfo" if uri.startswith("filedesc:") else "response" if headers else "resource"
    digest, whole = hashlib.sha1(payload).hexdigest(), hashlib.sha1(block).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {date} {whole}")
    return uri, told["IP-address"], date, kind, mime, header(headers, KEY_HEADER), len(payload), digest, whole, f"urn:uuid:{name}", headers, payload


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 16 << 20, size: int = -1) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most about ``most`` bytes of what stands at ``size``."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[size] or b"") + 512
        if n >= most:
            yield _batch(held, names, types)
            held, n = [], 0
    yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_NAMES = [x.split(" ")[0] for x in RECORDS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in RECORDS.split(", ")]


def records(archives: DataFrame, content: str = "content", blocks: bool = True) -> DataFrame:
    """The converted records of ARC archives, given as rows of bytes (as ``binaryFile`` reads them), gzipped or not.

    ``blocks=False`` leaves headers and payloads empty, for what needs digests alone. Null and empty contents
    have no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (converted(*r) for c in b.column(0) if (held := c.as_py()) for r in arc_records(held))
            yield from _batches(rows if blocks else ((*r[:-2], None, None) for r in rows), _NAMES, _TYPES)

    return archives.select(content).mapInArrow(run, RECORDS)


def arc_bytes(uri: Column, date: Column, mime: Column, key: Column, payload: Column, version: Column) -> Column:
    """A row as an ARC archive of its own: a version block of version 1 or 2, and one record with HTTP headers.

    Blanks and control characters of an address are escaped, as it stands in a line of blank-separated fields; a
    null one is ``urn:none``, and one that looks like a version block's is escaped. A null payload is empty; a null key has no header.
    """
    body = F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))
    where = F.coalesce(F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))
    where = F.when(where == "", F.lit("urn:none")).otherwise(F.regexp_replace(where, "^filedesc:", "%66iledesc:"))
    named = F.coalesce(F.concat(F.lit(f"{KEY_HEADER}: "), key.cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), mime, F.lit("\r\n"), named, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    length = (F.octet_length(head) + F.octet_length(body)).cast("string")
    second = version == 2
    record = F.concat_ws(" ", where, F.lit("0.0.0.0"), date, mime, F.when(second, F.lit("200 - - 0 pages.arc")), length)
    about = F.when(second, F.lit("2 0 corpus\n" + " ".join(FIELDS[2]) + "\n")).otherwise(F.lit("1 0 corpus\n" + " ".join(FIELDS[1]) + "\n"))
    first = F.concat_ws(" ", F.lit("filedesc://pages.arc 0.0.0.0"), date, F.lit("text/plain"), F.when(second, F.lit("200 - - 0 pages.arc")), F.octet_length(about).cast("string"))
    start = F.concat(first, F.lit("\n"), about, F.lit("\n"), record, F.lit("\n"), head)
    return F.concat(F.encode(start, "UTF-8"), body, F.lit(b"\n"))


def with_revisits(found: DataFrame, digests: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Add ``of`` (key, record_id, uri, date) to records: the one with the largest key among those of equal payloads
    of ``least`` bytes or more, null for that record itself, for smaller payloads and for payloads found once.

    Records that share the largest key are all responses. A null key is below all others; where all are null, all
    are responses. ``digests`` are the same records without blocks: keys and digests alone are grouped, combined
    before the shuffle, and what is found is written once. Repeated digests are sent to every task up to
    ``BROADCAST_DIGESTS`` after a count.
    """
    many = digests.where((F.col("type") == "response") & (F.col("payload_bytes") >= least)).groupBy("payload_digest", "payload_bytes")
    many = many.agg(F.max(F.struct(F.col("key").cast("long").alias("key"), "record_id", "uri", "date")).alias("_largest"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _largest.key IS NOT NULL").drop("_n")
    many = cut(many)
    few = many.count() <= BROADCAST_DIGESTS
    joined = found.join(F.broadcast(many) if few else many, ["payload_digest", "payload_bytes"], "left")
    itself = (F.col("type") != "response") | F.col("key").cast("long").eqNullSafe(F.col("_largest.key"))
    return joined.withColumn("of", F.when(~itself, F.col("_largest"))).drop("_largest")


def _sha1(digest: Column) -> Column:
    return F.concat(F.lit("sha1:"), digest)


def warc_lines(found: DataFrame) -> DataFrame:
    """(value): each record as it stands in a WARC file, less the line feed that the text writer puts behind it.

    A revisit has its own HTTP headers, the length and digest of its payload, and no payload.
    """
    revisit = F.col("of").isNotNull()
    block = F.when(revisit, F.col("headers")).otherwise(F.concat("headers", "payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    digest = F.when(revisit, F.lower(F.sha1(F.col("headers")))).otherwise(F.col("block_digest"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("uri"))), line("WARC-Filename", F.when(F.col("type") == "warcinfo", F.regexp_replace("uri", "^filedesc:/*", ""))), line("WARC-IP-Address", F.when(F.col("type") != "warcinfo", F.col("ip"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))), line("WARC-Refers-To", F.concat(F.lit("<"), "of.record_id", F.lit(">"))), line("WARC-Refers-To-Target-URI", F.col("of.uri")), line("WARC-Refers-To-Date", F.col("of.date")), line(REFERS_TO_KEY, F.col("of.key").cast("string")), line(LENGTH_HEADER, F.when(revisit, F.col("payload_bytes").cast("string"))),
        line("WARC-Payload-Digest", F.when(F.col("type") != "warcinfo", _sha1(F.col("payload_digest")))), line("WARC-Block-Digest", _sha1(digest)),
        line("Content-Type", F.when(F.col("type") == "response", F.lit("application/http; msgtype=response")).when(F.col("type") == "warcinfo", F.lit("application/warc-fields")).otherwise(F.col("mime"))), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return found.select(F.concat(F.encode(head, "UTF-8"), block, F.lit(b"\r\n\r")).cast("string").alias("value"))


def write(found: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files of at most ``FILE_RECORDS`` records."""
    warc_lines(found).write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", "\n").text(path)


def warc_records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of each record of a WARC file, by declared lengths. A block that the file cuts off, or whose
    digest is not that of its headers, is an error."""
    data = Bytes(content)
    while (line := data.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record starts with {line[:80]!r}")
            continue
        lines = []
        while line:
            lines.append(line)
            line = data.line()
        headers = b"\r\n".join(lines)
        length = int(header(headers, "Content-Length") or 0)
        block = data.take(length)
        told = header(headers, "WARC-Block-Digest")
        if len(block) < length or told and told != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError(f"record {header(headers, 'WARC-Record-ID')} is damaged")
        yield headers, block


def _facts(headers: bytes, block: bytes) -> tuple:
    kind, (http, payload) = header(headers, "WARC-Type"), http_parts(block)
    of = header(headers, REFERS_TO_KEY)
    if kind == "revisit":
        size, digest = int(header(headers, LENGTH_HEADER) or header(http, "Content-Length") or 0), (header(headers, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    key = header(http, KEY_HEADER)
    return int(key) if key else None, kind, size, digest, int(of) if of else None


def read(spark, path: str) -> DataFrame:
    """(key, type, payload_bytes, payload_digest, refers_to) of all records of the WARC files below a path. Size
    and digest are taken from payloads, those of revisits from their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (_facts(*r) for c in b.column(0) for r in warc_records(c.as_py()))
            yield from _batches(rows, ["key", "type", "payload_bytes", "payload_digest", "refers_to"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], size=3)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key long, type string, payload_bytes long, payload_digest string, refers_to long")


def archived_pages(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """Pages as ARC records (even keys in version 1, odd ones in version 2), converted, written as WARC and read
    back: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, a row for each page.

    A null page is empty. Rows that repeat a page are records of their own and, with the largest key of their
    payload, all responses. A null key is below all others; its record refers to the largest one. Null, blank
    and odd addresses are escaped. A page of any length is read whole. An empty table gives an empty one. Other
    columns are not read.
    """
    spark, number = pages.sparkSession, F.col(key).cast("long")
    content = fresh("content", pages)
    version = F.when(F.pmod(F.coalesce(number, F.lit(0)), F.lit(2)) == 0, 1).otherwise(2)
    arcs = pages.select(arc_bytes(F.col(uri).cast("string"), F.lit("20200101000000"), F.lit("text/html"), number, F.col(html).cast("string"), version).alias(content))
    path = table_path(spark, "warc")
    write(with_revisits(records(arcs, content), records(arcs, content, blocks=False)), path)
    found = read(spark, path).where("type <> 'warcinfo'")
    kept = table_path(spark, "archived")
    found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to").write.parquet(kept)
    remove(spark, path)
    return spark.read.parquet(kept)
