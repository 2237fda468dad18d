"""WARC archives of gzip members, one a record, and a reader that splits a file anywhere.

Writing. Payloads that repeat are found by an aggregate over their hash (SHA-256 and size): of those equal, the
record of least id is a ``response`` and the others are ``revisit`` records that refer to it. Each task writes one
file into the shared folder, under a name of its attempt, and moves it into place when whole.

Reading. A task gets a byte range. It scans for the gzip magic, and takes a place for a member's start only if
what is there decompresses to a WARC header, and the member ends where another begins or the file does. From the
first such place it goes from member to member; it owns the records that start inside its range and reads the last
of them to its end, beyond the range if need be. So every record is read once, whatever the ranges.

Cases: a null payload is empty; equal payloads shorter than ``min_bytes`` are all responses; rows that repeat the least
id are all responses; a null id refers to nothing and is a response only where its group has no id; a null url is left
out; spaces and control characters of a url are percent-encoded, as a header needs, and read back so; payloads may be larger than a range; an empty table gives no file
and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import filesystem, slots, written

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
RANGE_BYTES = 32 << 20
URN = "urn:ledgerloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record as one gzip member. A revisit's block has the headers of the full payload and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{'' if refers_to is None else refers_to}>"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> list[tuple[str, int]]:
    """Write a record of every row below ``folder``; return (file, bytes), a row a file."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("hash"), F.octet_length("payload").alias("size"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("hash", "size").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = written(groups.where("n > 1").select("hash", "size", "least"), "repeated-payloads")  # its size tells Spark whether to broadcast it
    told = keyed.join(repeated.withColumn("again", F.lit(True)), ["hash", "size"], "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("least"))
    told = told.select("id", "url", "payload", revisit.alias("revisit"), F.col("least"))

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        out, size = None, 0
        for batch in batches:
            for page, link, payload, again, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/.{name}", compression=None)
                member = record("revisit" if again else "response", page, link, payload, least if again else None)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_pydict({"file": [f"{name}.warc.gz"], "size": [size]}, pa.schema([("file", pa.string()), ("size", pa.int64())]))

    made = told.mapInArrow(write, "file string, size long").collect()  # only what its task has told of counts: a lost attempt's file is not among them
    return sorted((f"{folder}/{r['file']}", r["size"]) for r in made)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, names in lower case, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers.get("content-length", len(rest)))]


class Window:
    """Bytes of an open file from a place on, read as they are asked for."""

    def __init__(self, stream, at: int, size: int):
        self.stream, self.at, self.size, self.held = stream, at, size, b""
        stream.seek(at)

    def more(self) -> bool:
        got = self.stream.read(READ)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _begins(held: bytes) -> bool:
    """Whether a member that starts here decompresses to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(held[:4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(window: Window) -> tuple[bytes, int] | None:
    """The content and the length of the member at the window's start; None if it isn't one."""
    inflate, parts, fed = zlib.decompressobj(31), [], 0
    try:
        while True:
            if fed == len(window.held) and not window.more():
                return None
            chunk = window.held[fed : fed + READ]
            parts.append(inflate.decompress(chunk))
            fed += len(chunk)
            if inflate.eof:
                return b"".join(parts), fed - len(inflate.unused_data)
    except zlib.error:
        return None


def _followed(window: Window, n: int) -> bool:
    """Whether the file ends n bytes on, or another member begins there."""
    while len(window.held) < n + 4096 and window.more():
        pass
    return window.at + n >= window.size or _begins(window.held[n : n + 4096])


def members(stream, start: int, end: int, size: int):
    """(place, content) of every record that starts in [start, end) of an open file."""
    window, found = Window(stream, start, size), start == 0
    while window.at < end:
        if not found:
            while len(window.held) < 4096 and window.more():
                pass
            at = window.held.find(MAGIC)
            if at < 0:
                if len(window.held) <= 2 or not window.more():
                    return
                window.drop(max(0, len(window.held) - READ - 2))
                continue
            window.drop(at)
            while len(window.held) < 4096 and window.more():
                pass
            if window.at >= end:
                return
            if not _begins(window.held) or (got := _member(window)) is None or not _followed(window, got[1]):
                window.drop(1)
                continue
            found = True
        elif (got := _member(window)) is None:
            if not window.held:
                return
            raise ValueError(f"no gzip member at byte {window.at}")
        yield window.at, got[0]
        window.drop(got[1])


def read_archives(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, place, record_type, record_id, url, payload, payload_bytes, payload_digest, refers_to) of every record.

    ``payload`` is null of a revisit, whose size and digest are those its headers tell; of others both are computed anew,
    and a digest that differs from the header's is an error.
    """
    kind = pa.schema([("file", pa.string()), ("place", pa.int64()), ("record_type", pa.string()), ("record_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def number(name: str | None) -> int | None:
        return int(x) if name and (x := name.strip("<>").removeprefix(URN)) else None

    def read(batches):
        for batch in batches:
            for file, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = filesystem(file)
                rows, held = [], 0
                with fs.open_input_file(at) as stream:
                    for place, raw in members(stream, start, end, size):
                        head, block = parsed(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "revisit":
                            n, own, payload = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), told, None
                        else:
                            n, own = len(payload), digest(payload)
                            if own != told:
                                raise ValueError(f"{file}, byte {place}: the payload's digest is {own}, its header's {told}")
                        link = head.get("warc-target-uri")
                        rows.append((file, place, head["warc-type"], number(head["warc-record-id"]), link, payload, n, own, number(head.get("warc-refers-to"))))
                        held += len(payload or b"")
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    ranges = [(f, at, min(at + range_bytes, size), size) for f, size in files for at in range(0, size, range_bytes)]
    listed = spark.createDataFrame(ranges, "file string, start long, end long, size long")
    spec = "file string, place long, record_type string, record_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return listed.repartition(max(1, min(len(ranges), 4 * slots(spark)))).mapInArrow(read, spec)
