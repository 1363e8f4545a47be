"""Web archives: WARC records in Zstandard frames with a shared dictionary, written and read by tasks.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one frame for each
record. Archives are cut at about `ARCHIVE_BYTES` and are rows (archive, bytes) of a table, so that Spark reads and
writes them in any store. The reader takes the dictionary from the leading frame, decodes frame by frame, and checks
version line, headers, lengths and payload digests; anything wrong raises ValueError.

Of records with equal payloads of at least `min_revisit` bytes, that with the largest page_id is the response and holds
the payload; the others are revisits that refer to it. Null payloads are empty. Rows with a null page_id are archived,
and refer to others, but no record refers to them, unless all rows of that payload have none, when all are responses.
Repeated rows of the response's id are all responses. Columns but page_id, url and html, of whatever name, are left out.
A payload of any length is one record, which a longer one makes a longer frame. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
#: The dictionary is trained on so many payloads at most, of so many bytes of each.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 16 << 10, 300, 8 << 10
#: Payloads that make up more than one in so many pages are hot; there can't be more of them than that.
HOT_PAYLOADS = 1000
DATE = "2020-01-01T00:00:00Z"
LEVEL = 3


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of the `SAMPLE_ROWS` pages with the smallest hash of id and url; empty if they are too few.

    The driver gets the hashes first, then of the pages up to the last of them so many bytes at most.
    """
    hashed = pages.withColumn("h", F.xxhash64("page_id", "url"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    start = F.encode(F.substring("html", 1, SAMPLE_BYTES), "UTF-8")
    rows = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min(start).alias("x")).orderBy("h").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.x) for r in rows if len(r.x) > 64]).as_bytes()
    except zstandard.ZstdError:
        return b""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value: without line ends, which would start a header of their own."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: the response, or with refers_to the revisit, which has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


_ARCHIVE = pa.schema([("archive", pa.string()), ("bytes", pa.binary())])


def _write(batches: Iterator[pa.RecordBatch], dictionary: bytes, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    head, task = dictionary_frame(dictionary), uuid.uuid4().hex
    parts, size, n = [head], 0, 0

    def archive() -> pa.RecordBatch:
        return pa.record_batch([pa.array([f"{task}-{n:05d}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())], schema=_ARCHIVE)

    for batch in batches:
        for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            frame = compressor.compress(record(page_id, url, (html or "").encode(), refers_to))
            if size and size + len(frame) > archive_bytes:
                yield archive()
                parts, size, n = [head], 0, n + 1
            parts.append(frame)
            size += len(frame)
    if size:
        yield archive()


def write_archives(pages: DataFrame, min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, bytes) of pages (page_id, url, html), by lazy tasks; write the table before reading it twice."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    dictionary = train_dictionary(pages)
    marked = pages.withColumn("payload", F.sha1("html"))
    responses = common.written(marked.filter(F.octet_length("html") >= min_revisit).groupBy("payload").agg(F.max("page_id").alias("response"), F.count("*").alias("n")))
    # a payload of very many pages is looked up in a broadcast table of at most `HOT_PAYLOADS` rows; its pages are dealt by id
    total = responses.agg(F.sum("n")).first()[0] or 0
    hot = responses.filter(F.col("n") * HOT_PAYLOADS > total).select("payload", F.col("response").alias("hot"), F.lit(True).alias("is_hot"))
    spread = marked.join(F.broadcast(hot), "payload", "left").withColumn("dealt", F.when(F.col("is_hot"), F.concat_ws(" ", "payload", F.xxhash64("page_id", "url"))).otherwise(F.col("payload")))
    found = spread.join(responses.select(F.col("payload").alias("dealt"), "response"), "dealt", "left").withColumn("response", F.coalesce("hot", "response"))
    joined = found.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response")).alias("refers_to"))
    # a revisit holds no payload, only its length and digest, but both are taken from the full text
    return joined.mapInArrow(lambda b: _write(b, dictionary, archive_bytes), "archive string, bytes binary")


def frames(raw: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, by the dictionary of its leading frame."""
    view, at, dictionary = memoryview(raw), 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", raw, 4)[0]
        if 8 + size > len(raw):
            raise ValueError("the dictionary frame is cut short")
        body = bytes(view[8 : 8 + size])
        if body[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary can itself be compressed
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, at = zstandard.ZstdCompressionDict(body) if body else None, 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(raw):
        unit = decompressor.decompressobj()
        try:
            out = unit.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise ValueError(f"no frame at byte {at}: {e}") from e
        if not unit.eof:
            raise ValueError("the last frame is cut short")
        at = len(raw) - len(unit.unused_data)
        yield out


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, after checking it."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC header: {raw[:20]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad or repeated header: {line!r}")
        headers[name.lower()] = value.strip(" ")
    try:
        kind, length, said = headers["warc-type"], int(headers["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
        number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x != "<urn:page:>" else None
        page_id, refers_to = number(headers["warc-record-id"]), number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
    except KeyError as e:
        raise ValueError(f"missing header: {e}") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes; the header says {length}")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not sep or size is None or kind not in ("response", "revisit") or (kind == "revisit") != (refers_to is not None):
        raise ValueError(f"bad {kind} record")
    if (len(payload), digest(payload)) != (size, said) if kind == "response" else payload:
        raise ValueError("payload and headers differ")
    return page_id, size, said, kind, refers_to


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            rows = [parse(x) for x in frames(raw.as_py())]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _RESULT)] if rows else [pa.array([], f.type) for f in _RESULT], schema=_RESULT)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (column bytes), checked."""
    return archives.select("bytes").mapInArrow(_read, RESULT)


def archive_round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back."""
    return read_archives(common.written(write_archives(pages, min_revisit)))
