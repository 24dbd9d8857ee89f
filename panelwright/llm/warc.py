"""WARC archives compressed by Zstandard: one frame per record after a skippable frame with the dictionary.

Writing: pages are dealt out so that an archive holds about ``ARCHIVE_BYTES`` of payload, however large the table or one group
of equal payloads; Spark reads a file as one row, which must stay under 2 GB. Each task trains a dictionary on the first payloads it meets (bounded by ``SAMPLES``), puts it in a leading
skippable frame (magic 0x184D2A5D) and adds one frame per record. Spark's text writer stores the
frames as bytes, with an empty skippable frame as its line separator, so archives go to any file system Spark
knows, under its own commit protocol. Equal payloads are found by SHA-1: the row of the largest page_id is a
response, the others are revisits that refer to it; the join is salted, for one payload may be a third of all.

Reading: Spark reads whole archive files; a task loads the dictionary from the leading frame, decodes one frame per
record and checks the version line, the headers a record of its type needs, Content-Length against the block,
the final line ends, and the payload's length and digest. A broken archive raises ValueError.

Defined cases: a null html is an empty payload; rows of equal payload that share the largest page_id are all
responses; a null page_id comes back null, and counts as smaller than any; a null url is written as the record's name;
control characters in a url are percent-encoded; an empty table gives archives without records and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm.shared import stored
from panelwright.sources.storage import shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
DICTIONARY_BYTES = 16 << 10
SAMPLES, SAMPLE_BYTES = 200, 2 << 20
LEVEL = 3
FEED = 1 << 16
ARCHIVE_BYTES = 128 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Type", "Content-Length")


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def id_in(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?\d+)>", name)
    if not found:
        raise ValueError(f"not a record name of this archive: {name}")
    return None if found[1] == "none" else int(found[1])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = name_of(page_id)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name[1:-1]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode().split("\r\n")
    pairs = [line.split(":", 1) for line in rest]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("a header line without a colon")
    return first, {k.strip().lower(): v.strip() for k, v in pairs}


def length_in(headers: dict[str, str]) -> int:
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise ValueError("Content-Length is not a number")
    return int(headers["content-length"])


def parsed(data: bytes) -> tuple[int | None, str, str, int | None, int, str, bytes | None]:
    """(page_id, url, type, refers_to, payload bytes, digest, payload or None) of one record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, headers = fields(head)
    if not gap or version != "WARC/1.1":
        raise ValueError("no WARC/1.1 header")
    lacking = [n for n in NEEDED if n.lower() not in headers]
    if lacking:
        raise ValueError(f"headers missing: {lacking}")
    size = length_in(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block, or the record has no end")
    http, gap, body = rest[:size].partition(b"\r\n\r\n")
    status, inner = fields(http)
    if not gap or not status.startswith("HTTP/1."):
        raise ValueError("no HTTP header in the block")
    total, kind = length_in(inner), headers["warc-type"]
    method, _, digest = headers["warc-payload-digest"].partition(":")
    if method != "sha1" or not re.fullmatch(r"[A-Z2-7]{32}", digest):
        raise ValueError("not a SHA-1 payload digest")
    page = id_in(headers["warc-record-id"])
    if kind == "response":
        if len(body) != total or digest_of(body) != digest:
            raise ValueError("the payload differs from its length or digest")
        return page, headers["warc-target-uri"], kind, None, total, digest, body
    if kind != "revisit" or body or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
        raise ValueError(f"not a valid {kind} record")
    return page, headers["warc-target-uri"], kind, id_in(headers["warc-refers-to"]), total, digest, None


def trained(samples: list[bytes]) -> bytes:
    """A dictionary from the samples; too few of them serve as raw content themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or record(None, None, b"", None, False)


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary's frame, then one frame for each record."""
    import zstandard

    head: list[bytes] = []
    held = 0
    more = True
    while more and len(head) < SAMPLES and held < SAMPLE_BYTES:
        item = next(records, None)
        more = item is not None
        if more:
            head.append(item)
            held += len(item)
    content = trained([r[: 64 << 10] for r in head])
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True, write_content_size=True)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    for item in head:
        yield packer.compress(item)
    for item in records:
        yield packer.compress(item)


def archive_records(data: bytes) -> Iterator[bytes]:
    """Each record of an archive, decoded by the dictionary in its leading frame."""
    import zstandard

    view, at, unpacker = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ValueError("the archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC or unpacker is None:
            raise ValueError("no dictionary in front, or not a Zstandard frame")
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + FEED]
            if not len(chunk):
                raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def marked(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, url, html, and keeper: the page that a row of repeated payload refers to, or null.

    Its partitions are the archives: their number follows from the bytes of all payloads, and the parts into which a
    repeated payload is salted from the bytes of its copies.
    """
    pages = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("sha")
    )
    size = F.octet_length("html").cast("long") + 512
    groups = pages.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper"), F.sum(size).alias("bytes"))
    groups = stored(groups)
    total, most = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(least, -(-int(total or 0) // archive_bytes))
    salts = max(16, 4 * -(-int(most or 0) // archive_bytes))
    salted = groups.where("n > 1").select("sha", "keeper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).repartition(files, "sha", "salt")
    joined = spread.join(salted, ["sha", "salt"], "left")
    return joined.select("page_id", "url", "html", "keeper", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))


def written(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages as archives below path, one file a task."""

    def frames(batches):
        def records():
            for batch in batches:
                html = batch.column("html").cast(pa.binary())
                columns = [batch.column(c) for c in ("page_id", "url", "keeper", "revisit")]
                for n in range(batch.num_rows):
                    page, url, keeper, revisit = (c[n].as_py() for c in columns)
                    yield record(page, url, html[n].as_py(), keeper, revisit)

        for frame in archive_frames(records()):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])

    out = marked(pages, archive_bytes).mapInArrow(frames, "frame binary")
    out.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of every record below path."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 7 if payload else 6]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: len(kinds)]

    def rows(batches):
        for batch in batches:
            for data in batch.column("content"):
                held: list[tuple] = []
                for item in archive_records(data.as_py()):
                    held.append(parsed(item)[: len(kinds)])
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(rows, schema)


def round_trip(pages: DataFrame, payload: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The pages written to archives in the shared folder and read back."""
    path = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written(pages, path, archive_bytes)
    return read(pages.sparkSession, path, payload)
