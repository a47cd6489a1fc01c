"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: payloads are named by their SHA-1; of equal payloads the record with the
largest page id is a ``response``, the others are ``revisit`` records that name it
and carry no payload. Which record that is comes from an aggregation of digests
alone. The lookup of a page's group then moves each page once, and hot payloads
are dealt out by a random key (``common.attach``). A task streams its pages into
one archive; a try writes a file of its own name and only the files of successful
tasks are in the manifest.

Reading: a task reads an archive, frame by frame, in bounded memory. It checks the
version line, the mandatory fields, the block's length and digest, the payload's
length and digest, and the end of the record, and fails on the first that is wrong.

The dictionary is trained on a bounded sample: ``DICT_SAMPLE`` pages, of each at most
``DICT_CHARS`` characters. Where the sample is too small the archives carry none.

Defined cases: a null payload is the empty payload, and empty payloads revisit one
another like any others; a null url leaves the target field out; control characters
of a url are percent-encoded; a page without id is written as ``none`` and read as
null, and is a response only where no page of its payload has an id; rows that
repeat both payload and largest id are all responses; an empty table gives no
archive and no row; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import attach, file_system
from lodeseek.workspace import saved

# Fixed values of the formats.
DICT_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICT_BYTES = 65_536
DICT_SAMPLE = 400
DICT_CHARS = 20_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
_LARGE_CHUNK = 1 << 22


class WarcError(ValueError):
    """An archive that does not keep to the format."""


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?[0-9]+)>", name)
    if not found:
        raise WarcError(f"record id {name!r}")
    return None if found[1] == "none" else int(found[1])


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool
) -> bytes:
    """A whole WARC record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", safe))
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; raises ``WarcError`` where anything does not fit."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (VERSION, b"WARC/1.0"):
        raise WarcError(f"version {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        name = key.decode("ascii", "replace").strip().lower()
        if not colon or not name or name in fields:
            raise WarcError(f"header line {line[:80]!r}")
        fields[name] = value.decode("utf-8").strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise WarcError(f"length {fields['content-length']!r}")
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise WarcError(f"{len(rest) - 4} bytes of block instead of {length}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"type {kind!r}")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{_digest(block)}":
        raise WarcError("block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)(?:\r\n|$)", http)
    if not found or not http.startswith(b"HTTP/") or not size:
        raise WarcError("HTTP header")
    named = fields.get("warc-payload-digest", "")
    if not named.startswith("sha1:"):
        raise WarcError(f"payload digest {named!r}")
    if kind == "response" and (len(payload) != int(size[1]) or named != f"sha1:{_digest(payload)}"):
        raise WarcError("payload")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("revisit")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(size[1]),
        "payload_digest": named[5:],
        "payload": payload if kind == "response" else None,
    }


def read_records(source) -> Iterator[dict]:
    """Records of an open archive, one frame at a time."""
    data = source.read(8)
    codec = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICT_FRAME:
        size = struct.unpack("<I", data[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise WarcError("cut dictionary")
        if raw[:4] == ZSTD_FRAME:
            raw = codec.decompress(raw)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        data = b""
    while True:
        data = data or source.read(CHUNK)
        if not data:
            return
        frame, parts, chunk = codec.decompressobj(), [], CHUNK
        try:
            parts.append(frame.decompress(data))
            while not frame.eof:
                if not (more := source.read(chunk)):
                    raise WarcError("cut frame")
                parts.append(frame.decompress(more))
                chunk = min(2 * chunk, _LARGE_CHUNK)
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        data = frame.unused_data
        yield parse(b"".join(parts))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the bounded sample; empty where that is too small."""
    named = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "url").alias("at"), "html")
    chosen = named.select("at").distinct().orderBy("at").limit(DICT_SAMPLE)
    last = chosen.agg(F.max("at")).first()[0]
    part = F.substring("html", 1, DICT_CHARS).cast("binary")
    sample = named.where(F.col("at") <= F.lit(last)).groupBy("at").agg(F.min(part).alias("part"))
    parts = [bytes(r["part"]) for r in sample.orderBy("at").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes() if len(parts) > 7 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the manifest, read from there."""
    spark = pages.sparkSession
    named = pages.select(
        "page_id",
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = saved(
        named.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")),
        f"{folder}/groups",
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = attach(named, groups, "digest", ["response"], "n", total).select(
        "page_id", "url", "payload", "response"
    )
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(files)
        name, out, n, raw = f"{uuid.uuid4().hex}.warc.zst", None, 0, dictionary.value
        codec = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None
        )
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, response = (c[i].as_py() for c in batch.columns)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    if raw:
                        packed = zstandard.ZstdCompressor(level=19).compress(raw)
                        out.write(struct.pack("<II", DICT_FRAME, len(packed)) + packed)
                revisit = response is not None and page_id != response
                out.write(codec.compress(record(page_id, url, payload, response, revisit)))
                n += 1
        if out is not None:
            out.close()
            yield pa.record_batch([[name], [n]], ["file", "n_records"])

    return saved(placed.mapInArrow(run, "file string, n_records long"), f"{folder}/manifest")


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
_KINDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Checked records of all archives; ``payload`` is null for revisits."""
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(files)
        for batch in batches:
            for name, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}") as source:
                    for row in read_records(source):
                        rows.append(row)
                        held += row["payload_bytes"] + 500
                        seen += 1
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
                if seen != n:
                    raise WarcError(f"{name}: {seen} records instead of {n}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    dealt = manifest.select("file", "n_records").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, _KINDS)
