"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame that holds the dictionary (itself compressed); every
record is one frame made with it. Payloads that are equal are written once: the record with the
smallest page id is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SKIPPABLE, ZSTD = (0x184D2A5D).to_bytes(4, "little"), (0xFD2FB528).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: The dictionary's size, the rows it is trained on and how many characters in a row of each; bytes read at a time; size at which a new archive begins.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS, BLOCK, ROLL_BYTES = 64 << 10, 300, 16_000, 1 << 20, 1 << 30
DATE = "2020-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(pages: DataFrame) -> bytes:
    """Trained on a bounded sample of payloads; empty when there are too few."""
    import zstandard

    sample = common.text_sample(pages, "page_id", "html", SAMPLE_ROWS, SAMPLE_CHARS)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t.encode() for t in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row; returns the manifest (file, records), which is also kept in the folder.

    A null payload is empty. A row without an id is a response. Repeated rows of the smallest id
    that have the same payload are all responses. Characters of a URL that a header can't hold are
    percent-encoded; a null URL has no header. Other columns are not read. Only archives that the
    manifest names count, so that those of lost task attempts are never read.
    """
    import zstandard

    spark = common.ready(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    dictionary = _dictionary(rows)
    # Written first, so that Spark can split the join's part for a very common payload.
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    first = common.kept(first, f"{folder}/first")
    placed = rows.join(first, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = pafs.FileSystem.from_uri(folder)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
        done, out, records, size = [], None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    out, records, size = here.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    packed = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
                    out.write(SKIPPABLE + len(packed).to_bytes(4, "little") + packed)
                frame = compressor.compress(_record(*(batch[c][i].as_py() for c in ("page_id", "url")), batch["html"][i].as_py().encode(), batch["first"][i].as_py()))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size > ROLL_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["file", "records"])

    placed.mapInArrow(archive, "file string, records long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, records long").parquet(f"{folder}/manifest")


class Malformed(ValueError):
    """An archive or record that breaks the format."""


def frames(file) -> Iterator[bytes]:
    """Contents of the frames of an open archive, one at a time; the dictionary is loaded first."""
    import zstandard

    head = file.read(8)
    dictionary, rest = None, head
    if head[:4] == SKIPPABLE:
        size = int.from_bytes(head[4:8], "little")
        raw = file.read(size)
        if len(raw) != size:
            raise Malformed("the dictionary is cut off")
        if raw[:4] == ZSTD:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, rest = zstandard.ZstdCompressionDict(raw) if raw else None, b""
    tool = zstandard.ZstdDecompressor(dict_data=dictionary)
    while rest or (rest := file.read(BLOCK)):
        one, parts = tool.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(rest))
            except zstandard.ZstdError as e:
                raise Malformed(f"a frame can't be decoded: {e}") from e
            if one.eof:
                rest = one.unused_data
                break
            rest = file.read(BLOCK)
            if not rest:
                raise Malformed("the last frame is cut off")
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """A record's fields; raises Malformed if headers, lengths or digests don't fit."""
    head, found, body = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Malformed("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Malformed(f"not a header: {line[:80]!r}")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode()
    for name in NEEDED:
        if name not in headers:
            raise Malformed(f"no {name}")
    if headers["warc-type"] not in TYPES:
        raise Malformed(f"unknown type {headers['warc-type']}")
    if not headers["content-length"].isdigit() or len(body) != (size := int(headers["content-length"])) + 4 or body[size:] != b"\r\n\r\n":
        raise Malformed("the block isn't as long as its Content-Length")
    block = body[:size]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise Malformed("the block doesn't have its digest")
    kind, payload, length = headers["warc-type"], block, size
    if headers.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not found:
            raise Malformed("the HTTP header doesn't end")
        length = int(said[1]) if said else len(payload)
        if kind != "revisit" and length != len(payload):
            raise Malformed("the payload isn't as long as its Content-Length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        if "warc-refers-to" not in headers or digest is None:
            raise Malformed("a revisit refers to nothing")
    elif digest is not None and digest != sha1_base32(payload):
        raise Malformed("the payload doesn't have its digest")
    return {"record_type": kind, "record_id": headers["warc-record-id"], "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": length, "payload": None if kind == "revisit" else payload}


SCHEMA = "file string, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def read(files: DataFrame, folder: str = "", payloads: bool = True) -> DataFrame:
    """Records of the archives named in column ``file``, below a folder if one is given.

    A malformed archive fails the read, with its name. Files are read in blocks; a task holds one
    record at a time and a batch of results.
    """
    spark = common.ready(files.sparkSession)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}" if folder else name)
                out, size = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    try:
                        for record in frames(f):
                            out.append({"file": name} | parse(record))
                            if not payloads:
                                out[-1]["payload"] = None
                            size += len(out[-1]["payload"] or b"") + 400
                            if size > 8 << 20:
                                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                                out, size = [], 0
                    except Malformed as e:
                        raise Malformed(f"{name}: {e}") from e
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select("file").repartition(common.partitions(spark)).mapInArrow(load, SCHEMA)


_ARROW = pa.schema([*((c, pa.string()) for c in ("file", "record_type", "record_id", "refers_to", "uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def page_of(urn: Column) -> Column:
    """Page id of a record id."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def digest_rows(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back, and describe the records."""
    folder = common.shared_folder(pages.sparkSession, "warc")
    records = read(write(pages, folder), folder, payloads=False)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
