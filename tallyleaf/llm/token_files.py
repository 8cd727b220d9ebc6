"""Token-id files: zstandard frames, one per document, with one shared dictionary.

A token folder holds ``dictionary`` (trained on a bounded sample of serialized id arrays), shards in
ascending document order, and ``manifest``, a Parquet table with one row per shard. A shard:

    magic "TLTOK001" | SHA-256 of the dictionary (32 bytes) | bytes per id (1 byte) | frames | index | index length in bytes (8) | "TLTOKEND"

The index has one record per document (id, null flag, offset and length of the frame, number of
ids), so that one short document can be read without the others. Only shards that the manifest
names count: what a lost task attempt left behind is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_ids

MAGIC, END = b"TLTOK001", b"TLTOKEND"
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
#: The dictionary: its size, and how many documents, and characters in a row from a place in each, it is trained on.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 64 << 10, 400, 8_000
LEVEL = 3


def train_dictionary(docs: DataFrame, key: str, text: str, vocabulary: str, width: int) -> bytes:
    """Train on id arrays of a bounded sample; empty when there are too few of them."""
    import zstandard

    sample = common.text_sample(docs, key, text, SAMPLE_ROWS, SAMPLE_CHARS)
    ids = word_ids.encoder(vocabulary).encode([t.encode() for t in sample])
    arrays = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in ids if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _tools(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _id_bytes(vocabulary: str, end_id: int | None) -> int:
    top = max(word_ids.encoder(vocabulary).library.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    return 2 if top < 1 << 16 else 4


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them as a token folder; returns the manifest.

    Null and empty texts are documents with the end id alone. Keys are integers, or texts of integers. Rows
    with a null key come first; rows with equal keys stay apart, in the order of their ids (a key that holds
    a large share of all rows is dealt to several shards, and in that order within each). Texts are encoded
    where they are read, and only ids are shuffled. Other columns are not read. An empty table makes a
    folder whose manifest has no rows.
    """
    spark = common.ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    width = _id_bytes(vocabulary, end_id)
    dictionary = train_dictionary(rows, "key", "text", vocabulary, width)
    digest = hashlib.sha256(dictionary).digest()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    last = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    n = common.partitions(spark)
    bounds = np.array(common.order_bounds(rows, "key", n, repeats=True), dtype=np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids.encoder(vocabulary).encode
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for start, end in word_ids.batches(texts):
                keys = batch["key"].slice(start, end - start)
                ids = [np.frombuffer(x + last, "<u4").astype(f"<u{width}").tobytes() for x in encode(texts.slice(start, end - start).to_pylist())]
                place = common.dealt_buckets(keys, bounds, ids)
                yield pa.RecordBatch.from_arrays([keys, pa.array(place), pa.array(ids, pa.binary())], names=["key", "bucket", "ids"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, out = _tools(dictionary)[0], None
        for batch in batches:
            for i, k in enumerate(batch["key"].to_pylist()):
                if out is None:
                    bucket = batch["bucket"][i].as_py()
                    name = f"shard-{bucket:06d}-{uuid.uuid4().hex}"
                    here, base = pafs.FileSystem.from_uri(folder)
                    out = here.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC + digest + bytes([width]))
                    at, index, total = len(MAGIC) + 33, [], 0
                ids = batch["ids"][i].as_buffer()
                frame = compressor.compress(ids)
                out.write(frame)
                index.append((k or 0, k is None, at, len(frame), len(ids) // width))
                at += len(frame)
                total += len(ids) // width
        if out is not None:
            packed = np.array(index, INDEX).tobytes()
            out.write(packed + len(packed).to_bytes(8, "little") + END)
            out.close()
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "file": [name], "docs": [len(index)], "ids": [total]}, schema=_MANIFEST)

    placed = rows.mapInArrow(encoded, "key long, bucket int, ids binary").repartitionById(len(bounds) + 1, "bucket")
    ordered = placed.sortWithinPartitions(F.asc_nulls_first("key"), "ids")
    ordered.mapInArrow(shard, "bucket int, file string, docs long, ids long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


_MANIFEST = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("bucket int, file string, docs long, ids long").parquet(f"{folder}/manifest")


def _index(file, size: int) -> tuple[bytes, int, np.ndarray]:
    """Dictionary hash, bytes per id and index of an open shard; refuses anything malformed."""
    file.seek(0)
    head = file.read(len(MAGIC) + 33)
    file.seek(size - 16)
    tail = file.read(16)
    if head[:8] != MAGIC or tail[8:] != END:
        raise ValueError("not a token shard")
    length = int.from_bytes(tail[:8], "little")
    file.seek(size - 16 - length)
    return head[8:40], head[40], np.frombuffer(file.read(length), INDEX)


def _load_dictionary(fs, root: str) -> bytes:
    with fs.open_input_file(f"{root}/dictionary") as f:
        return f.read()


def _checked(dictionary: bytes, digest: bytes) -> None:
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the shard was written with another dictionary")


def read(spark: SparkSession, folder: str, content: str = "ids") -> DataFrame:
    """Documents of a token folder: key, start (ids before it), n_tokens, and ids (packed, unsigned 32
    bits) or, with content "crc", their checksum instead (ids_crc32).

    One row per shard says where each begins; that table has as many rows as there were partitions.
    """
    common.ready(spark)
    shards = sorted(manifest(spark, folder).collect(), key=lambda r: r.bucket)
    before, plan = 0, []
    for r in shards:
        plan.append((r.file, before))
        before += r.ids

    last = "ids" if content == "ids" else "ids_crc32"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        dictionary = _load_dictionary(fs, root)
        _, decompressor = _tools(dictionary)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                size = fs.get_file_info(f"{root}/{name}").size
                with fs.open_input_file(f"{root}/{name}") as f:
                    digest, width, index = _index(f, size)
                    _checked(dictionary, digest)
                    starts = start + np.concatenate([[0], np.cumsum(index["ids"].astype(np.int64))])
                    for at in range(0, len(index), 512):
                        part = index[at : at + 512]
                        low = int(part["offset"][0])
                        f.seek(low)
                        block = f.read(int(part["offset"][-1]) + int(part["bytes"][-1]) - low)
                        ids = []
                        for r in part:
                            a = int(r["offset"]) - low
                            raw = np.frombuffer(decompressor.decompress(block[a : a + int(r["bytes"])]), f"<u{width}")
                            if len(raw) != r["ids"]:
                                raise ValueError(f"{name}: a frame has {len(raw)} ids, its index says {r['ids']}")
                            packed = raw.astype("<u4").tobytes()
                            ids.append(packed if content == "ids" else zlib.crc32(packed))
                        yield pa.RecordBatch.from_arrays([pa.array(part["id"].astype(np.int64), mask=part["null"].astype(bool)), pa.array(starts[at : at + len(part)]), pa.array(part["ids"].astype(np.int64)), pa.array(ids, pa.binary() if content == "ids" else pa.int64())], names=["key", "start", "n_tokens", last])

    files = spark.createDataFrame(plan, "file string, start long").repartition(max(1, len(plan)))
    return files.mapInArrow(load, f"key long, start long, n_tokens long, {'ids binary' if content == 'ids' else 'ids_crc32 long'}")


def read_document(spark: SparkSession, folder: str, key: int) -> list[list[int]]:
    """Ids of the documents with one key, from their frames alone."""
    fs, root = pafs.FileSystem.from_uri(folder)
    dictionary = _load_dictionary(fs, root)
    _, decompressor = _tools(dictionary)
    found = []
    for r in manifest(spark, folder).collect():
        size = fs.get_file_info(f"{root}/{r.file}").size
        with fs.open_input_file(f"{root}/{r.file}") as f:
            digest, width, index = _index(f, size)
            _checked(dictionary, digest)
            for x in index[(index["id"] == key) & (index["null"] == 0)]:
                f.seek(int(x["offset"]))
                found.append(np.frombuffer(decompressor.decompress(f.read(int(x["bytes"]))), f"<u{width}").tolist())
    return found


def digest_rows(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write documents as token files, read them back, and describe what was read."""
    write(docs, folder, vocabulary, end_id)
    return read(docs.sparkSession, folder, "crc").withColumnRenamed("key", "doc_id")
