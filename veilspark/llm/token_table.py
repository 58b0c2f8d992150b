"""Token ids as sorted string tables, written and read by Spark tasks.

A shard holds documents in ascending key order: prefix-compressed blocks, then a
Bloom filter, a sparse index with the first key of each block, and a footer of fixed
size.  A point lookup reads the footer, asks the filter, finds the block by binary
search in the index and reads that block alone.

    block   zstd of: count, then for each row (shared key bytes, other key bytes,
            value bytes, start, number of ids) as varints, the keys' tails, the values
    value   ids as little-endian unsigned 16-bit numbers if all fit, else 32-bit
    footer  places and sizes of filter and index, counts, ``MAGIC``

Keys are the documents' identifiers as 8 big-endian bytes with the sign flipped, so
that byte order is number order; 9 bytes with a first 0 stand for a null identifier,
which comes first.  Each Spark partition of a range partitioning writes its own
shards, under names that follow from its number, to a temporary name that is then
moved: a task that runs again writes the same files.  The manifest, a Parquet table of
Spark's, names the shards that count.

Null and empty texts get the end id alone.  Repeated rows are all kept, beside one
another, those of one identifier by length, then ids.  An empty table gives no shards, and reading gives no rows.  A very
long text is one row, which may make a block of its own.  Only identifier and text are read, whatever other columns are called.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches
from .word_ids import encoder

MAGIC = b"VSST0001"
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 64 * 1024 * 1024
FOOTER = struct.Struct("<QQQQQQ8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def varints(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    out = []
    for _ in range(count):
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append(n)
    return out, at


def packed(ids: bytes) -> bytes:
    """A flag, then the ids in 2 or 4 bytes each."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids


def unpacked(value: bytes) -> bytes:
    return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[:1] == b"\2" else value[1:]


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Rows in key order to the bytes of one shard."""

    def __init__(self):
        self.body, self.index, self.keys = bytearray(), [], []
        self.rows: list[tuple[bytes, int, int, bytes]] = []
        self.pending = self.count = 0

    def add(self, key: bytes, start: int, n_ids: int, value: bytes) -> None:
        self.rows.append((key, start, n_ids, value))
        self.keys.append(key)
        self.count += 1
        self.pending += len(value) + 16
        if self.pending >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        head, tails, values, before = bytearray(varint(len(self.rows))), bytearray(), bytearray(), b""
        for key, start, n_ids, value in self.rows:
            shared = next((i for i, (x, y) in enumerate(zip(before, key)) if x != y), min(len(before), len(key)))
            for n in (shared, len(key) - shared, len(value), start, n_ids):
                head += varint(n)
            tails += key[shared:]
            values += value
            before = key
        block = zstandard.ZstdCompressor(level=1).compress(bytes(head + tails + values))
        self.index.append((self.rows[0][0], len(self.body), len(block)))
        self.body += block
        self.rows, self.pending = [], 0

    def close(self) -> bytes:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for key in set(self.keys):
            bloom[bloom_places(key, bits)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        index = bytearray(varint(len(self.index)))
        for key, at, size in self.index:
            index += varint(len(key)) + key + varint(at) + varint(size)
        at = len(self.body)
        return bytes(self.body) + bloom + bytes(index) + FOOTER.pack(at, len(bloom), at + len(bloom), len(index), self.count, len(self.index), MAGIC)


class Shard:
    """Random access to a shard in an open file of pyarrow."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        bloom_at, bloom_n, index_at, index_n, self.count, _, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom = self.read(bloom_at, bloom_n)
        raw = self.read(index_at, index_n)
        (n,), at = varints(raw, 0, 1)
        self.index = []
        for _ in range(n):
            (k,), at = varints(raw, at, 1)
            key = raw[at : at + k]
            (place, length), at = varints(raw, at + k, 2)
            self.index.append((key, place, length))

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> list[tuple[bytes, int, int, bytes]]:
        _, place, length = self.index[k]
        data = zstandard.ZstdDecompressor().decompress(self.read(place, length))
        (n,), at = varints(data, 0, 1)
        heads = []
        for _ in range(n):
            head, at = varints(data, at, 5)
            heads.append(head)
        tail, value, key, out = at, at + sum(h[1] for h in heads), b"", []
        for shared, other, size, start, n_ids in heads:
            key = key[:shared] + data[tail : tail + other]
            out.append((key, start, n_ids, data[value : value + size]))
            tail, value = tail + other, value + size
        return out

    def rows(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        bits = struct.unpack_from("<Q", self.bloom)[0]
        return all(self.bloom[8 + p // 8] >> (7 - p % 8) & 1 for p in bloom_places(key, bits))

    def lookup(self, key: bytes) -> list[tuple[int, int, bytes]]:
        """(start, number of ids, value) of the rows with this key."""
        if not self.may_have(key):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key is not below the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for k in range(max(0, low - 1), len(self.index)):  # equal keys may go on in later blocks
            if self.index[k][0] > key:
                break
            found += [x[1:] for x in self.block(k) if x[0] == key]
        return found


def put(path: str, data: bytes) -> None:
    """Write a whole file: under a name of its own, then moved."""
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    other = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(other) as f:
        f.write(data)
    store.move(other, name)


def write_tables(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode each whole text, append ``end_id`` and write shards under ``path``; the manifest.

    ``partitions``: ranges of keys, by default as many as Spark's shuffle partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def coded(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch, texts in slices(batches):
            ids = [x + end for x in encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(packed, ids)), pa.binary())], names=["doc_id", "n", "value"])

    def write(batches):
        # a worker that encoded before lets go of its table of pieces
        encoder.cache_clear()
        pa.default_memory_pool().release_unused()
        part, shard, start, number = None, None, 0, 0

        def finish():
            nonlocal shard, number
            file = f"{path}/part-{part:06d}-{number:05d}.sst"
            data = shard.close()
            put(file, data)
            out = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [file], "n_docs": [shard.count], "n_ids": [start], "bytes": [len(data)], "first_id": [id_of(shard.keys[0])], "last_id": [id_of(shard.keys[-1])]}, schema=schema)
            shard, number = None, number + 1
            return out

        for batch in batches:
            for p, key, n_ids, value in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "value"))):
                part = p
                shard = shard or ShardWriter()
                shard.add(key_of(key), start, n_ids, value)
                start += n_ids
                if len(shard.body) >= SHARD_BYTES:
                    yield finish()
        if shard:
            yield finish()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Spark samples what it range-partitions: written first, texts are encoded once
    ids = materialize(rows.mapInArrow(coded, "doc_id long, n long, value binary"), "token-ids")
    dealt = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n", "value")
    made = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(write, "part int, number int, path string, n_docs long, n_ids long, bytes long, first_id long, last_id long")
    made.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all shards: ``doc_id``, ``start`` (ids of all before it), ``n_tokens``, ``ids`` (binary)."""
    small_batches(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    # n_ids: of the part up to the end of this shard; one row for each part in the running sum
    parts = manifest.groupBy("part").agg(F.max("n_ids").alias("n_ids"))
    base = parts.select("part", (F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    todo = manifest.join(base, "part").select("path", F.coalesce("base", F.lit(0)).alias("base"))
    tasks = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as f:
                    shard = Shard(f)
                    for k in range(len(shard.index)):
                        rows = [(id_of(key), base + start, n, unpacked(value)) for key, start, n, value in shard.block(k)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return todo.repartition(min(tasks, 4096), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[tuple[int, bytes]]:
    """(number of ids, ids) of the rows with this identifier: filter, index and one block of each shard in range."""
    found = []
    shards = spark.read.parquet(f"{path}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for (file,) in shards.select("path").toLocalIterator():
        store, name = fs.FileSystem.from_uri(file)
        with store.open_input_file(name) as f:
            found += [(n, unpacked(value)) for _, n, value in Shard(f).lookup(key_of(doc_id))]
    return found
