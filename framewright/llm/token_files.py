"""Token ids in binary shard files, each one a wavelet matrix.

A shard holds the ids of consecutive documents. Its ids are stored as bit
planes, highest bit first; each plane partitions the ids stably by that bit, so
that rank on the planes leads from a position to its id and back. Planes are
compressed in blocks beside counts of ones at every COUNT_BITS-th bit: reading one
token, counting an id or finding its k-th occurrence touches one block per plane and
no other data, and counts no more than that many bits.

Defined results: a null text is an empty one; documents are ordered by doc_id
(nulls first), rows of equal doc_id by text; other columns are ignored; an empty
table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import Scratch, file_system, row_tasks
from .tokens import batches, word_encoder

MAGIC = b"WMTX0001"
#: Bits of a plane in one compressed block.
BLOCK_BITS = 1 << 19
#: Bits of a plane between two counts of its ones.
COUNT_BITS = 1 << 12
#: Ids in a shard at most, unless one document has more.
SHARD_TOKENS = 1 << 22


def build_planes(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The bit planes of the ids, highest first, and the zeros in each."""
    planes, zeros = [], []
    now = ids.astype(np.uint16 if not len(ids) or int(ids.max()) < 1 << 16 else np.uint32)
    top = max(1, int(now.max()).bit_length()) if len(now) else 1
    for bit in range(top - 1, -1, -1):
        ones = (now & now.dtype.type(1 << bit)) != 0
        planes.append(ones)
        low = now[~ones]
        zeros.append(len(low))
        now = np.concatenate([low, now[ones]])
    return planes, zeros


def counts_of(ones: np.ndarray) -> np.ndarray:
    """Ones of a plane before every COUNT_BITS-th bit."""
    sums = np.add.reduceat(ones, np.arange(0, len(ones), COUNT_BITS), dtype=np.int64) if len(ones) else np.zeros(0, np.int64)
    return np.cumsum(sums) - sums


def encode_shard(ids: np.ndarray, doc_ends: np.ndarray, doc_ids: np.ndarray, nameless: int = 0) -> bytes:
    """One shard file: header, document table, then each plane's blocks. The first ``nameless`` documents have no doc_id."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    planes, zeros = build_planes(ids)
    body: list[bytes] = []
    at = 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(data)
        at += len(data)
        return at - len(data), len(data)

    head = {"n": len(ids), "docs": len(doc_ends), "nameless": nameless, "zeros": zeros, "block_bits": BLOCK_BITS, "count_bits": COUNT_BITS, "blocks": [], "counts": []}
    head["doc_ends"] = put(pack.compress(doc_ends.astype("<i8").tobytes()))
    head["doc_ids"] = put(pack.compress(doc_ids.astype("<i8").tobytes()))
    for ones in planes:
        head["blocks"].append([put(pack.compress(np.packbits(ones[a : a + BLOCK_BITS]).tobytes())) for a in range(0, len(ones), BLOCK_BITS)])
        head["counts"].append(put(pack.compress(counts_of(ones).astype("<i8").tobytes())))
    text = json.dumps(head, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<I", len(text)) + text + b"".join(body)


class WaveletShard:
    """Reads one shard through ``fetch(offset, length) -> bytes``."""

    def __init__(self, fetch):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor()
        self.fetch = fetch
        if fetch(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack("<I", fetch(8, 4))
        self.head = json.loads(fetch(12, size))
        self.base = 12 + size
        self.n, self.zeros, self.levels = self.head["n"], self.head["zeros"], len(self.head["zeros"])
        self.step, self.count_step = self.head["block_bits"], self.head["count_bits"]
        self.seen: dict[tuple[int, int], np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}

    def _piece(self, at: list[int]) -> bytes:
        return self.unpack.decompress(self.fetch(self.base + at[0], at[1]))

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """doc_id (null for documents without) and end of each document."""
        ends = np.frombuffer(self._piece(self.head["doc_ends"]), "<i8")
        return pa.array(np.frombuffer(self._piece(self.head["doc_ids"]), "<i8"), mask=np.arange(len(ends)) < self.head["nameless"]), ends

    def block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.seen:
            if len(self.seen) >= 4 * self.levels:
                self.seen.clear()
            size = min(self.step, self.n - k * self.step)
            bits = np.frombuffer(self._piece(self.head["blocks"][level][k]), np.uint8)
            self.seen[level, k] = np.unpackbits(bits, count=size)
        return self.seen[level, k]

    def ones(self, level: int, i: int) -> int:
        """Ones of the plane before position i."""
        if i == 0:
            return 0
        last = (i - 1) // self.count_step  # the last count before i; no more than count_step bits are looked at
        begin, k = last * self.count_step, (i - 1) // self.step
        return int(self._counts(level)[last]) + int(np.count_nonzero(self.block(level, k)[begin - k * self.step : i - k * self.step]))

    def _counts(self, level: int) -> np.ndarray:
        if level not in self.counts:
            self.counts[level] = np.frombuffer(self._piece(self.head["counts"][level]), "<i8")
        return self.counts[level]

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self.block(level, i // self.step)[i % self.step])
            before = self.ones(level, i)
            i = self.zeros[level] + before if bit else i - before
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            oa, ob = self.ones(level, a), self.ones(level, b)
            a, b = (self.zeros[level] + oa, self.zeros[level] + ob) if token >> (self.levels - 1 - level) & 1 else (a - oa, b - ob)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before a position."""
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of an id's k-th occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        counts = self._counts(level)
        before = counts if bit else np.arange(len(counts), dtype=np.int64) * self.count_step - counts
        last = int(np.searchsorted(before, k, side="right")) - 1
        begin, block = last * self.count_step, last * self.count_step // self.step
        some = self.block(level, block)[begin - block * self.step :][: self.count_step]
        return begin + int(np.flatnonzero(some == bit)[k - before[last]])

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in range(self.levels - 1, -1, -1):
            parts = [np.frombuffer(self._piece(at), np.uint8) for at in self.head["blocks"][level]]
            ones = np.unpackbits(np.concatenate(parts), count=self.n).view(bool) if parts else np.zeros(0, bool)
            up = np.empty_like(now)
            up[~ones] = now[: self.zeros[level]]
            up[ones] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = up
        return now.astype(np.uint32)


def open_shard(uri: str) -> WaveletShard:
    store, path = file_system(uri)
    handle = store.open_input_file(path)

    def fetch(offset: int, length: int) -> bytes:
        handle.seek(offset)
        return handle.read(length)

    return WaveletShard(fetch)


INDEX_SCHEMA = "part int, shard int, file string, first_doc long, docs long, tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int"


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the documents' ids as shard files in a folder; returns the index, one row per file.

    Files get names that no other attempt uses, and only the attempt whose index
    rows are kept counts, so a repeated task leaves unlisted files at worst.
    """

    def write(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, (store, path) = word_encoder(tokenizer_path), file_system(folder)
        store.create_dir(path, recursive=True)
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard
            flat, named = np.concatenate(ids), pa.concat_arrays(names)
            doc_ids = np.asarray(named.fill_null(0), dtype=np.int64)
            name = f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(encode_shard(flat, np.concatenate(ends), doc_ids, named.null_count))  # nulls come first
            row = [part, shard, f"{folder}/{name}", named[0].as_py(), len(doc_ids), len(flat)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            ids.clear(), ends.clear(), names.clear()
            held, shard = 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "shard", "file", "first_doc", "docs", "tokens"])

        for batch in batches(incoming):
            flat, starts = coder.column(batch.column("text"))
            n = batch.num_rows
            with_end = np.insert(flat, starts[1:], np.uint32(end_id))
            stops = starts[1:] + np.arange(1, n + 1)
            doc_ids = batch.column("doc_id").cast(pa.int64())
            a = 0
            while a < n:
                begin = int(stops[a - 1]) if a else 0
                room = max(shard_tokens - held, 1)
                b = max(int(np.searchsorted(stops, begin + room, side="right")), a + (held == 0))
                if b > a:
                    ids.append(with_end[begin : stops[b - 1]])
                    ends.append(stops[a:b] - begin + held)
                    names.append(doc_ids.slice(a, b - a))
                    held += int(stops[b - 1]) - begin
                if b < n:
                    yield flush()
                a = b
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(row_tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, INDEX_SCHEMA)


def read_shards(index: DataFrame) -> DataFrame:
    """Per document of the listed files (file, part, shard, base: ids of all earlier files): its place, its length and the crc32 of its ids."""

    def read(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for row in batch.to_pylist():
                shard = open_shard(row["file"])
                flat = shard.decode().astype("<u4")
                doc_ids, ends = shard.documents()
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(starts + row["base"], pa.int64()), pa.array(ends - starts, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"])

    spark = index.sparkSession
    return index.select("file", "part", "shard", "base").repartition(row_tasks(spark), "file").mapInArrow(read, READ_SCHEMA)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write, list and read back: doc_id, start, n_tokens, ids_crc32, and the shard that holds the document.

    The file list has one row per some million ids; running sums over it turn
    places in a shard into places in the whole corpus.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    index = scratch.write(write_shards(docs, scratch.uri("shards"), tokenizer_path, end_id, shard_tokens), "index")
    parts = index.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_shard = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("p0", F.coalesce(F.sum("in_part").over(before_part), F.lit(0))).select("part", "p0")
    based = index.withColumn("s0", F.coalesce(F.sum("tokens").over(before_shard), F.lit(0))).join(starts, "part").withColumn("base", F.col("p0") + F.col("s0"))
    return read_shards(based)
