"""Binary token files in patched frame-of-reference blocks.

A file holds documents in ascending id order. Its ids stand in blocks of 256: each block has its minimum subtracted
and is packed at the width of its 90th percentile; what needs more bits keeps its low bits there and its high bits,
with their places, in the block's exception list. An index of block starts lets a reader decode any document without
the blocks before it.

    magic "TWPFOR01" | blocks | index: u64 start of each block | table: i64 id, u8 null, u32 length of each document
    | footer: u64 blocks, u64 documents, u64 ids, u64 place of the index, u64 place of the table | magic
    block: u32 minimum | u8 width | u16 exceptions | packed bits | u8 place each | u32 high bits each
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import cut, ranges_of, tidied
from tidewright.llm.tokens import encoder

MAGIC = b"TWPFOR01"
BLOCK = 256
PERCENTILE = 0.9
#: A worker closes a file at so many ids, so that neither writer nor reader holds more. Bytes of text that a task encodes.
FILE_IDS, TASK_BYTES = 1_500_000, 64_000_000


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of an array of unsigned 32-bit ids, and the start of each."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.uint64)
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    width = _bits(np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))])
    over = (rest >> width[:, None].astype(np.uint32).clip(max=31)) * (width < 32)[:, None]
    exceptions = np.count_nonzero(over, axis=1)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(rest[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - w :]
            lines = np.packbits(bits.reshape(len(rows), BLOCK * w), axis=1)
            for k, line in zip(rows.tolist(), lines, strict=True):
                packed[k] = line.tobytes()
    at, high = np.nonzero(over)
    ends = np.cumsum(exceptions)
    places, values = high.astype(np.uint8), over[at, high].astype("<u4")
    out, starts, size = [], np.zeros(n, np.uint64), 0
    for k in range(n):
        a, b = int(ends[k] - exceptions[k]), int(ends[k])
        block = struct.pack("<IBH", int(low[k]), int(width[k]), b - a) + packed[k] + places[a:b].tobytes() + values[a:b].tobytes()
        starts[k] = size
        size += len(block)
        out.append(block)
    return b"".join(out), starts


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at the given places (whole blocks, padding included)."""
    out = np.zeros((len(starts), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBH", data, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            lines = raw[starts[rows].astype(np.int64)[:, None] + 7 + np.arange(BLOCK * w // 8)]
            bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
            bits[:, :, 32 - w :] = np.unpackbits(lines, axis=1).reshape(len(rows), BLOCK, w)
            out[rows] = np.packbits(bits, axis=2).reshape(len(rows), BLOCK * 4).view(">u4")
    for k, (low, w, n) in enumerate(heads):
        if n:
            at = int(starts[k]) + 7 + BLOCK * w // 8
            places = raw[at : at + n].astype(np.int64)
            out[k, places] |= np.frombuffer(data, "<u4", n, at + n) << np.uint32(w)
        out[k] += np.uint32(low)
    return out.reshape(-1)


def file_bytes(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A token file of documents in the order given."""
    ids = np.concatenate([np.zeros(0, "<u4"), *documents])
    blocks, starts = pack(ids)
    table = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]))
    table["id"] = [x or 0 for x in doc_ids]
    table["null"] = [x is None for x in doc_ids]
    table["n"] = [len(x) for x in documents]
    index_at = len(MAGIC) + len(blocks)
    out = io.BytesIO()
    out.write(MAGIC + blocks + (starts + np.uint64(len(MAGIC))).astype("<u8").tobytes() + table.tobytes())
    out.write(struct.pack("<5Q", len(starts), len(doc_ids), len(ids), index_at, index_at + 8 * len(starts)) + MAGIC)
    return out.getvalue()


class TokenFile:
    """Reads a token file: the document table at once, ids by document or all together."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        n_blocks, n_docs, self.n_ids, index_at, table_at = struct.unpack("<5Q", data[-48:-8])
        self.data = data
        self.starts = np.frombuffer(data, "<u8", n_blocks, index_at)
        table = np.frombuffer(data, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]), n_docs, table_at)
        self.doc_ids = [None if z else int(x) for x, z in zip(table["id"], table["null"], strict=True)]
        self.ends = np.cumsum(table["n"], dtype=np.int64)
        self.lengths = table["n"].astype(np.int64)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only the blocks that hold it are decoded."""
        a, b = int(self.ends[k] - self.lengths[k]), int(self.ends[k])
        first = a // BLOCK
        return unpack(self.data, self.starts[first : -(-b // BLOCK)])[a - first * BLOCK : b - first * BLOCK] if b > a else np.zeros(0, np.uint32)

    def documents(self, group: int = 2048) -> Iterator[np.ndarray]:
        """Ids of each document in turn, decoding a group of blocks at a time."""
        held, base = np.zeros(0, np.uint32), 0
        done = 0
        for a, b in zip((self.ends - self.lengths).tolist(), self.ends.tolist(), strict=True):
            while base + len(held) < b:
                held, base = np.concatenate([held[a - base :], unpack(self.data, self.starts[done : done + group])]), a
                done += group
            yield held[a - base : b - base]


def _filesystem(path: str):
    """(file system, path) of a folder that all executors share, by its URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes whole texts and writes them as token files in ascending id order; returns the manifest, one row a file.

    Null texts count as empty; every document ends with end_id. A null id comes first; rows with the same id are
    ordered by a hash of their text, so that one id's rows can fill many tasks. A string of one of the tokenizer's added
    tokens becomes its id. A task may run again: it writes under a name of its own and then renames, so files are
    whole. An empty table gives no files. Manifest: part, seq (the order of files), path, n_docs, n_ids.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    sorted_docs = source.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part = encoder(tokenizer, kind), TaskContext.get().partitionId()
        system, root = _filesystem(folder)
        end = np.array([end_id], "<u4")
        ids: list = []
        held: list[np.ndarray] = []
        rows: list[tuple] = []

        def close():
            if ids:
                path = f"{root}/part-{part:06d}-{len(rows):06d}.pfor"
                system.create_dir(root, recursive=True)
                with system.open_output_stream(own := f"{root}/_{uuid.uuid4().hex}") as f:
                    f.write(file_bytes(ids, held))
                system.move(own, path)
                rows.append((part, len(rows), f"{folder}/{os.path.basename(path)}", len(ids), sum(map(len, held))))
                ids.clear()
                held.clear()

        total = 0
        for batch in batches:
            for a, b in ranges_of(batch.column(1), 1_000_000):
                for i, t in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    ids.append(i)
                    held.append(np.concatenate([e.ids(t), end]))
                    total += len(held[-1])
                    if total >= FILE_IDS:
                        close()
                        total = 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "path", "n_docs", "n_ids"])

    # one short row a file: an eighth of the tasks write them
    return cut(sorted_docs.mapInArrow(tidied(run), "part int, seq int, path string, n_docs bigint, n_ids bigint").repartition(max(1, n // 8)))


def read_token_files(spark: SparkSession, manifest: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files of a manifest.

    start counts the ids of all documents before it: those of earlier files come from the manifest's counts, summed by
    part.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // 16))
    # parts are as many as the writing tasks: their sums are put in order by themselves, and files within their part
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("part")) - F.col("s")).select("part", "before")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = manifest.withColumn("inside", inside).join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("inside")).alias("start")).repartition(n)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _filesystem(path)
                with system.open_input_file(at) as f:
                    found = TokenFile(f.read())
                begins = start + found.ends - found.lengths
                crc, lists = [], []
                for x in found.documents():
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                    if ids:
                        lists.append(x.astype(np.int64))
                arrays = [pa.array(found.doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(found.lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(lists, pa.list_(pa.int64()))] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return starts.mapInArrow(tidied(run), schema)
