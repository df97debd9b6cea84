"""Sentencepiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers and what follows up to the next marker. Where no piece of the model has a
marker after another character, no merge crosses the end of a chunk, so every distinct chunk of the corpus is segmented
once and its ids are joined back by position:

1. each slice of an input partition gives the set of its chunks, dealt by a hash of the chunk;
2. a bucket's chunks, distinct over all slices, are segmented, and each slice gets the ids of its own;
3. the table of a partition's slices is written as one file, which the second reading of the partition looks up.

What is dealt are sets of chunks, never their occurrences. Chunks of over CHUNK_CHARS characters and those of spaces
alone, few and of little repetition, are segmented where they stand; so is any that the table lacks, should a second reading cut its partitions
otherwise. The model is checked for that property, for its identity normaliser and for its dummy prefix; any other
model, and any text with a literal marker, goes to the library whole.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, map_texts, ranges_of, shared_dir, tidied

_CHUNKS = re.compile(" +[^ ]*").findall
_MARK = "▁"
#: Characters of a chunk in the table, bytes of text whose table a worker holds, and of text per bucket of chunks.
CHUNK_CHARS, SLICE_BYTES, BUCKET_BYTES = 48, 16_000_000, 64_000_000


class PieceCodec:
    """Whole texts to ids and back, exactly as the library does, for a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        self.splits = rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix and model.trainer_spec.model_type == 2 and all(_MARK not in p.piece.lstrip(_MARK) for p in model.pieces) and all(p.type != 4 for p in model.pieces)
        self.alone = self.library.piece_to_id(_MARK)
        self.names = [str(k) for k in range(len(model.pieces))]

    def chunks(self, text: str | None) -> list[str] | None:
        """The chunks of a text; None for one that goes to the library whole."""
        return _CHUNKS(" " + text) if text and self.splits and _MARK not in text else None

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, as unsigned 32-bit integers."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
        return [np.array(ids if c != " " else [self.alone], "<u4").tobytes() for c, ids in zip(chunks, found, strict=True)]

    def encode(self, texts: list[str | None], table: dict[str, bytes]) -> list[list[int]]:
        """The ids of each text; what the table lacks is segmented here, once for all texts given."""
        parts = [self.chunks(t) for t in texts]
        got = [None if c is None else list(map(table.get, c)) for c in parts]
        lacking = list({c for own, chunks in zip(got, parts, strict=True) if own and None in own for x, c in zip(own, chunks, strict=True) if x is None})
        more = dict(zip(lacking, self.segment(lacking), strict=True))
        out = []
        for text, chunks, own in zip(texts, parts, got, strict=True):
            if chunks is None:
                out.append(self.library.encode(text, num_threads=1) if text else [])
            else:
                if None in own:
                    own = [more[c] if x is None else x for x, c in zip(own, chunks, strict=True)]
                out.append(np.frombuffer(b"".join(own), "<u4").tolist())
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _dump(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 3)


def _load(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def short(ids: np.ndarray) -> bool:
    return int(ids.max(initial=0)) < 1 << 16


class _Slices:
    """Numbers the texts of a partition by the bytes before them, the same in every reading."""

    def __init__(self):
        self.total = 0

    def next(self, sizes: list[int]) -> list[int]:
        out = []
        for n in sizes:
            out.append(self.total // SLICE_BYTES)
            self.total += n
        return out


def _sizes(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def chunk_table(docs: DataFrame, model: str, text_col: str = "text") -> str:
    """Segments every distinct chunk of a corpus once; returns the folder of the tables, a file for each input partition."""
    spark = docs.sparkSession
    texts = docs.select(docs[text_col].alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    folder = shared_dir(spark)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, c, slices, held, at = TaskContext.get().partitionId(), codec(model), _Slices(), set(), 0

        def out() -> pa.RecordBatch:
            dealt: dict[int, list[str]] = {}
            for x in held:
                dealt.setdefault(zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets, []).append(x)
            held.clear()
            n = len(dealt)
            return pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array([_dump("".join(sorted(x))) for x in dealt.values()], pa.binary())], ["bucket", "part", "slice", "blob"])

        for batch in batches:
            column = batch.column(0)
            numbers = slices.next(_sizes(column))
            for a, b in ranges_of(column, 1_000_000):
                for k, text in zip(numbers[a:b], column.slice(a, b - a).to_pylist(), strict=True):
                    if k != at:
                        yield out()
                        at = k
                    held.update(x for x in set(c.chunks(text) or ()) if len(x) <= CHUNK_CHARS and x[-1] != " ")
        yield out()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        buckets_: dict[int, list[tuple[int, int, bytes]]] = {}
        for batch in batches:
            for bucket, part, k, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                buckets_.setdefault(bucket, []).append((part, k, blob))
        for rows in buckets_.values():
            ids: dict[str, bytes] = {}
            for part, k, blob in rows:
                joined = _load(blob)  # chunks that hold more than spaces come apart again as they were
                chunks = _CHUNKS(joined)
                new = [x for x in chunks if x not in ids]
                ids.update(zip(new, c.segment(new), strict=True))
                own = [ids[x] for x in chunks]
                flat = np.frombuffer(b"".join(own), "<u4")
                made = _dump((joined, np.array([len(x) // 4 for x in own], np.uint8), flat.astype("<u2") if short(flat) else flat))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([made], pa.binary())], ["part", "slice", "blob"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewright.llm.token_blocks import _filesystem

        parts: dict[int, dict[int, list[bytes]]] = {}
        for batch in batches:
            for part, k, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                parts.setdefault(part, {}).setdefault(k, []).append(blob)
        system, root = _filesystem(folder)
        for part, slices in parts.items():
            system.create_dir(root, recursive=True)
            with system.open_output_stream(own := f"{root}/_{uuid.uuid4().hex}") as f:
                f.write(pickle.dumps(slices, protocol=5))
            system.move(own, f"{root}/{part}.chunks")
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32())], ["part"])

    dealt = texts.mapInArrow(tidied(gather), "bucket int, part int, slice int, blob binary").repartition(buckets, "bucket")
    made = dealt.mapInArrow(tidied(segment), "part int, slice int, blob binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BUCKET_BYTES)))
    cut(made.repartition(tasks, "part").mapInArrow(tidied(write), "part int"))
    return folder


class _Tables:
    """The tables of this task's partition, one slice in memory at a time."""

    def __init__(self, folder: str):
        from pyspark import TaskContext

        from tidewright.llm.token_blocks import _filesystem

        system, root = _filesystem(folder)
        path = f"{root}/{TaskContext.get().partitionId()}.chunks"
        from pyarrow import fs

        self.blobs: dict[int, list[bytes]] = {}
        if system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_file(path) as f:
                self.blobs = pickle.loads(f.read())
        self.at, self.table = -1, {}

    def slice(self, k: int) -> dict[str, bytes]:
        if k != self.at:
            self.at, self.table = k, {}
            for blob in self.blobs.pop(k, ()):
                joined, sizes, flat = _load(blob)
                ids, ends = flat.astype("<u4").tobytes(), 4 * np.cumsum(sizes, dtype=np.int64)
                self.table.update((c, ids[a:b]) for c, a, b in zip(_CHUNKS(joined), [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        return self.table


def _by_table(docs: DataFrame, keep: list[str], text_col: str, model: str, derive: Callable[[PieceCodec, list[list[int]]], dict], schema: str) -> DataFrame:
    """Columns derived from the ids of each text, looked up slice by slice."""
    folder = chunk_table(docs, model, text_col)

    def make():
        c, tables, slices = codec(model), _Tables(folder), _Slices()

        def run(texts: list[str | None]) -> dict:
            numbers = slices.next([len((t or "").encode("utf-8", "surrogatepass")) for t in texts])
            ids: list[list[int]] = []
            a = 0
            for b in range(1, len(texts) + 1):
                if b == len(texts) or numbers[b] != numbers[a]:
                    ids += c.encode(texts[a:b], tables.slice(numbers[a]))
                    a = b
            return derive(c, ids)

        return run

    return map_texts(docs, keep, text_col, make, schema, limit=1_000_000)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text; null and empty texts give no ids and an empty string.

    Rows keep their count and repeated rows their repetition; an empty table gives no rows; columns other than the two
    named are not read.
    """
    return _by_table(docs, [id_col], text_col, model, lambda c, ids: {"ids": ids, "decoded": c.decode(ids)}, "ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, from the same table; null and empty texts: no ids."""

    def derive(c: PieceCodec, ids: list[list[int]]) -> dict:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        decimal = c.names.__getitem__
        return {"n_tokens": [len(x) for x in ids], "ids_sha256": [sha(",".join(map(decimal, x))) for x in ids], "decoded_sha256": [sha(x) for x in c.decode(ids)]}

    return _by_table(docs, [id_col], text_col, model, derive, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
