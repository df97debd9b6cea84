"""Lexical retrieval packing: documents that share rare terms fill a training window together.

Documents become token ids, once, in a written table. Their terms are the distinct ids; how many documents hold a
term is counted over the whole corpus (a vector as long as the vocabulary). Documents are then dealt into shards in
the order of min-hashes of their token trigrams, so that similar ones meet, by ranges that split any hot value. Each
shard has an inverted index with BM25 weights. A seed document opens a window of 4096 ids; its unused neighbours in
the index follow in the order of their scores, and the one that no longer fits is cut: its rest opens the next window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, mix, ranges_of, tidied
from tidewright.llm.tokens import encoder

WINDOW = 4096
#: Ids of a shard, that is of one index held in memory, and of the documents that a range is meant to hold.
SHARD_IDS, RANGE_IDS = 2_000_000, 4_000_000
#: BM25's parameters.
K1, B = 1.2, 0.75
_NONE = np.iinfo(np.int64).max


def _min_hashes(ids: np.ndarray) -> tuple[int, int]:
    """Two min-hashes of a document's token trigrams."""
    x = ids.astype(np.uint64)
    if len(x) < 3:
        x = np.concatenate([x, np.zeros(3 - len(x), np.uint64)])
    h = mix((x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:])
    return int(h.min() >> np.uint64(1)), int((h * np.uint64(0x5851F42D4C957F2D)).min() >> np.uint64(1))


def encode_documents(docs: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, h1, h2, ids: unsigned 32-bit little-endian bytes) of each document, written to the shared folder."""
    wanted = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(tokenizer, kind), np.array([end_id], "<u4")
        for batch in batches:
            for a, b in ranges_of(batch.column(1), 2_000_000):
                ids = [np.concatenate([e.ids(t), end]) for t in batch.column(1).slice(a, b - a).to_pylist()]
                hashes = [_min_hashes(x) for x in ids]
                arrays = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), pa.array([x.astype("<u2").tobytes() if short(x) else x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "h1", "h2", "ids"])

    return cut(wanted.mapInArrow(tidied(run), "doc_id bigint, n bigint, h1 bigint, h2 bigint, ids binary"), compression="lz4")


def short(ids: np.ndarray) -> bool:
    return int(ids.max(initial=0)) < 1 << 16


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype(np.uint32)


def term_counts(encoded: DataFrame) -> np.ndarray:
    """How many documents hold each id: as long as the vocabulary, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.uint32), *(np.unique(_ids(b, n)) for b, n in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))])
            more = np.bincount(found)
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "n"])

    rows = encoded.select("n", "ids").mapInArrow(tidied(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out


class Index:
    """BM25 over one shard's documents, with document counts of the whole corpus."""

    def __init__(self, documents: list[np.ndarray], counts: np.ndarray, n_docs: int, mean_length: float):
        self.n = len(documents)
        found = [np.unique(d, return_counts=True) for d in documents]
        sizes = np.array([len(t) for t, _ in found])
        terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        tf = np.concatenate([c for _, c in found]).astype(np.float64)
        doc = np.repeat(np.arange(self.n), sizes)
        lengths = np.array([len(d) for d in documents], np.float64)
        idf = np.log(1 + (n_docs - counts[terms] + 0.5) / (counts[terms] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
        order = np.argsort(terms, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        names, self.begin = np.unique(terms[order], return_index=True)
        self.end = np.append(self.begin[1:], len(terms))
        place = np.searchsorted(names, terms)
        # a document's own query: all its terms that some other document of the shard holds
        shared = (self.end - self.begin)[place] > 1
        self.terms = place[shared]
        self.edges = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(sizes)])]

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` unused documents that share a term with the seed, best first, ties to the earlier one."""
        terms = self.terms[self.edges[seed] : self.edges[seed + 1]]
        spans = [slice(a, b) for a, b in zip(self.begin[terms].tolist(), self.end[terms].tolist(), strict=True)]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[used] = 0
        if most < self.n:
            top = np.argpartition(-score, most)[:most]
            top = top[np.lexsort((top, -score[top]))]
        else:
            top = np.argsort(-score, kind="stable")
        return top[score[top] > 0]


class Packer:
    """Fills windows; a window is a list of (document, start, length)."""

    def __init__(self):
        self.open: list[tuple[object, int, int]] = []
        self.free = WINDOW
        self.done: list[list[tuple[object, int, int]]] = []

    def put(self, document: object, n: int) -> None:
        start = 0
        while n > start:
            length = min(self.free, n - start)
            self.open.append((document, start, length))
            start += length
            self.free -= length
            if not self.free:
                self.done.append(self.open)
                self.open, self.free = [], WINDOW

    def finish(self) -> None:
        """Closes the last window without padding: in sequences whose lengths are powers of two."""
        left, self.open = self.open, []
        size = WINDOW - self.free
        self.free = WINDOW
        while size:
            room, row = 1 << (size.bit_length() - 1), []
            size -= room
            while room:
                document, start, length = left.pop(0)
                take = min(room, length)
                row.append((document, start, take))
                room -= take
                if take < length:
                    left.insert(0, (document, start + take, length - take))
            self.done.append(row)


def pack_shard(lengths: list[int], index: Index, packer: Packer, name=lambda k: k) -> None:
    """Puts every document of a shard, each after the one that found it."""
    n = len(lengths)
    used = np.zeros(n, bool)
    nxt, seed = 0, None
    while True:
        if seed is None:
            while nxt < n and used[nxt]:
                nxt += 1
            if nxt == n:
                return
            seed = nxt
            used[seed] = True
            packer.put(name(seed), lengths[seed])
        seed_now, seed = seed, None
        if packer.free == WINDOW:
            continue
        most, at, windows = 32, 0, len(packer.done)
        while len(packer.done) == windows:
            found = index.neighbours(seed_now, used, min(most, n))
            if not len(found):
                break
            for d in found.tolist():
                used[d] = True
                packer.put(name(d), lengths[d])
                if len(packer.done) > windows:
                    seed = d if packer.free < WINDOW else None  # its rest opens the next window
                    break


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most WINDOW ids.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of the piece's ids as unsigned
    32-bit little-endian), doc_tokens (with the end id), sequence_id, offset (in the sequence) and, if asked for, ids.
    A null or empty text is its end id alone. Repeated rows are packed each; an empty table gives no rows. A string of
    one of the tokenizer's added tokens becomes its id, as the library has it. Neighbours are scored by all terms. All
    sequences are full but the last of a range, whose ids go into sequences of powers of two.
    """
    spark = docs.sparkSession
    encoded = encode_documents(docs, tokenizer, kind, end_id, id_col, text_col)
    n_docs, total = encoded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    corpus = spark.sparkContext.broadcast((term_counts(encoded), n_docs, total / max(1, n_docs)))
    ranges = max(1, -(-total // RANGE_IDS))
    # the id and at last a number of each row break ties between equal min-hashes, so that no value can hold a range by itself
    dealt = encoded.withColumns({"h3": F.xxhash64("doc_id"), "h4": F.monotonically_increasing_id()}).repartitionByRange(ranges, "h1", "h2", "h3", "h4").sortWithinPartitions("h1", "h2", "h3", "doc_id", "ids").select("doc_id", "n", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, n, mean = corpus.value
        packer, sequence = Packer(), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for window in packer.done:
                offset = 0
                for (doc_id, x), start, length in window:
                    part = x[start : start + length].astype("<u4")
                    out.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(x), sequence, offset, *[part.tolist()] * ids))
                    offset += length
                sequence += 1
            packer.done = []
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * ids
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        def flush():
            documents = [x for _, x in held]
            pack_shard([len(x) for x in documents], Index(documents, counts, n, mean), packer, held.__getitem__)

        size = 0
        for batch in batches:
            for doc_id, m, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((doc_id, _ids(blob, m)))
                size += m
                if size >= SHARD_IDS:
                    flush()
                    yield rows()
                    held, size = [], 0
        if held:
            flush()
        packer.finish()
        yield rows()

    return dealt.mapInArrow(tidied(run), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * ids)
