"""What the corpus operators share: shared folders, batch-wise maps over documents, hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewright.session import shared_dir

__all__ = ["cut", "hold", "map_texts", "mix", "powers", "prefix_hash", "ranges_of", "release", "shared_dir", "span_hash", "tidied", "window_hashes", "word_hashes"]

#: Characters that a worker turns into Python or numpy objects at a time; one longer text still goes whole.
SLICE_CHARS = 4_000_000


def cut(df: DataFrame, small: bool = False, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it again: later reads neither recompute it nor lose it with an executor.

    small: a table of short rows after a shuffle, which goes into an eighth of the files.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keeps a table's rows on the executors' disks for the reads that follow; rows of a lost executor are made again.

    For tables of as many partitions as the input, read several times; release() them once what needs them is written.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def release(*tables: DataFrame) -> None:
    for t in tables:
        t.unpersist()


def tidied(function: Callable) -> Callable:
    """A function of Arrow batches whose task gives its freed memory back to the system; workers outlive their tasks."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def map_texts(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], dict]], schema: str, limit: int = SLICE_CHARS) -> DataFrame:
    """Rows of ``keep`` beside the columns that a function derives from whole texts.

    ``make()`` is called once for each task and returns the function: from a list of texts (None: null)
    to a dict of equally long columns. Columns other than those named don't reach the workers; one to keep that has the
    name of a derived one gives way to it.
    """
    made_fields = StructType.fromDDL(schema).fields
    derived = {f.name.lower() for f in made_fields}
    keep = [c for c in keep if c.lower() not in derived]
    out_schema = StructType([*df.select(*[df[c] for c in keep]).schema.fields, *made_fields])
    types = {f.name: f.type for f in to_arrow_schema(out_schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in ranges_of(texts, limit):
                made = function(texts.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(v, types[k]) for k, v in made.items())], [*keep, *made])

    last = "_" * (1 + max(map(len, keep), default=0))  # a name that no kept column has
    return df.select(*[df[c] for c in keep], df[text].alias(last)).mapInArrow(tidied(run), out_schema)


def ranges_of(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of at most so many bytes together, one text at least."""
    n = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    out, start, total = [], 0, 0
    for k, x in enumerate(n.tolist()):
        if k > start and total + x > limit:
            out.append((start, k))
            start, total = k, 0
        total += x
    return [*out, (start, len(n))] if len(n) > start else out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


#: Powers that a worker keeps; those that a longer text needs are made for it alone.
_KEPT_POWERS = 1 << 22


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of an odd base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= _KEPT_POWERS:
            _POWERS[key] = have
    return have[:n]


#: Random 64-bit values of the 256 bytes, so that the polynomial has no structure left from the text.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = sum of byte values times powers before i; (H[b]-H[a]) * base**-a identifies bytes a..b."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from prefix_hash()."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix), inverse=True)[start] + (stop - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes hashed at a time; a part ends at white space, so that only a longer word makes it longer.
_PART = 2_000_000


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a few texts: (hash, index of the text, start byte, end byte); bytes count from the joined texts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    start, stop = edge[::2], edge[1::2]
    found, a = [np.zeros(0, np.uint64)], 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(stop, start[a] + _PART, side="right")))
        at = start[a]
        found.append(span_hash(prefix_hash(data[at : stop[b - 1]]), start[a:b] - at, stop[a:b] - at))
        a = b
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")
    return np.concatenate(found), doc, start, stop


def window_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of k words of one text, and the position of its first word."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_BASE) + words[at + i])
    return h, at
