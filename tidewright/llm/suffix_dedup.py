"""Removal of byte strings that occur earlier in the corpus, by external induced sorting of sampled suffixes.

A full suffix array has a tuple for each byte. Here only sampled suffixes are sorted, and what stands between them is
induced, as in induced sorting: in each window of LENGTH bytes the k-gram of least hash is the window's anchor, so
equal windows have equal anchors at equal places.

1. Anchors are dealt by their hash; those that occur once in the corpus take no further part.
2. The suffixes at the repeated anchors, with the bytes to their left that their windows reach, go into runs on disk,
   dealt by hash into queues that are bounded whatever the corpus.
3. A queue sorts its suffix tuples by their bytes and takes the common-prefix lengths of neighbours. A window that
   begins l bytes before its anchor is the tuple (those l bytes, the run of suffixes that share LENGTH - l bytes with
   it): order and common prefixes of the anchors induce equality of all windows, and the least place of each is kept.
4. The other places come back to their documents, where overlapping spans are joined and removed.

Equal contexts of a part are one suffix. An anchor in more places than half a queue is not sorted in one: the windows
of its contexts are dealt by their own hashes, so that no anchor, however frequent, belongs to one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import _BYTE, cut, mix, powers, shared_dir, tidied

LENGTH, GRAM = 100, 32
#: Bytes of a written part, bytes hashed at a time, suffixes of a queue, bytes of text per task.
PART_BYTES, CHUNK, QUEUE, TASK_BYTES = 28_000_000, 1_000_000, 40_000, 32_000_000
_PLACE = 24  # bits of a place in a chunk; the other 40 are the anchor's hash


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all byte strings of one size."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(len(total), inverse=True)[: len(total) - size])


def anchors(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor; texts end at ``stops`` and no window crosses one."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    least = gram_hashes(data, GRAM)
    least = (least >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(least), dtype=np.uint64)
    size, width = 1, LENGTH - GRAM + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    ends = np.zeros(len(data) + 1, np.int32)
    np.add.at(ends, np.maximum(stops - LENGTH + 1, np.concatenate([[0], stops[:-1]])), 1)
    np.add.at(ends, stops, -1)
    whole = np.cumsum(ends[:n]) == 0
    same = np.zeros(n + 1, bool)
    same[1:n] = (least[1:] == least[:-1]) & whole[1:] & whole[:-1]
    first = np.flatnonzero(whole & ~same[:n])
    last = np.flatnonzero(whole & ~same[1:])
    m = least[first]
    return m >> np.uint64(_PLACE), (m & np.uint64((1 << _PLACE) - 1)).astype(np.int64), first, last


def chunks(rows: list[tuple[object, bytes]], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Texts joined up to a size; a longer one in pieces that overlap by a window less a byte: (bytes, stops, keys, first byte of each)."""
    held: list[bytes] = []
    keys: list = []
    bases: list[int] = []
    total = 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), list(keys), np.array(bases, np.int64)

    for key, text in rows:
        for base in range(0, max(1, len(text) - LENGTH + 1), size):
            piece = text[base : base + size + LENGTH - 1] if len(text) > size else text
            if held and total + len(piece) > size:
                yield out()
                held.clear(), keys.clear(), bases.clear()
                total = 0
            held.append(piece), keys.append(key), bases.append(base)
            total += len(piece)
            if len(text) <= size:
                break
    if held:
        yield out()


def repeated_windows(suffixes: list[tuple[tuple, bytes, int, int, int]]) -> np.ndarray:
    """Windows that occur at an earlier place: (index of the suffix, start of the window in its bytes).

    A suffix: (key in the order of places: document first, then the place of its first byte), its bytes from the start
    of the first window to the end of the last, the anchor's place in them, and the first and last window's start.
    """
    n = len(suffixes)
    place = np.array([s[2] for s in suffixes], np.int64)
    first, last = np.array([s[3] for s in suffixes], np.int64), np.array([s[4] for s in suffixes], np.int64)
    sizes = np.array([len(s[1]) for s in suffixes], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(s[1] for s in suffixes), np.uint8)
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    right_size = np.minimum(sizes - place, LENGTH)
    right = padded[(begin + place)[:, None] + np.arange(LENGTH + 4)[None, :].clip(max=LENGTH - 1)]
    right[np.arange(LENGTH + 4)[None, :] >= right_size[:, None]] = 0
    words = right.view(">u8").astype(np.uint64)
    order = np.lexsort(words[:, ::-1].T)
    # common prefixes of neighbours in the order; a shorter suffix ends its own
    differs = right[order[1:], :LENGTH] != right[order[:-1], :LENGTH]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    common = np.concatenate([[0], np.minimum(common, np.minimum(right_size[order[1:]], right_size[order[:-1]]))])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=total[1:])
    inverse = powers(len(total), inverse=True)
    # rank of the (document, place) keys; equal keys are one occurrence
    keys = [s[0] for s in suffixes]
    ranked = {k: r for r, k in enumerate(sorted(set(k[:-1] for k in keys)))}
    doc_rank = np.array([ranked[k[:-1]] for k in keys], np.uint64)
    base = np.array([k[-1] for k in keys], np.int64)
    found = []
    at = np.arange(n)
    for left in range(LENGTH - GRAM + 1):
        need = LENGTH - left
        run = np.maximum.accumulate(np.where(common < need, at, 0))
        start = place - left
        ok = (start >= first) & (start <= last)
        rows = order[ok[order]]
        if len(rows) < 2:
            continue
        own = run[ok[order]]
        a = begin[rows] + start[rows]
        left_hash = (total[begin[rows] + place[rows]] - total[a]) * inverse[a]
        tuple_ = mix(mix(left_hash) + own.astype(np.uint64))
        where = (doc_rank[rows] << np.uint64(36)) | (base[rows] + start[rows]).astype(np.uint64)
        s = np.lexsort((where, tuple_))
        group = np.concatenate([[True], tuple_[s][1:] != tuple_[s][:-1]])
        least = where[s][np.maximum.accumulate(np.where(group, np.arange(len(s)), 0))]
        later = s[where[s] > least]
        if len(later):
            found.append(np.stack([rows[later], start[rows[later]]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def repeated_hashes(hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Rows whose hash also stands at an earlier place."""
    o = np.lexsort((where, hashes))
    head = np.concatenate([[True], hashes[o][1:] != hashes[o][:-1]])
    least = where[o][np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
    return o[where[o] > least]


def join_spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans joined, in order."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(stop[o])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    head = np.flatnonzero(new)
    return np.stack([start[head], reach[np.append(head[1:], len(start)) - 1]], axis=1)


def _dump(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 1)


def _load(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def _pack(key: np.ndarray, make) -> list[tuple[int, bytes]]:
    """What make() has for the rows of each key, as a blob."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [(int(key[rows[0]]), _dump(make(rows))) for rows in np.split(order, cuts) if len(rows)]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


class _Part:
    """The documents of one written part, straight from the shared folder."""

    def __init__(self, folder: str, part: int):
        from tidewright.llm.token_blocks import _filesystem

        self.system, root = _filesystem(folder)
        from pyarrow import fs

        at = f"{root}/part={part}"
        self.files = [f.path for f in self.system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]

    def rows(self) -> Iterator[tuple[tuple[int, int], str]]:
        for path in sorted(self.files):
            with self.system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=["id", "hash", "text"]):
                    ids, hashes, texts = (c.to_pylist() for c in batch.columns)
                    for i, h, t in zip(ids, hashes, texts, strict=True):
                        yield (i, h), t


_NO_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_key: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, key]) of each document.

    Removed is each byte of a LENGTH-byte string that also starts earlier: in a document with a smaller id, or earlier
    in the same one; strings are judged on the input. Null text counts as empty; a null id comes before all others;
    rows that share an id are ordered by a hash of their text, and fully equal rows are one document, told each time.
    kept_text drops the bytes that a cut leaves of a character; key is the xxhash64 of the text as it was (null as empty).
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, -(-total // PART_BYTES))
    # parts are made where the rows are: no shuffle, each input partition cut by a hash of its rows into parts of bounded size
    inputs = max(1, source.rdd.getNumPartitions())
    each = max(1, -(-total // (PART_BYTES * inputs)))
    parts = inputs * each
    folder = shared_dir(spark)
    part = (F.spark_partition_id() * each + F.pmod(F.xxhash64("id", "hash"), F.lit(each))).cast("int").alias("part")
    source.select(part, "*").write.partitionBy("part").option("compression", "zstd").parquet(folder)
    written = spark.read.schema("id bigint, hash bigint, text string, part int").parquet(folder)
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("binary").alias("blob"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["bucket", "blob"], [pa.int32(), pa.binary()]
        held: list[tuple] = []

        def out():
            h, doc, place = (np.concatenate(x) for x in zip(*(x[1:] for x in held), strict=True))
            docs_ = np.concatenate([np.array(x[0], np.int64).reshape(-1, 3) for x in held])
            shift = np.cumsum([0, *(len(x[0]) for x in held)])[:-1]
            doc = doc + np.repeat(shift, [len(x[1]) for x in held])

            def one(rows):
                used, index = np.unique(doc[rows], return_inverse=True)
                return h[rows], docs_[used], index.astype(np.uint32), place[rows].astype(np.uint32)

            return _batch(_pack((h % np.uint64(buckets)).astype(np.int64), one), types, names)

        size = 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for data, stops, keys, bases in chunks([((p, i, g), t.encode("utf-8", "surrogatepass")) for i, g, t, p in rows]):
                h, place, _, _ = anchors(data, stops)
                doc = np.searchsorted(stops, place, side="right")
                held.append((keys, h, doc, place - (stops - np.diff(stops, prepend=0))[doc] + bases[doc]))
                size += len(h)
                if size >= 600_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buckets.setdefault(k, []).append(_load(blob))
        for found in buckets.values():
            h = np.concatenate([x[0] for x in found])
            values, times = np.unique(h, return_counts=True)
            twice, often = values[times > 1], values[times > QUEUE // 2]
            out = []
            for own, docs_, index, place in found:
                at = np.searchsorted(twice, own)
                keep = np.flatnonzero((at < len(twice)) & (twice[at.clip(max=max(0, len(twice) - 1))] == own)) if len(twice) else np.zeros(0, np.int64)
                if len(keep):
                    part_of = docs_[index[keep], 0]
                    hot = np.isin(own[keep], often)
                    out += _pack(part_of, lambda rows, keep=keep, docs_=docs_, index=index, place=place, hot=hot: (docs_[index[keep[rows]], 1:], place[keep[rows]], hot[rows]))
            yield _batch([(k, len(_load(b)[1]), b) for k, b in out], [pa.int32(), pa.int64(), pa.binary()], ["part", "n", "blob"])

    sampled = written.mapInArrow(tidied(sample), "bucket int, blob binary").repartition(min(tasks, buckets), "bucket")
    hints = cut(sampled.mapInArrow(tidied(repeated), "part int, n bigint, blob binary"))
    n_hints = hints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    queues = max(16, -(-n_hints // QUEUE))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["kind", "key", "blob"], [pa.int32(), pa.int32(), pa.binary()]
        by_part: dict[int, list] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_part.setdefault(p, []).extend([_load(blob)] if blob is not None else [])
        for p, found in by_part.items():
            if not found:
                continue
            wanted: dict[tuple[int, int], tuple] = {}
            key = np.concatenate([x[0] for x in found])
            place = np.concatenate([x[1] for x in found]).astype(np.int64)
            often = np.concatenate([x[2] for x in found])
            o = np.lexsort((place, key[:, 1], key[:, 0]))
            key, place, often = key[o], place[o], often[o]
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                wanted[tuple(key[a].tolist())] = place[a:b], often[a:b]
            del found, key, place, often, o
            seen: dict[bytes, tuple] = {}  # the least place of each context of this part; the others are repeats already
            spans: dict[tuple[int, int], list] = {}
            windows: list[tuple] = []  # of frequent anchors: (document, starts, hashes)
            marked: list = []
            docs_ = {}
            for k, t in _Part(folder, p).rows():
                if k in wanted and k not in docs_:
                    docs_[k] = t
            for data, stops, keys, bases in chunks([(k, t.encode("utf-8", "surrogatepass")) for k, t in sorted(docs_.items())]):
                h, at, first, last = anchors(data, stops)
                doc = np.searchsorted(stops, at, side="right")
                base = bases[doc] - (stops - np.diff(stops, prepend=0))[doc]
                hint = np.zeros(len(data), np.int8)
                starts = stops - np.diff(stops, prepend=0)
                for d, k in enumerate(keys):
                    local, hot = wanted[k]
                    local = local - bases[d]
                    inside = (local >= 0) & (local < stops[d] - starts[d])
                    hint[local[inside] + starts[d]] = 1 + hot[inside]
                raw, hashes = data.tobytes(), None
                for i in np.flatnonzero(hint[at]).tolist():
                    a, b = int(first[i]), int(last[i]) + LENGTH
                    context, own = raw[a:b], keys[doc[i]]
                    where = int(base[i])
                    sign = hashlib.blake2b(context, digest_size=12).digest() + bytes([int(at[i]) - a])
                    if sign in seen:
                        if seen[sign][0] != (*own, a + where):
                            spans.setdefault(own, []).append((a + where, b + where))
                    elif hint[at[i]] == 1:
                        seen[sign] = (*own, a + where), context, int(at[i]) - a, int(h[i])
                    else:
                        seen[sign] = ((*own, a + where),)
                        hashes = gram_hashes(data, LENGTH) if hashes is None else hashes
                        windows.append((own, np.arange(a, b - LENGTH + 1) + where, hashes[a : b - LENGTH + 1]))
            if windows:
                holders = list(dict.fromkeys(w[0] for w in windows))
                rank = {k: r for r, k in enumerate(holders)}
                doc = np.repeat(np.array([rank[w[0]] for w in windows], np.uint32), [len(w[1]) for w in windows])
                begin, value = np.concatenate([w[1] for w in windows]), np.concatenate([w[2] for w in windows])
                bucket = (value % np.uint64(queues)).astype(np.int64)

                def dealt(at, holders=holders, doc=doc, begin=begin, value=value, p=p):
                    used, index = np.unique(doc[at], return_inverse=True)
                    return p, [holders[k] for k in used.tolist()], index.astype(np.uint32), begin[at], value[at]

                yield _batch([(2, k, b) for k, b in _pack(bucket, dealt)], types, names)
            rows = [x for x in seen.values() if len(x) > 1]
            if rows:
                queue = np.array([x[3] for x in rows], np.uint64)
                queue = (mix(queue) % np.uint64(queues)).astype(np.int64)
                yield _batch([(0, k, b) for k, b in _pack(queue, lambda at, rows=rows, p=p: (p, [rows[i][:3] for i in at]))], types, names)
            if spans:
                marked = [(k, join_spans(*np.array(v, np.int64).T)) for k, v in spans.items()]
                yield _batch([(1, p, _dump(marked))], types, names)

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: dict[int, list] = {}
        windows: dict[int, list] = {}
        for batch in batches:
            for kind, k, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:  # spans that are known already pass
                    yield _batch([(k, blob)], [pa.int32(), pa.binary()], ["part", "blob"])
                else:
                    (windows if kind else queue).setdefault(k, []).append(blob)
        for blobs in windows.values():
            found = [_load(b) for b in blobs]
            owners = [(p, k) for p, names, *_ in found for k in names]
            shift = np.cumsum([0, *(len(x[1]) for x in found)])[:-1]
            owner = np.concatenate([x[2].astype(np.int64) + n for x, n in zip(found, shift.tolist(), strict=True)])
            begin, value = np.concatenate([x[3] for x in found]), np.concatenate([x[4] for x in found])
            ranked = {k: r for r, k in enumerate(sorted({k for _, k in owners}))}
            rank = np.array([ranked[k] for _, k in owners], np.uint64)[owner]
            later = repeated_hashes(value, (rank << np.uint64(36)) | begin.astype(np.uint64))
            told: dict[int, dict] = {}
            for o in np.unique(owner[later]).tolist():
                own = begin[later[owner[later] == o]]
                told.setdefault(owners[o][0], {})[owners[o][1]] = join_spans(own, own + LENGTH)
            if told:
                yield _batch([(p, _dump(list(m.items()))) for p, m in told.items()], [pa.int32(), pa.binary()], ["part", "blob"])
        for blobs in queue.values():
            suffixes, part_of = [], []
            for blob in blobs:
                p, rows = _load(blob)
                suffixes += [(key, context, place, 0, len(context) - LENGTH) for key, context, place in rows]
                part_of += [p] * len(rows)
            if len(suffixes) < 2:
                continue
            found = repeated_windows(suffixes)
            if not len(found):
                continue
            o = np.lexsort((found[:, 1], found[:, 0]))
            row, start = found[o].T
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LENGTH)])
            head = np.flatnonzero(new)
            end = start[np.append(head[1:], len(start)) - 1] + LENGTH
            by_part: dict[int, dict] = {}
            for r, a, b in zip(row[head].tolist(), start[head].tolist(), end.tolist(), strict=True):
                *own, base = suffixes[r][0]
                by_part.setdefault(part_of[r], {}).setdefault(tuple(own), []).append((a + base, b + base))
            yield _batch([(p, _dump([(k, np.array(v, np.int64)) for k, v in m.items()])) for p, m in by_part.items()], [pa.int32(), pa.binary()], ["part", "blob"])

    hinted = hints.select("part", "blob").union(every).repartition(max(tasks, 1), "part")
    collected = hinted.mapInArrow(tidied(collect), "kind int, key int, blob binary")
    spans = collected.repartition(max(tasks, 1), "kind", "key").mapInArrow(tidied(induce), "part int, blob binary").union(every)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text + ", key bigint" * with_key

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, dict] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = by_part.setdefault(p, {})
                for k, v in _load(blob) if blob is not None else []:
                    own.setdefault(k, []).append(v)
        types = [pa.int64()] * 4 + [pa.string()] * (1 + with_text) + [pa.int64()] * with_key
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text, *["key"] * with_key]
        for p, own in by_part.items():
            out, size = [], 0
            for k, t in _Part(folder, p).rows():
                raw = t.encode("utf-8", "surrogatepass")
                kept, removed, n = raw, 0, 0
                if k in own:
                    joined = join_spans(*np.concatenate(own[k]).T)
                    edges = [0, *joined.reshape(-1).tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    removed, n = len(raw) - len(kept), len(joined)
                out.append((None if k[0] == _NO_ID else k[0], len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * with_text, *[k[1]] * with_key))
                size += len(raw)
                if size > 4_000_000:
                    yield _batch(out, types, names)
                    out, size = [], 0
            if out:
                yield _batch(out, types, names)

    return spans.repartition(max(tasks, 1), "part").mapInArrow(tidied(apply), schema)
