"""Line deduplication by pairwise alignment.

Documents that overlap are found through shared hashes of their lines: the shortest runs of consecutive lines that
reach BLOCK_CHARS characters, a line that is long enough being a run by itself. A single short line is in too many
documents to say anything; a run is rare. Each shared run leads its holders to the earliest of them, so one with many
holders makes as many pairs as holders and never pairs of all with all.

Each pair is aligned by patience diff: lines that occur once in both documents, in the longest run that keeps both
orders, are the fixed points; between them the same is done again, and equal lines beside them join in. Runs that stand
in another order in the two documents, which no alignment holds at once, are then aligned by themselves. Aligned blocks
of BLOCK_CHARS characters or more are deleted from the later document. Since a block holds a run at each of its lines,
and every run was tried with its earliest holder, no block that an earlier document holds is missed.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, hold, prefix_hash, ranges_of, release, span_hash, tidied

#: Characters of an aligned block that is deleted, and of a run that leads to another document.
BLOCK_CHARS = 60
_NO_ID = -(1 << 63)


def line_hashes(texts: list[str], run_chars: int = BLOCK_CHARS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the hashes of its lines, their characters, and the hashes of its shortest runs of ``run_chars`` characters.

    Of runs there are the shortest that begins and the shortest that ends with each line, so that those within a block
    cover it. A run's hash is that of its bytes, line ends included; one line's is the hash of the line.
    """
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    prefix = prefix_hash(data)
    h = span_hash(prefix, start, stop).view(np.int64)
    seen = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = seen[stop] - seen[start]
    edges = np.searchsorted(stop, np.cumsum([len(x) for x in raw]))
    out = []
    for a, b in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True):
        upto = np.cumsum(size[a:b])
        before = upto - size[a:b]
        last = np.searchsorted(upto, before + run_chars)
        first = np.searchsorted(before, upto - run_chars, side="right") - 1
        i = np.concatenate([np.flatnonzero(last < b - a), first[first >= 0]])
        j = np.concatenate([last[last < b - a], np.flatnonzero(first >= 0)])
        runs = np.unique(span_hash(prefix, start[a + i], stop[a + j]).view(np.int64))
        out.append((h[a:b], size[a:b], runs))
    return out


def _fixed_points(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, in the longest chain that rises in both."""
    n, m = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {x: j for j, x in enumerate(b[b0:b1], b0) if m[x] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if n[x] == 1 and x in place]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        t = bisect.bisect_left(tails, j)
        if t == len(tails):
            tails.append(j), ends.append(k)
        else:
            tails[t], ends[t] = j, k
        back.append(ends[t - 1] if t else -1)
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines (place in a, place in b), rising in both."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        fixed = _fixed_points(a, b, a0, a1, b0, b1)
        if not fixed:
            continue
        # each range begins at a fixed point, so that it shrinks by it at least
        edges = [(a0, b0), *fixed, (a1, b1)]
        work += [(p, q, r, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if p < q and r < s]
    return sorted(out)


def _runs(lines: list[int], sizes: list[int], least: int) -> list[tuple[int, int]]:
    """First and last line of the shortest runs of ``least`` characters that begin, and that end, with each line."""
    out, total, first, last = [], 0, 0, -1
    for first in range(len(lines)):
        while total < least and last + 1 < len(lines):
            last += 1
            total += sizes[last]
        if total < least:
            break
        out.append((first, last))
        total -= sizes[first]
    total, first = 0, 0
    for last in range(len(lines)):
        total += sizes[last]
        while total - sizes[first] >= least and first < last:
            total -= sizes[first]
            first += 1
        if total >= least:
            out.append((first, last))
    return out


def common_blocks(later: list[int], earlier: list[int], sizes: list[int], earlier_sizes: list[int], least: int = BLOCK_CHARS) -> list[int]:
    """Lines of the later document in blocks (consecutive in both) of ``least`` characters at least."""
    out: set[int] = set()
    run: list[int] = []
    before = None
    for i, j in [*patience(later, earlier), (None, None)]:
        if before is not None and (i is None or (i, j) != (before[0] + 1, before[1] + 1)):
            if sum(sizes[k] for k in run) >= least:
                out.update(run)
            run = []
        if i is not None:
            run.append(i)
        before = (i, j)
    if len(out) < len(later):
        held = None
        for a, b in _runs(later, sizes, least):
            if not all(k in out for k in range(a, b + 1)):
                held = {tuple(earlier[p : q + 1]) for p, q in _runs(earlier, earlier_sizes, least)} if held is None else held
                if tuple(later[a : b + 1]) in held:
                    out.update(range(a, b + 1))
    return sorted(out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, with_key: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each document without the line blocks that align with an earlier one.

    A block is a run of consecutive lines with ``block_chars`` characters or more, line ends not counted, that also
    stands in an earlier document. Earlier means a smaller id, a null id before all; among rows with the same id, a
    smaller hash of the text. Fully equal rows are one document, told each time. Null text gives null text and no
    lines; a text is judged on the input, not on what other deletions leave. Empty tables give no rows; columns other
    than the two named are not read. with_key adds key, the xxhash64 of the text as it was: with the id it tells rows
    apart.
    """
    source = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NO_ID)).alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges_of(batch.column(2), 500_000):
                found = line_hashes(batch.column(2).slice(a, b - a).to_pylist(), block_chars)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.list_(pa.int64()))], ["id", "key", "hashes", "sizes", "leads"])

    split_lines = hold(source.where("text IS NOT NULL").mapInArrow(tidied(split), "id bigint, key bigint, hashes array<bigint>, sizes array<int>, leads array<bigint>"))
    lines = split_lines.select("id", "key", "hashes", "sizes")
    held = split_lines.select("id", "key", F.explode("leads").alias("h"))
    # written, so that a join deals it anew and can split a line with many holders
    first = cut(held.groupBy("h").agg(F.min(F.struct("id", "key")).alias("p"), F.max(F.struct("id", "key")).alias("q")).where("p < q").select("h", F.col("p.id").alias("p_id"), F.col("p.key").alias("p_key")), small=True)
    pairs = held.join(first, "h").where("id <> p_id OR key <> p_key").select("id", "key", "p_id", "p_key").distinct()
    # fully equal rows come with the same lines, and give the same deletions
    later = pairs.join(lines, ["id", "key"])
    both = later.join(lines.select(F.col("id").alias("p_id"), F.col("key").alias("p_key"), F.col("hashes").alias("p_hashes"), F.col("sizes").alias("p_sizes")), ["p_id", "p_key"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((x, k) for x in batches for k in range(0, x.num_rows, 500)):
            batch = whole.slice(at, 500)
            found = [common_blocks(a, b, s, t, block_chars) for a, s, b, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            keep = [k for k, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array([found[k] for k in keep], pa.list_(pa.int32()))], ["id", "key", "gone"])

    aligned = both.select("id", "key", "hashes", "sizes", "p_hashes", "p_sizes").mapInArrow(tidied(align), "id bigint, key bigint, gone array<int>")
    gone = cut(aligned.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), small=True)
    release(split_lines)
    # always by merging: whatever the size, texts stay where they are dealt to
    told = source.join(gone.hint("merge"), ["id", "key"], "left").select("id", "text", "gone", "key")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges_of(batch.column(1), 1_000_000):
                texts, n, m = [], [], []
                for text, out in zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                    rows = text.split("\n") if text is not None else []
                    dropped = set(out or ())
                    n.append(len(rows))
                    m.append(len(dropped))
                    texts.append(text if not dropped else "\n".join(x for k, x in enumerate(rows) if k not in dropped))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(texts, pa.string()), batch.column(3).slice(a, b - a)], ["id", "n_lines", "n_removed", "text", "key"])

    return told.mapInArrow(tidied(rebuild), "id bigint, n_lines bigint, n_removed bigint, text string, key bigint").select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_lines", "n_removed", "text", *["key"] * with_key)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
