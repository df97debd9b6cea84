"""Exact Jaccard join of documents over word n-grams, as a metric-space join, and its connected groups.

The Jaccard distance is a metric. At distance 1, where most documents are from most others, pivots tell nothing, so
regions are found through shingles: two sets within radius r of each other share several of their first shingles (a
little over r*n of them) in any common order (frequent ones last). A document that shares fewer with all others is
alone. Among the documents that hold a shingle there, the one of least hash is the pivot: the documents it meets this
way form its region, a document on the boundary of several regions is replicated into each, and every possible pair
lies together in at least one. In a region:

* a document within r of the pivot is linked to it, and so needs no comparison with the others that are;
* of the rest, two documents are compared only if their distances to every pivot so far differ by r at most (the
  triangle inequality's window) and no chain of links joins them yet;
* the least of those becomes the next pivot, and so on until no pair is open.

Regions of up to BLOCK documents are resolved in one task. A larger one is cut into rings by the distance to its pivot,
each as wide as the radius: by the triangle inequality a document of one ring is replicated into the rings beside it
and no others. Rings are dealt into blocks. Each round sends pivots to the blocks of their rings, then links are joined
into components, and what is not in its region's main component yet is open; every round has four times the pivots of
the one before, until no document is open. Sets are compared exactly (shingles by 64-bit hashes).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import cut, hold, map_texts, mix, ranges_of, release, tidied, window_hashes, word_hashes

#: Sets of one task's region, and pivots of a large region's first round.
BLOCK, PIVOTS = 96, 32
#: Counters of the fixed-size count of shingles, and the slices it is summed in.
COUNTERS, SLICES = 1 << 22, 64
#: Bits of the fixed-size bitmap that says which documents' sets may be wanted.
MEMBERS = 1 << 26


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: k consecutive lower-cased words, or all if there are fewer."""
    words, doc, _, _ = word_hashes(texts, lower=True)
    h, at = window_hashes(words, doc, k)
    n_words = np.bincount(doc, minlength=len(texts))
    ends = np.searchsorted(doc[at], np.arange(len(texts) + 1)) if len(at) else np.zeros(len(texts) + 1, np.int64)
    begin = np.concatenate([[0], np.cumsum(n_words)])
    out = []
    for i in range(len(texts)):
        if 0 < n_words[i] < k:
            out.append(window_hashes(words[begin[i] : begin[i + 1]], np.zeros(n_words[i], np.int64), int(n_words[i]))[0])
        else:
            out.append(np.unique(h[ends[i] : ends[i + 1]]))
    return out


def set_key(x: np.ndarray) -> int:
    """A 64-bit key of a set of shingles; equal sets, and up to collisions only they, have equal keys."""
    with np.errstate(over="ignore"):
        total = (mix(x).sum(dtype=np.uint64), mix(x ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64), np.uint64(len(x)))
        h = mix(np.array([total[0]], np.uint64))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + total[1])
        return int(mix(h + total[2]).view(np.int64)[0])


def least_overlap(n: int, similarity: int) -> int:
    """Shingles that a set of n shares at least with any set it is linked to; also the least size of such a set."""
    return (similarity * n + 99) // 100


def spare(n: int) -> int:
    """By how much a prefix is longer than it must be; so many of its shingles are then shared with any linked set."""
    return 1 + n // 20


def prefix(x: np.ndarray, similarity: int, frequent: np.ndarray) -> np.ndarray:
    """The first n - least_overlap + spare shingles: infrequent ones before frequent ones, by hash among each."""
    n = len(x)
    if not n:
        return x
    at = x & np.uint64(COUNTERS - 1)
    late = (frequent[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return x[np.argsort(late, kind="stable")][: n - least_overlap(n, similarity) + spare(n)]


def _batch(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _count_shingles(source: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds from one pass: (doc_id, n, node) of each document, and slices of each task's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint16)
        part = COUNTERS // SLICES
        for batch in batches:
            for a, b in ranges_of(batch.column(1), 400_000):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), words)
                for x in sets:
                    at = (x & np.uint64(COUNTERS - 1)).astype(np.int64)
                    counts[at] += counts[at] < 65535  # a set holds a shingle once
                m = b - a
                yield _batch({"doc_id": batch.column(0).slice(a, m), "n": pa.array([len(x) for x in sets], pa.int64()), "node": pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()), "slice": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
        used = [k for k in range(SLICES) if counts[k * part : (k + 1) * part].any()]
        m = len(used)
        yield _batch({"doc_id": pa.nulls(m, pa.int64()), "n": pa.nulls(m, pa.int64()), "node": pa.nulls(m, pa.int64()), "slice": pa.array(used, pa.int32()), "counts": pa.array([zlib.compress(counts[k * part : (k + 1) * part].tobytes(), 1) for k in used], pa.binary())})

    return hold(source.mapInArrow(tidied(run), "doc_id bigint, n bigint, node bigint, slice int, counts binary"))


def _frequent_bits(counted: DataFrame) -> np.ndarray:
    """A bit for each counter that stands out from the mean; which shingles share one only changes the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint16)
                total[k] = total[k] + more if k in total else more.astype(np.int64)
        bits = [np.packbits(x >= x.mean() + max(32.0, 8 * x.mean() ** 0.5), bitorder="little").tobytes() for x in total.values()]
        yield _batch({"slice": pa.array(list(total), pa.int32()), "bits": pa.array(bits, pa.binary())})

    slices = counted.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(tidied(run), "slice int, bits binary")
    return _joined_bits(slices, COUNTERS)


def _joined_bits(slices: DataFrame, n: int) -> np.ndarray:
    """A bitmap of n bits in all from its slices."""
    out = np.zeros(n // 8, np.uint8)
    size = len(out) // SLICES
    for row in slices.collect():
        out[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def _member_bits(places: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over places 0..MEMBERS-1: what is in the table, and by chance some of what is not."""
    part = MEMBERS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column(0))
            for k in np.unique(at // part).tolist():
                found.setdefault(k, np.zeros(part, bool))[at[at // part == k] - k * part] = True
        yield _batch({"slice": pa.array(list(found), pa.int32()), "bits": pa.array([np.packbits(x, bitorder="little").tobytes() for x in found.values()], pa.binary())})

    slices = places.select(places.columns[0], F.floor(F.col(places.columns[0]) / part).alias("k")).repartition(SLICES, "k")
    return _joined_bits(slices.select(places.columns[0]).mapInArrow(tidied(run), "slice int, bits binary"), MEMBERS)


def _shared_postings(source: DataFrame, words: int, similarity: int, frequent) -> DataFrame:
    """(s, node, least): shingles of prefixes that another node's prefix holds too, and how many of them a node needs."""
    spark = source.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        held: dict[int, tuple[np.ndarray, int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            nodes = np.array(list(held), np.int64)
            need = np.array([v[1] for v in held.values()], np.int64)
            s = np.concatenate([v[0] for v in held.values()])
            index = np.repeat(np.arange(len(nodes)), [len(v[0]) for v in held.values()])
            bucket = ((s >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                at = order[edges[k] : edges[k + 1]]
                if len(at):
                    own, place = np.unique(index[at], return_inverse=True)
                    rows.append((k, pickle.dumps((s[at], place.astype(np.uint32), nodes[own], need[own].astype(np.int32)), protocol=5)))
            return _batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        for batch in batches:
            for a, b in ranges_of(batch.column(0), 400_000):
                for x in shingle_sets(batch.column(0).slice(a, b - a).to_pylist(), words):
                    if len(x) and (key := set_key(x)) not in held:
                        held[key] = prefix(x, similarity, bits), spare(least_overlap(len(x), similarity))
                        size += len(held[key][0])
                if size >= 1_000_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blobs.setdefault(k, []).append(pickle.loads(blob.as_buffer()))
        for found in blobs.values():
            s = np.concatenate([f[0] for f in found])
            node = np.concatenate([f[2][f[1]] for f in found])
            need = np.concatenate([f[3][f[1]] for f in found])
            order = np.lexsort((node, s))
            s, node, need = s[order], node[order], need[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])])
            s, node, need = s[new], node[new], need[new]
            same = s[1:] == s[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            kept = np.flatnonzero(keep)
            for a in range(0, len(kept), 100_000):
                at = kept[a : a + 100_000]
                yield _batch({"s": pa.array(s[at].view(np.int64)), "node": pa.array(node[at]), "least": pa.array(need[at], pa.int32())})

    dealt = source.select("text").mapInArrow(tidied(emit), "bucket int, blob binary").repartition(buckets, "bucket")
    return hold(dealt.mapInArrow(tidied(match), "s bigint, node bigint, least int"))


def shared_with(pivot: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many shingles of a pivot each set holds; the sets stand one after another in ``flat``, none of them empty."""
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), begin)


class Region:
    """Sets that may be linked, and the components found among them so far."""

    def __init__(self, sets: list[np.ndarray], similarity: int):
        self.sets, self.similarity, self.radius = sets, similarity, 1 - similarity / 100
        self.n = np.array([len(x) for x in sets], np.int64)
        self.component = np.arange(len(sets))
        self.open = np.ones(len(sets), bool)  # not yet compared, as a pivot, with all that it may be linked to
        self.distances: list[np.ndarray] = []  # of each pivot so far to all sets; not a number where they were not compared
        self.links: list[tuple[int, int]] = []

    def compare(self, p: int, others: np.ndarray, sizes: bool = True) -> None:
        """Compares a pivot with others (of a size that can be linked, unless told otherwise): links them, and keeps their distances."""
        if sizes:
            others = others[100 * np.minimum(self.n[others], self.n[p]) >= self.similarity * np.maximum(self.n[others], self.n[p])]
        self.open[p] = False
        if not len(others):
            return
        ends = np.cumsum(self.n[others])
        both = shared_with(self.sets[p], np.concatenate([self.sets[i] for i in others]), ends - self.n[others])
        union = self.n[others] + self.n[p] - both
        for i in others[100 * both >= self.similarity * union].tolist():
            self.links.append((p, i))
            if self.component[i] != self.component[p]:
                low, high = sorted((self.component[i], self.component[p]))
                self.component[self.component == high] = low
        d = np.full(len(self.sets), np.nan)
        d[others] = 1 - both / union
        self.distances.append(d)

    def window(self, p: int) -> np.ndarray:
        """Sets that the triangle inequality lets a set be linked to: their distances to every pivot differ by the radius at most."""
        out = np.ones(len(self.sets), bool)
        for d in self.distances:
            if not np.isnan(d[p]):
                out &= ~(np.abs(d - d[p]) > self.radius + 1e-9)
        return out

    def resolve(self) -> list[tuple[int, int]]:
        """Links enough to connect all that is connected, the first set being the first pivot."""
        p = 0
        while True:
            others = np.flatnonzero(self.open & (self.component != self.component[p]) & self.window(p))
            self.compare(p, others[others != p])
            if (self.component == self.component[0]).all():
                return self.links
            left = np.flatnonzero(self.open)
            if len(left) < 2:
                return self.links
            p = int(left[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that links reach from each node of (a, b).

    Every round takes the least label among neighbours and then follows labels twice as far; it ends when none changes.
    """
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.select(turned.alias("e")).select("e.a", "e.b").distinct(), small=True)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), small=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(moved.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), small=True)
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of a sorted stream by their first columns: (key, the other columns as lists)."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != key:
                if key is not None:
                    yield key, held
                key, held = row[:keys], [[] for _ in row[keys:]]
            for store, value in zip(held, row[keys:], strict=True):
                store.append(value)
    if key is not None:
        yield key, held


def _compare_cells(cells: DataFrame, similarity: int, distances: bool = False) -> DataFrame:
    """Links (a, b) from cells of (region, cell, whole, lead, node, blob): all of a whole region, or its leads with its members.

    distances: rows (a, b, ring) of every member of a region that is not whole, too, ring being its distance to the
    lead in radii, rounded down; links have none.
    """
    radius = 1 - similarity / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (whole, lead, node, blob) in _groups(batches, 2):
            sets = [np.frombuffer(b, np.uint64) for b in blob]
            rings: list[tuple[int, int, int]] = []
            if whole[0]:
                first = lead.index(1) if 1 in lead else 0
                order = [first, *(i for i in range(len(sets)) if i != first)]
                region = Region([sets[i] for i in order], similarity)
                links = [(node[order[a]], node[order[b]]) for a, b in region.resolve() if node[order[a]] != node[order[b]]]
            else:
                n_lead = sum(lead)  # leads sort first
                region = Region(sets, similarity)
                for p in range(n_lead):
                    # a lead's distances to the leads after it narrow what those are compared with
                    open_ = (region.component != region.component[p]) & region.window(p)
                    open_[:n_lead] = False
                    open_[p + 1 : n_lead] = True
                    region.compare(p, np.arange(n_lead, len(sets)) if distances else np.flatnonzero(open_), sizes=not distances)
                links = [(node[a], node[b]) for a, b in region.links if node[a] != node[b]]
                if distances and n_lead:
                    # a linked set's ring is 0 or 1, whatever the rounding
                    steps = np.floor(np.nan_to_num(region.distances[0]) / max(radius, 1e-9) + 1e-9).astype(np.int64)
                    rings = [(node[0], node[i], int(steps[i])) for i in range(n_lead, len(sets))]
            rows = [(*x, None) for x in links] + rings
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int32())], ["a", "b", "ring"])

    rows = cells.select("region", "cell", "whole", "lead", "node", "blob").repartition("region", "cell").sortWithinPartitions("region", "cell", F.desc("lead"), "node")
    found = rows.mapInArrow(tidied(run), "a bigint, b bigint, ring int")
    return found if distances else found.select("a", "b")


def link_documents(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): each document, the size of its set and the least id that links reach from it.

    Documents link when their sets of ``words``-word shingles share ``similarity`` percent of their union at least. A
    text without words, or null, has an empty set and is linked with nothing. Equal sets are one node, whatever the
    number of copies; repeated rows each get their row. Null ids stay, and count as an id only where no other is.
    """
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    spark = docs.sparkSession
    counted = _count_shingles(source, words)
    members = counted.where("slice IS NULL").select("doc_id", "n", "node")
    frequent = spark.sparkContext.broadcast(_frequent_bits(counted))
    shared = _shared_postings(source, words, similarity, frequent)
    enough = shared.groupBy("node").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("node")
    postings = cut(shared.join(cut(enough, small=True).hint("merge"), "node", "left_semi"))
    release(shared)
    # written aggregates are dealt anew for a join, so that a key with many rows can be split there
    pivots = cut(postings.groupBy("s").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("s", "pivot"), small=True)
    # Linked nodes share ``least`` shingles or more, counted from either side. If each side leaves regions with fewer than
    # half as many of its shingles, one shared shingle remains whose region both keep: chance meetings go, links stay.
    joined = postings.join(pivots, "s").groupBy("pivot", "node").agg(F.count("*").alias("n"), F.max("least").alias("least"))
    left_out = F.sum("n").over(Window.partitionBy("node").orderBy((F.col("pivot") == F.col("node")).cast("int"), "n", "pivot"))
    met = joined.withColumn("out", left_out).where((F.col("pivot") != F.col("node")) & (2 * F.col("out") >= F.col("least"))).select("pivot", "node")
    met = cut(met, small=True)
    sizes = cut(met.groupBy(F.col("pivot").alias("region")).agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK)), small=True)
    met = met.withColumnRenamed("pivot", "region").union(sizes.select("region", F.col("region").alias("node")))
    # the sets of all nodes that lie in a region, from the text of one document each: the bitmap spares reading most
    # others, and those that it lets through by chance find no node to join
    wanted = met.select("node").distinct()
    chosen = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(MEMBERS - 1))
    in_regions = spark.sparkContext.broadcast(_member_bits(chosen.select(place.alias("place"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = in_regions.value
        for batch in batches:
            at = np.asarray(batch.column(0))
            held = batch.column(1).filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for a, b in ranges_of(held, 400_000):
                found = [x for x in shingle_sets(held.slice(a, b - a).to_pylist(), words) if len(x)]
                yield _batch({"node": pa.array([set_key(x) for x in found], pa.int64()), "blob": pa.array([x.tobytes() for x in found], pa.binary())})

    blobs = source.select(place.alias("place"), "text").mapInArrow(tidied(sets), "node bigint, blob binary")
    # a node that comes twice is linked with itself, which adds nothing; dealt by node at last, so that joins by region
    # deal rows anew and can split a large one
    placed = met.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("node", "region"), F.col("blocks"))).join(blobs.hint("merge"), "node")
    placed = hold(placed.select("region", "block", "blocks", "node", "blob"))
    is_lead = F.col("node") == F.col("region")
    block = F.when(is_lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.select("region", F.explode(block).alias("cell"), (F.col("blocks") == 1).alias("whole"), is_lead.cast("int").alias("lead"), "node", "blob")
    met_pivots = cut(_compare_cells(first, similarity, distances=True), small=True)
    labels = components(met_pivots.where("ring IS NULL").select("a", "b"))
    rings = met_pivots.where("ring IS NOT NULL").select(F.col("a").alias("region"), F.col("b").alias("node"), "ring")
    large = placed.where("blocks > 1").select("region", "node", "blob")
    if not rings.isEmpty():
        labels = _large_regions(large, rings, labels, similarity)
    labelled = members.join(labels.withColumnRenamed("label", "found"), "node", "left").withColumn("label", F.coalesce("found", "node"))
    labelled = cut(labelled.select("doc_id", F.col("n").alias("n_shingles"), "label"))
    least = cut(labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")), small=True)
    release(counted, placed)
    return labelled.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only links between different labels count, and those once each."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    named = links.join(of("a"), "a", "left").select("b", F.coalesce("la", "a").alias("a"))
    named = named.join(of("b"), "b", "left").select("a", F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    joined = components(named)
    renamed = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return cut(renamed.union(joined.join(labels, "node", "left_anti")), small=True)


def _large_regions(large: DataFrame, rings: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Labels once regions of several blocks are resolved; so far each member has met its region's first pivot.

    A radius of no width has rings by rounding alone, which equal sets share all the same.
    """
    ringed = large.join(rings.groupBy("region", "node").agg(F.min("ring").alias("ring")), ["region", "node"], "left").withColumn("ring", F.coalesce("ring", F.lit(0)))
    sizes = cut(ringed.groupBy("region", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), small=True)
    members = hold(ringed.join(sizes, ["region", "ring"]).withColumn("block", F.pmod(F.xxhash64("node", "region"), F.col("blocks"))).drop("blocks"))
    beside = F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("beside")
    used, turn = None, 0
    while True:
        of = members.select("region", "node", "ring").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        main = labels.select(F.col("node").alias("region"), F.col("label").alias("main"))
        apart = of.join(main, "region", "left").where(F.col("main").isNull() | (F.col("label") != F.col("main"))).where("node <> region").select("region", "node", "ring")
        if used is not None:
            apart = apart.join(used, ["region", "node"], "left_anti")
        apart = cut(apart.distinct(), small=True)
        if apart.isEmpty():
            release(members)
            return labels
        # of each region so many open documents, in lots of PIVOTS: one lot in the first round
        lots = 4**turn
        n_open = cut(apart.groupBy("region").agg(F.count("*").alias("n_open")), small=True)
        drawn = apart.join(n_open, "region").withColumn("lot", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n_open") / PIVOTS)))
        chosen = cut(drawn.where(F.col("lot") < lots).select("region", "node", "ring", "lot"), small=True)
        # a pivot meets the rings beside its own: blocks against a stated set, never all pairs of rows
        wanted = cut(chosen.select("region", "lot", beside).distinct(), small=True)
        leads = chosen.select("region", "node", "lot", beside).join(sizes.withColumnRenamed("ring", "beside"), ["region", "beside"]).join(members.select("region", "node", "blob"), ["region", "node"])
        leads = leads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        follow = members.select("region", "node", F.col("ring").alias("beside"), "blob", "block").join(wanted, ["region", "beside"])
        cells = leads.select("region", "lot", "beside", "block", "node", "blob", F.lit(1).alias("lead")).unionByName(follow.select("region", "lot", "beside", "block", "node", "blob", F.lit(0).alias("lead")))
        cells = cells.withColumn("cell", F.struct("lot", "beside", "block")).withColumn("whole", F.lit(False))
        labels = _merge(labels, _compare_cells(cells, similarity))
        used = chosen.select("region", "node") if used is None else used.union(chosen.select("region", "node"))
        turn += 1
