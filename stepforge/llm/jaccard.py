"""Exact Jaccard self-join of shingle sets through count vectors in an R-tree.

1. features(): each document's set of hashed shingles gives its size, a 128-bit set hash, a count vector (shingles by
   group of their hash) and the keys of its prefix: with all shingles ordered from rare to frequent, two sets that
   overlap enough share one of their first n - need(n) + 1. The order takes frequencies from a sketch of fixed size
   over all documents, so a shingle that a large part of the corpus shares comes last and is hardly ever a key.
2. Documents with equal sets collapse to the least doc_id.
3. Keys that occur once anywhere are dropped (anchors.repeated). Per remaining key, every set is paired with the least
   member; pairs pass if sizes and the summed coordinate minima of the count vectors permit the overlap, and are then
   verified on the sets. This settles groups of copies in linear work.
4. Members of a key that are still in different components are joined by a dual R-tree descent over their count
   vectors, whose node bounds are summed minima of coordinate maxima; survivors are verified. A key with very many
   members is cut into blocks of bounded size, and every two blocks are joined by a task of their own.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors
from .common import Workspace
from .components import components, contracted
from .kernels import prefix, ranges, signed, slices, span, word_hashes, words

GROUPS = 64
#: Larger sets get a finer count vector besides, for pairs: bits of the hash that make its groups, by least size.
FINE_BITS = ((8192, 12), (2048, 10), (512, 8))
SKETCH_BITS, SKETCH_SLICES = 22, 64
#: Input that a task reads at least, for the number of lots in which sketches are added up.
TASK_BYTES = 16 << 20
#: Sets smaller than this have a bit map of that many hash groups besides, for pairs met in the tree.
MAP_BITS = 1024
#: Keys with more members are dealt out by size band as well.
HOT_KEY = 512
#: Members of a key (and size band) that one tree holds; more are cut into blocks, two of which make a tree.
BLOCK = 8192
#: Up to this many ids of documents to verify are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
FANOUT, LEAF_PAIRS = 16, 1 << 16
#: Shingles of the sets that a task describes before it sends their rows.
SETS_AT_ONCE = 1 << 18


def need(n1, n2, percent: int):
    """Least overlap of linked sets: ceil(percent * (n1 + n2) / (100 + percent))."""
    return -(-percent * (n1 + n2) // (100 + percent))


def shingle_sets(column, width: int):
    """(row, sorted distinct shingle hashes) of each text: runs of width words, ASCII lower case; fewer words make one run."""
    for a, b, data, offsets in slices(column):
        starts, ends, counts = words(data, offsets)
        sums = prefix(word_hashes(data, starts, ends, fold=True))
        first = np.arange(max(0, len(starts) - width + 1))
        grams = span(sums, first, first + width)
        for k in range(b - a):
            at, to = counts[k], counts[k + 1]
            if to - at >= width:
                yield a + k, np.unique(grams[at : to - width + 1])
            elif to > at:
                yield a + k, span(sums, np.asarray([at]), np.asarray([to]))
            else:
                yield a + k, np.zeros(0, np.uint64)


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """log2 of the number of sets that hold a shingle, by the upper SKETCH_BITS of its hash, over all documents.

    The sketch has 4 million counters of 32 bits in a task and one byte each when it is broadcast, at every scale.
    """
    size = 1 << (SKETCH_BITS - SKETCH_SLICES.bit_length() + 1)
    # sketches are added up in two steps, about as many in each
    lots = max(64, math.isqrt(int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // TASK_BYTES))

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            found = [x for _, x in shingle_sets(batch.column(0), width)]
            places, times = np.unique(np.concatenate(found) >> np.uint64(64 - SKETCH_BITS) if found else np.zeros(0, np.uint64), return_counts=True)
            total[places.astype(np.int64)] += times.astype(np.uint32)
        lot = TaskContext.get().partitionId() % lots
        packed = [zlib.compress(x.tobytes(), 1) for x in total.reshape(SKETCH_SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array([lot] * SKETCH_SLICES, pa.int32()), pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["lot", "slice", "packed"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint32)
        for x in pdf["packed"]:
            more = np.frombuffer(zlib.decompress(x), np.uint32)
            total = np.where(total > np.uint32(0xFFFFFFFF) - more, np.uint32(0xFFFFFFFF), total + more)
        return pd.DataFrame([{"lot": int(pdf["lot"].iloc[0]), "slice": int(pdf["slice"].iloc[0]), "packed": zlib.compress(total.tobytes(), 1)}])

    schema = "lot int, slice int, packed binary"
    sums = docs.select("text").mapInArrow(count, schema).groupBy("lot", "slice").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    levels = np.zeros((SKETCH_SLICES, size), np.uint8)
    for row in sums.toLocalIterator():  # SKETCH_SLICES rows
        levels[row["slice"]] = np.log2(np.frombuffer(zlib.decompress(row["packed"]), np.uint32) + 1.0)
    return levels.ravel()


def fine_vector(found: np.ndarray) -> bytes:
    """Counts by finer groups (their width, then their bits, then the counts), or nothing for a small set."""
    for least, bits in FINE_BITS:
        if len(found) >= least:
            counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            width = 1 if counts.max() < 256 else 2 if counts.max() < 65536 else 4
            return bytes([width, bits]) + counts.astype(f"<u{width}").tobytes()
    return b""


def bit_map(found: np.ndarray) -> bytes:
    """The groups (by the upper 10 bits of the hash) that a small set has, or nothing for a large set."""
    if len(found) >= MAP_BITS:
        return b""
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(found >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def map_overlap(maps: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Most that sets i and j can share: every group that only one of them has takes a member of it away."""
    only_i = np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64)
    only_j = np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes[i] - only_i, sizes[j] - only_j)


def fine_overlap(x: bytes, y: bytes) -> int | None:
    """Summed minima of two fine vectors at the coarser one's groups; None where one has none."""
    if not x or not y:
        return None
    a, b = (np.frombuffer(v, f"<u{v[0]}", offset=2).astype(np.int64) for v in (x, y))
    if len(a) != len(b):
        n = min(len(a), len(b))
        a, b = a.reshape(n, -1).sum(axis=1), b.reshape(n, -1).sum(axis=1)
    return int(np.minimum(a, b).sum())


def features(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def describe(ids: pa.Array, sets: list[np.ndarray], levels: np.ndarray) -> pa.RecordBatch:
        n, h1, h2, vectors, fine, maps, keys = [], [], [], [], [], [], []
        for found in sets:
            n.append(len(found))
            whole = span(prefix(found), np.asarray([0]), np.asarray([len(found)]))
            h1.append(int(signed(whole)[0]))
            h2.append(int(signed(np.asarray([np.bitwise_xor.reduce(found * np.uint64(0x9FB21C651E98DF25) ^ found >> np.uint64(29), initial=np.uint64(0))]))[0]))
            groups = np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=GROUPS)
            vectors.append(groups.astype("<u2").tobytes() if groups.max(initial=0) < 65536 else b"")
            fine.append(fine_vector(found))
            maps.append(bit_map(found))
            long = len(found) - -(-percent * len(found) // 100) + 1 if len(found) else 0
            rank = levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | found & np.uint64((1 << 56) - 1)
            keys.append(found[np.argpartition(rank, long - 1)[:long]].tobytes() if long else b"")
        columns = [*[pa.array(x, pa.int64()) for x in (n, h1, h2)], *[pa.array(x, pa.binary()) for x in (vectors, fine, maps, keys)]]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "h1", "h2", "vector", "fine", "map", "keys"])

    def run(batches):
        for batch in batches:
            sets, size = [], 0
            for row, found in shingle_sets(batch.column(1), width):
                sets.append(found)
                size += len(found)
                if size >= SETS_AT_ONCE or row == len(batch) - 1:
                    yield describe(batch.column(0).slice(row + 1 - len(sets), len(sets)), sets, shared.value)
                    sets, size = [], 0

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, vector binary, fine binary, map binary, keys binary")


def key_values(batch: pa.RecordBatch):
    joined = b"".join(x or b"" for x in batch.column(0).to_pylist())
    if joined:
        yield np.frombuffer(joined, np.uint64)


def key_rows(featured: DataFrame, table: np.ndarray) -> DataFrame:
    """key, doc_id, n for the keys whose bit is set."""
    shared = featured.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            values = np.frombuffer(b"".join(found), np.uint64)
            owner = np.repeat(np.arange(len(found)), [len(x) // 8 for x in found])
            keep = anchors.hits(shared.value, values)
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(signed(values[keep])), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "doc_id", "n"])

    return featured.filter("n > 0 and doc_id is not null").select("doc_id", "n", "keys").mapInArrow(run, "key long, doc_id long, n long")


def vectors_of(values: list[bytes], most: int = 1 << 30) -> np.ndarray:
    """Count vectors as rows; one that did not fit is without bound."""
    return np.stack([np.frombuffer(x, "<u2").astype(np.int32) if x else np.full(GROUPS, most // GROUPS, np.int32) for x in values]) if values else np.zeros((0, GROUPS), np.int32)


def bounded(edges: DataFrame, featured: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and count vectors permit a link."""

    def run(batches):
        for batch in batches:
            n1, n2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            overlap = np.minimum(vectors_of(batch.column(4).to_pylist()), vectors_of(batch.column(5).to_pylist())).sum(axis=1)
            for k, (x, y) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                if (finer := fine_overlap(x, y)) is not None:
                    overlap[k] = min(overlap[k], finer)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(overlap >= need(n1, n2, percent)))

    side = lambda x: featured.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("vector").alias(f"v{x}"), F.col("fine").alias(f"f{x}"))
    return edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb", "fa", "fb").mapInArrow(run, "a long, b long").distinct()


def tree_pairs(vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int, sides: np.ndarray | None = None):
    """Places (i, j), i < j, of members with different labels (and sides) that sizes and count vectors permit to link.

    The R-tree packs members in order of size, FANOUT to a node; nodes keep coordinate maxima and ranges of sizes and
    labels. Pairs of nodes are descended together, level by level and in lots of bounded size; two nodes of one and the
    same label hold no pair.
    """
    levels = [(vectors, sizes, sizes, labels, labels)]
    while len(levels[-1][0]) > FANOUT:
        v, low, high, least, most = levels[-1]
        cuts = np.arange(0, len(v), FANOUT)
        spans = [f.reduceat(x, cuts) for f, x in ((np.minimum, low), (np.maximum, high), (np.minimum, least), (np.maximum, most))]
        levels.append((np.maximum.reduceat(v, cuts), *spans))

    def passing(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        v, low, high, least, most = levels[level]
        ok = 100 * high[i] >= percent * low[j]  # j holds the larger members
        ok &= (least[i] != most[j]) | (most[i] != least[j])  # equal both ways: one label throughout
        if not level and sides is not None:
            ok &= sides[i] != sides[j]
        i, j, at = i[ok], j[ok], np.flatnonzero(ok)
        return at[np.minimum(v[i], v[j]).sum(axis=1) >= need(low[i], low[j], percent)]

    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]), 0 if top else 1)
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > LEAF_PAIRS:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        keep = passing(level, i, j)
        i, j = i[keep], j[keep]
        if not level:
            if len(i):
                yield i, j
            continue
        below = len(levels[level - 1][0])
        lot = max(1, LEAF_PAIRS // FANOUT**2)
        for k in range(0, len(i), lot):
            a = (i[k : k + lot, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            b = (j[k : k + lot, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            real = (a < b) & (b < below) if level == 1 else (a <= b) & (b < below)
            stack.append((level - 1, a[real], b[real]))


def tree_join(batches, percent: int):
    """Rows (key, band, cell, n, doc_id, home, label, block, vector, map) sorted by key, band, cell and n: candidate pairs.

    The rows of one key, band and cell are gathered (two blocks at most) and make one tree; a cell of two blocks gives
    the pairs across them only.
    """

    sent: set[tuple[int, int]] = set()  # pairs meet under several keys

    def flush(group: list):
        if len(sent) > 500_000:
            sent.clear()
        if len(group) > 1:
            n = np.asarray([x[0] for x in group], np.int64)
            ids, labels, home, block = (np.asarray([x[k] for x in group]) for k in (1, 3, 2, 4))
            sides = block if block.min() < block.max() else None
            mapped = np.asarray([bool(x[6]) for x in group])
            maps = np.stack([np.frombuffer(x[6] or bytes(MAP_BITS // 8), np.uint64) for x in group])
            for i, j in tree_pairs(vectors_of([x[5] for x in group]), n, labels, percent, sides):
                keep = home[i] | home[j]
                small = keep & mapped[i] & mapped[j]
                keep[small] = map_overlap(maps, n, i[small], j[small]) >= need(n[i[small]], n[j[small]], percent)
                i, j = i[keep], j[keep]
                new = set(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist(), strict=True)) - sent
                if new:
                    sent.update(new)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new, strict=True)], names=["a", "b"])

    name, group = None, []
    for batch in batches:
        for key, band, cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, band, cell) != name:
                yield from flush(group)
                name, group = (key, band, cell), []
            group.append(row)
    yield from flush(group)


def verified(edges: DataFrame, docs: DataFrame, work: Workspace, label: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of edges (a saved table) whose shingle sets link."""
    ids = work.save(edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).distinct(), f"{label}-ids")
    few = ids.count() <= BROADCAST_IDS

    def pack(batches):
        for batch in batches:
            found = [x.tobytes() for _, x in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["doc_id", "found"])

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = work.save(docs.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text").mapInArrow(pack, "doc_id long, found binary"), f"{label}-sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("found").alias(f"s{x}"))
    return work.save(edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct(), f"{label}-links")


def link(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for every row of docs (doc_id, text).

    Sets link when 100 * intersection >= percent * union. A null, empty or blank text has an empty set and links with
    nothing; a text of fewer words than ``width`` has its whole word sequence as one shingle. Rows with equal doc_id
    are one node of the graph; a null doc_id is in no component. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    featured = work.save(features(docs, frequency_levels(docs, width), width, percent), "features")

    full = featured.filter("n > 0 and doc_id is not null").select("doc_id", "h1", "h2", "n")
    several = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    copies = work.save(full.join(several, ["h1", "h2", "n"]).filter("doc_id <> first").select("doc_id", "first").distinct(), "copies")

    table = anchors.repeated(featured.select("keys"), key_values)
    rows = work.save(key_rows(featured, table).join(copies, "doc_id", "left_anti"), "rows")
    del table

    centers = rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("c"), F.count("*").alias("members")).filter("members > 1")
    centers = work.save(centers.select("key", F.col("c.doc_id").alias("a"), F.col("c.n").alias("na"), "members"), "centers")
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    star = rows.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb")).join(centers, "key").filter("a <> b").filter(fits)
    first = work.save(bounded(star.select("a", "b").distinct(), featured, percent), "star")
    links = verified(first, docs, work, "star", width, percent)
    # whole components, since members of one that have different labels would meet in the tree
    linked = work.save(contracted(links), "linked")
    labels = work.save(components(linked, work, "first").withColumnRenamed("node", "doc_id"), "labels")

    # members of a key that are not yet in one component
    labelled = rows.join(centers.select("key", "members"), "key").join(labels, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent))).cast("int")
    bands = F.when(F.col("members") > HOT_KEY, F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).otherwise(F.array(F.struct(F.lit(-1).alias("band"), F.lit(True).alias("home"))))
    dealt = labelled.join(open_keys, "key").select("key", "n", "doc_id", "label", F.explode(bands).alias("x")).select("key", "x.band", "n", "doc_id", "x.home", "label")
    # sizes that have a neighbour near enough; a band has few sizes, however many members
    by_size = Window.partitionBy("key", "band").orderBy("n")
    near = lambda other: F.coalesce(100 * F.least("n", other) >= percent * F.greatest("n", other), F.lit(False))
    sizes = dealt.groupBy("key", "band", "n").agg(F.count("*").alias("times"))
    sizes = sizes.withColumns({"_near": (F.col("times") > 1) | near(F.lag("n").over(by_size)) | near(F.lead("n").over(by_size)), "blocks": F.ceil(F.sum("times").over(Window.partitionBy("key", "band")) / F.lit(BLOCK)).cast("int")})
    dealt = dealt.join(sizes.filter("_near").select("key", "band", "n", "blocks"), ["key", "band", "n"])
    # each two blocks of a key and band make a cell; mostly there is one block
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least("block", o).cast("long") * F.col("blocks") + F.greatest("block", o))
    dealt = dealt.withColumn("cell", F.explode(cells))
    columns = ["key", "band", "cell", "n", "doc_id", "home", "label", "block", "vector", "map"]
    dealt = dealt.join(featured.select("doc_id", "vector", "map"), "doc_id").select(*columns)
    candidates = dealt.repartition("key", "band", "cell").sortWithinPartitions("key", "band", "cell", "n", "doc_id").mapInArrow(partial(tree_join, percent=percent), "a long, b long").distinct()
    candidates = bounded(work.save(candidates, "tree"), featured, percent)
    more = verified(work.save(candidates, "pairs"), docs, work, "tree", width, percent)

    final = components(work.save(contracted(work.save(linked.unionByName(more), "edges")), "linked-all"), work, "final")
    work.drop("rows", "centers", "star", "star-ids", "star-sets", "labels", "tree", "pairs", "tree-ids", "tree-sets")
    out = featured.select("doc_id", F.col("n").alias("n_shingles")).join(copies, "doc_id", "left").withColumn("node", F.coalesce("first", "doc_id"))
    return out.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
