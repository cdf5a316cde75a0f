"""Removal of repeated byte strings by suffix sorting, one symbol of every string a round.

Every string of ``window`` bytes that starts at two places or more is removed. Super-windows (superwindows.py) find
where such strings can start: those whose anchor occurs once are unique, those whose whole content occurs twice are
repeats throughout. What is left, at the edges of copies, is cut into strings of a few symbols: the bytes that all
windows of the piece share are one symbol, kept apart by two 64-bit hashes. Shards of these strings go through
``multi_string_sort``: it builds the Burrows-Wheeler transform of the collection column by column and updates common
prefixes in each round; a window is a repeat if its suffix shares enough symbols with a neighbour.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors
from .common import Workspace
from .kernels import signed, span
from .superwindows import byte_units, cut, keyed, text_slices

ANCHOR_BYTES = 48
#: Windows in a piece, which its strings determine by this many symbols.
STEP = 16
#: Strings sorted together, and strings with one core from which windows are counted by a shuffle instead.
SHARD_STRINGS, HOT_CORE = 20_000, 20_000


def multi_string_sort(symbols: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, suffix length and common prefix with the suffix before (at most depth), for all suffixes in order.

    symbols: a row a string, aligned right; numbers from 1. Round j puts the suffixes of length j in place: a suffix
    cX comes among those that begin with c in the order of the X, so one stable pass over the transform moves every
    entry on. Two neighbours cX, cY share one symbol more than X and Y do; whether X and Y share d symbols is read from
    counts of the entries before them that share fewer with their own predecessor.
    """
    m, width = symbols.shape
    string, size = np.arange(m), np.zeros(m, np.int64)
    lcp = np.zeros(m, np.int8)
    padded = np.concatenate([np.zeros((m, 1), symbols.dtype), symbols], axis=1)

    def transform(string, size):
        return np.where(size < lengths[string], padded[string, width - np.minimum(size, width - 1)], 0)

    before = transform(string, size)
    for _ in range(int(lengths.max(initial=0))):
        places = np.flatnonzero(before)
        order = places[np.argsort(before[places], kind="stable")]
        same = np.zeros(len(order), bool)
        same[1:] = before[order[1:]] == before[order[:-1]]
        shared = same.astype(np.int8)
        at = np.flatnonzero(same)
        for d in range(1, depth):
            if not len(at):
                break
            group = np.cumsum(lcp < d)
            at = at[group[order[at]] == group[order[at - 1]]]
            shared[at] += 1
        string, size = np.concatenate([np.arange(m), string[order]]), np.concatenate([np.zeros(m, np.int64), size[order] + 1])
        lcp = np.concatenate([np.zeros(m, np.int8), shared])
        before = transform(string, size)
    return string, size, lcp


def repeated_windows(cores: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> list[np.ndarray]:
    """For each string left + core + right, the places of its windows (STEP symbols with the core) found in another one."""
    m = len(lefts)
    size = np.asarray([len(a) + len(b) + 1 for a, b in zip(lefts, rights, strict=True)], np.int64)
    width = 2 * STEP - 1
    symbols = np.zeros((m, width), np.int32)
    names = np.unique(cores, axis=0, return_inverse=True)[1].ravel() + 257
    for k, (a, b) in enumerate(zip(lefts, rights, strict=True)):
        at = width - len(a) - len(b) - 1
        symbols[k, at : at + len(a)] = np.frombuffer(a, np.uint8)
        symbols[k, at + len(a) + 1 :] = np.frombuffer(b, np.uint8)
        symbols[k, at:] += 1
        symbols[k, at + len(a)] = names[k]
    string, length, lcp = multi_string_sort(symbols, size, STEP)
    hit = lcp >= STEP
    hit[:-1] |= hit[1:]
    string, length = string[hit], length[hit]
    order = np.argsort(string, kind="stable")
    string, start = string[order], (size[string] - length)[order]
    return np.split(start, np.searchsorted(string, np.arange(1, m)))


ROWS = "m long, u long, tag long, lo long, n int, a int"
SPAN = "tag long, s long, e long"
PIECE = "c1 long, c2 long, single boolean, tag long, s long, l binary, r binary"


def anchor_values(batch: pa.RecordBatch, window: int):
    for _, units, _, _ in text_slices(batch, 0, byte_units):
        yield cut(units, window, ANCHOR_BYTES)[4]


def candidate_rows(docs: DataFrame, table: np.ndarray, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            tag = batch.column(0).to_numpy(zero_copy_only=False)
            for row, units, _, _ in text_slices(batch, 1, byte_units):
                text, lo, n, anchor, value = cut(units, window, ANCHOR_BYTES)
                keep = anchors.hits(shared.value, value)
                text, lo, n, anchor, value = text[keep], lo[keep], n[keep], anchor[keep], value[keep]
                if len(text):
                    whole = span(units.first, lo, lo + n - 1 + window)
                    arrays = (signed(value), signed(whole), tag[row + text], lo - units.offsets[text], n.astype(np.int32), (anchor - lo).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["m", "u", "tag", "lo", "n", "a"])

    return docs.select("tag", "text").mapInArrow(run, ROWS)


def cut_pieces(batches, window: int):
    """Pieces of STEP windows at fixed places before the anchor; columns tag, text, found (single, lo, n, a)."""
    for batch in batches:
        found, tag = batch.column(2).to_pylist(), batch.column(0).to_pylist()
        for row, units, data, offsets in text_slices(batch, 1, byte_units):
            rows, cores = [], []
            blob = data.tobytes()
            for t in range(len(offsets) - 1):
                base = int(offsets[t])
                for x in found[row + t]:
                    lo, hi, anchor = x["lo"], x["lo"] + x["n"] - 1, x["lo"] + x["a"]
                    for block in range((anchor - hi) // STEP, (anchor - lo) // STEP + 1):
                        high = anchor - STEP * block
                        low = high - STEP + 1
                        s, last = max(lo, low), min(hi, high)
                        cores.append((base + high, base + low + window))
                        rows.append((x["single"], tag[row + t], s, blob[base + s : base + high], blob[base + low + window : base + last + window]))
            if rows:
                at = np.asarray(cores, np.int64)
                lanes = [pa.array(signed(span(sums, at[:, 0], at[:, 1]))) for sums in (units.first, units.second)]
                types = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(lanes + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["c1", "c2", "single", "tag", "s", "l", "r"])


def sort_shards(batches, window: int):
    """Spans of repeated windows from pieces sorted by core; whole cores go into shards of about SHARD_STRINGS."""

    def flush(group: list):
        singles = {x[:2] for x in group if x[2]}
        counts: dict = {}
        for x in group:
            counts[x[:2]] = counts.get(x[:2], 0) + 1
        group = [x for x in group if x[:2] in singles and counts[x[:2]] > 1]
        if not group:
            return
        out = []
        for x, starts in zip(group, repeated_windows(np.asarray([x[:2] for x in group], np.int64), [x[5] for x in group], [x[6] for x in group]), strict=True):
            if x[2]:
                out += [(x[3], x[4] + int(k), x[4] + int(k) + window) for k in starts]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["tag", "s", "e"])

    group: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(group) >= SHARD_STRINGS and row[:2] != group[-1][:2]:
                yield from flush(group)
                group = []
            group.append(row)
    yield from flush(group)


def hot_windows(batches):
    """The windows of pieces one by one: c1, c2, w (what surrounds the core), and where they start."""
    for batch in batches:
        rows = []
        for c1, c2, single, tag, s, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(len(left) + len(right) + 2 - STEP):
                rows.append((c1, c2, bytes([len(left) - k]) + left[k:] + right[: STEP - 1 - len(left) + k], single, tag, s + k))
        if rows:
            types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["c1", "c2", "w", "single", "tag", "s"])


def repeated_spans(keyed_docs: DataFrame, work: Workspace, window: int, hot_core: int = HOT_CORE) -> DataFrame:
    """tag, s, e: byte ranges that together cover exactly the repeated strings."""
    table = anchors.repeated(keyed_docs.select("text"), partial(anchor_values, window=window))
    rows = work.save(candidate_rows(keyed_docs, table, window), "rows")
    distinct = work.save(rows.groupBy("m", "u").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("tag", "lo", "n", "a")]), "distinct")
    whole = rows.join(distinct.filter("times > 1").select("m", "u"), ["m", "u"], "left_semi").select("tag", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + window).alias("e"))

    unclear = distinct.groupBy("m").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1").select("m")
    chosen = distinct.join(unclear, "m", "left_semi").select("tag", F.struct((F.col("times") == 1).alias("single"), "lo", "n", "a").alias("y")).groupBy("tag").agg(F.collect_list("y").alias("found"))
    pieces = work.save(keyed_docs.join(chosen, "tag").select("tag", "text", "found").mapInArrow(partial(cut_pieces, window=window), PIECE), "pieces")

    hot = work.save(pieces.groupBy("c1", "c2").count().filter(F.col("count") > hot_core).select("c1", "c2"), "hot")
    cool = pieces.join(hot, ["c1", "c2"], "left_anti").select("c1", "c2", "single", "tag", "s", "l", "r")
    spans = whole.unionByName(cool.repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(partial(sort_shards, window=window), SPAN))
    if hot.count():
        each = work.save(pieces.join(hot, ["c1", "c2"], "left_semi").select("c1", "c2", "single", "tag", "s", "l", "r").mapInArrow(hot_windows, "c1 long, c2 long, w binary, single boolean, tag long, s long"), "windows")
        twice = each.groupBy("c1", "c2", "w").count().filter("count > 1").drop("count")
        spans = spans.unionByName(each.filter("single").join(twice, ["c1", "c2", "w"], "left_semi").select("tag", "s", (F.col("s") + window).alias("e")))
    return spans


def keep_rest(batches):
    """kept, n_bytes, n_removed, n_spans from doc, text and its ranges."""
    for batch in batches:
        out = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode()
            if not found:
                out.append((raw, len(raw), 0, 0))
                continue
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, [x["s"] for x in found], 1)
            np.add.at(edge, [x["e"] for x in found], -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc", "kept", "n_bytes", "n_removed", "n_spans"])


def dedup_substrings(docs: DataFrame, window: int = 200, hot_core: int = HOT_CORE) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans for every row of docs (doc_id, text).

    Removes each byte covered by a string of ``window`` bytes that also starts anywhere else, in this text or another;
    strings are judged on the input. A null or empty text has no bytes. Repeated rows are repeats of each other. Other
    columns are ignored; an empty table gives no rows. ``window`` must be at least ANCHOR_BYTES + STEP.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    base = keyed(docs, work)
    spans = repeated_spans(base, work, window, hot_core).groupBy("tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = base.join(spans, "tag", "left").select("doc", "text", "spans")
    out = joined.mapInArrow(keep_rest, T.StructType([T.StructField("doc", T.LongType()), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]))
    return out.select(F.nullif(F.col("doc"), F.lit(-(1 << 63))).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")
