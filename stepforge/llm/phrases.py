"""Removal of repeated phrases by sharded Aho-Corasick automata.

A window is ``window`` consecutive words; a word goes if a window that covers it also starts in a document with a
smaller doc_id. Super-windows (superwindows.py) over words find the passages that recur: an anchor that no other
document holds ends the matter, and where whole super-windows are equal, all but those of the least document go. At the
edges of copies, super-windows with one anchor differ; one of each kind goes to a shard. There, windows that recur are
confirmed and compiled into an Aho-Corasick automaton over word numbers with the least doc_id of each, and all the
shard's passages stream through it to find every occurrence.
"""

from __future__ import annotations

from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors
from .common import Workspace
from .kernels import signed, slices, span, words
from .superwindows import cut, keyed, text_slices, word_units

ANCHOR_WORDS = 5
#: Passages compiled together, and passages with one anchor from which windows are compared by a shuffle instead.
SHARD_PASSAGES, HOT_ANCHOR = 10_000, 10_000

ROWS = "m long, u long, doc long, tag long, lo int, n int"
SPAN = "tag long, s long, e long"
PASSAGE = "m long, u long, doc long, tag long, lo int, n int, body binary"


def anchor_values(batch: pa.RecordBatch, window: int):
    """Each document's anchors, every one once."""
    for _, units, _, _ in text_slices(batch, 0, word_units):
        text, _, _, _, value = cut(units, window, ANCHOR_WORDS)
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        yield value[new]


def candidate_rows(docs: DataFrame, table: np.ndarray, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, units, _, _ in text_slices(batch, 2, word_units):
                text, lo, n, _, value = cut(units, window, ANCHOR_WORDS)
                keep = anchors.hits(shared.value, value)
                text, lo, n, value = text[keep], lo[keep], n[keep], value[keep]
                if len(text):
                    whole = span(units.first, lo, lo + n - 1 + window) ^ span(units.second, lo, lo + n - 1 + window)
                    arrays = (signed(value), signed(whole), doc[row + text], tag[row + text], (lo - units.offsets[text]).astype(np.int32), n.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["m", "u", "doc", "tag", "lo", "n"])

    return docs.mapInArrow(run, ROWS)


def passages(batches, window: int):
    """The words of chosen super-windows, joined by one space; columns doc, tag, text, found (m, u, lo, n)."""
    for batch in batches:
        found, doc, tag = batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, _, data, offsets in slices(batch.column(2)):
            starts, ends, counts = words(data, offsets)
            blob, rows = data.tobytes(), []
            for t in range(len(offsets) - 1):
                for x in found[row + t]:
                    a = int(counts[t]) + x["lo"]
                    b = a + x["n"] - 1 + window
                    rows.append((x["m"], x["u"], doc[row + t], tag[row + t], x["lo"], x["n"], b" ".join(blob[p:q] for p, q in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["m", "u", "doc", "tag", "lo", "n", "body"])


def find_phrases(group: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """Spans (tag, s, e) of the windows in passages (m, u, doc, tag, lo, n, body) that a smaller document holds too."""
    numbers: dict[bytes, int] = {}
    coded = [tuple(numbers.setdefault(w, len(numbers) + 1) for w in x[6].split(b" ")) for x in group]
    least: dict[tuple, int] = {}
    again: set[tuple] = set()
    for x, ids in zip(group, coded, strict=True):
        for k in range(len(ids) - window + 1):
            phrase = ids[k : k + window]
            held = least.get(phrase)
            if held is None:
                least[phrase] = x[2]
            elif held != x[2]:
                again.add(phrase)
                least[phrase] = min(held, x[2])
    if not again:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in again:
        automaton.add_word(phrase, least[phrase])
    automaton.make_automaton()
    out = []
    for x, ids in zip(group, coded, strict=True):
        for end, first in automaton.iter(ids):
            if first < x[2]:
                s = x[4] + end - window + 1
                out.append((x[3], s, s + window))
    return out


def search_shards(batches, window: int):
    """Spans from passages sorted by anchor; whole anchors go into shards of about SHARD_PASSAGES."""

    def flush(group: list):
        if found := find_phrases(group, window):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["tag", "s", "e"])

    group: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(group) >= SHARD_PASSAGES and row[0] != group[-1][0]:
                yield from flush(group)
                group = []
            group.append(row)
    yield from flush(group)


def single_windows(batches, window: int):
    for batch in batches:
        rows = []
        for _, _, doc, tag, lo, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = body.split(b" ")
            rows += [(b" ".join(parts[k : k + window]), doc, tag, lo + k) for k in range(n)]
        if rows:
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["w", "doc", "tag", "s"])


def repeated_spans(keyed_docs: DataFrame, work: Workspace, window: int, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """tag, s, e: word ranges that together cover exactly the words to remove."""
    table = anchors.repeated(keyed_docs.select("text"), partial(anchor_values, window=window))
    rows = work.save(candidate_rows(keyed_docs, table, window), "rows")
    distinct = work.save(rows.groupBy("m", "u").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "distinct")
    several = distinct.filter("last > first").select("m", "u", "first")
    whole = rows.join(several, ["m", "u"]).filter("doc > first").select("tag", F.col("lo").cast("long").alias("s"), (F.col("lo") + F.col("n") - 1 + window).cast("long").alias("e"))

    # kinds of one anchor in different documents: the first document of each kind is still open, in each of its places
    unclear = distinct.groupBy("m").agg(F.count("*").alias("kinds"), F.min("first").alias("low"), F.max("first").alias("high")).filter("kinds > 1 and low < high").select("m", "kinds")
    chosen = distinct.join(unclear, "m").select("m", "u", "first")
    chosen = rows.join(chosen, ["m", "u"]).filter("doc = first").groupBy("tag").agg(F.collect_list(F.struct("m", "u", "lo", "n")).alias("found"))
    bodies = work.save(keyed_docs.join(chosen, "tag").select("doc", "tag", "text", "found").mapInArrow(partial(passages, window=window), PASSAGE), "passages")
    hot = work.save(unclear.filter(F.col("kinds") > hot_anchor).select("m"), "hot")
    cool = bodies.join(hot, "m", "left_anti").select("m", "u", "doc", "tag", "lo", "n", "body")
    spans = whole.unionByName(cool.repartition("m").sortWithinPartitions("m").mapInArrow(partial(search_shards, window=window), SPAN))
    if hot.count():
        each = work.save(bodies.join(hot, "m", "left_semi").select("m", "u", "doc", "tag", "lo", "n", "body").mapInArrow(partial(single_windows, window=window), "w binary, doc long, tag long, s long"), "windows")
        least = each.groupBy("w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("w", "first")
        spans = spans.unionByName(each.join(least, "w").filter("doc > first").select("tag", "s", (F.col("s") + window).alias("e")))
    return spans


def keep_words(batches):
    """kept (words joined by one space), n_words and n_removed from doc, text and its ranges."""
    for batch in batches:
        found, out = batch.column(2).to_pylist(), []
        for row, _, data, offsets in slices(batch.column(1)):
            starts, ends, counts = words(data, offsets)
            blob = data.tobytes()
            for t in range(len(offsets) - 1):
                a, b = int(counts[t]), int(counts[t + 1])
                gone = np.zeros(b - a, bool)
                if found[row + t]:
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, [x["s"] for x in found[row + t]], 1)
                    np.add.at(edge, [x["e"] for x in found[row + t]], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                kept = " ".join(blob[p:q].decode("utf-8", "replace") for p, q in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist(), strict=True))
                out.append((kept, b - a, int(gone.sum())))
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc", "kept", "n_words", "n_removed"])


def dedup_phrases(docs: DataFrame, window: int = 13, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, kept (text), n_words and n_removed for every row of docs (doc_id, text).

    Words are runs of bytes other than ASCII white space. Removes each word covered by a window whose word sequence
    also starts in a document with a smaller doc_id; windows are judged on the input. A null, empty or blank text has no
    words. Rows with equal doc_id never remove from each other. A null doc_id counts as less than all others. Other
    columns are ignored; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "phrases")
    base = keyed(docs, work)
    spans = repeated_spans(base, work, window, hot_anchor).groupBy("tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = base.join(spans, "tag", "left").select("doc", "text", "spans")
    out = joined.mapInArrow(keep_words, T.StructType([T.StructField("doc", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
    return out.select(F.nullif(F.col("doc"), F.lit(-(1 << 63))).alias("doc_id"), "kept", "n_words", "n_removed")
