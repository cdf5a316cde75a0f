"""Super-windows: the windows of a fixed number of units, cut into runs that share an anchor.

A window's anchor is its least-hashed run of k units (leftmost on ties), which its content alone decides: equal
windows have equal anchors at equal places. Consecutive windows with one anchor make a super-window. So a repeat can
only be found among super-windows with equal anchors, most of which, inside long copies, are equal as a whole; only
those at the edges of copies need a closer look. There is one super-window for about (window - k) / 2 windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .kernels import TABLE, TABLE2, prefix, ranges, sliding_argmin, slices, span, word_hashes, words


#: Up to this many repeated doc_ids are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


@dataclass
class Units:
    """The units (bytes or words) of some texts: prefix sums of their hashes in two lanes and where each text's begin."""

    offsets: np.ndarray
    first: np.ndarray
    second: np.ndarray


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(offsets, prefix(TABLE[data]), prefix(TABLE2[data]))


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    starts, ends, counts = words(data, offsets)
    return Units(counts, prefix(word_hashes(data, starts, ends)), prefix(word_hashes(data, starts, ends, table=TABLE2)))


def cut(units: Units, window: int, k: int):
    """text, first window, number of windows, anchor and anchor's hash of each super-window; places count from the first text."""
    sizes = np.maximum(np.diff(units.offsets) - window + 1, 0)
    if not sizes.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    n = len(units.first) - 1
    at = np.arange(n - k + 1)
    grams = span(units.first, at, at + k)
    least = sliding_argmin(grams, window - k + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.repeat(units.offsets[:-1], sizes) + ranges(sizes)
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(new)
    count = np.diff(np.append(place, len(start)))
    return text[place], start[place], count, anchor[place], grams[anchor[place]]


def keyed(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc, tag and text; tag tells rows of different (doc_id, text) apart, and repeated rows share one.

    A doc_id that one row has is its tag, so there is nothing to collide; rows that share a doc_id, or have none, take a
    hash of doc_id and text.
    """
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(doc.alias("doc"), text.alias("text"))
    again = work.save(rows.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("again")), "again")
    several = again.count()
    if not several:
        return rows.select("doc", F.col("doc").alias("tag"), "text")
    marked = rows.join(F.broadcast(again) if several <= BROADCAST_IDS else again, F.col("doc") == F.col("again"), "left")
    return marked.select("doc", F.when(F.col("again").isNull(), F.col("doc")).otherwise(F.xxhash64("doc", "text")).alias("tag"), "text")


def text_slices(batch, column: int, make):
    """(first row, Units, bytes, offsets) of pieces of a batch's texts."""
    for a, _, data, offsets in slices(batch.column(column)):
        yield a, make(data, offsets), data, offsets
