"""Line dedup through sharded minimal perfect hashes over distinct line hashes.

1. Tasks send the 128-bit hashes of their distinct line keys with doc_ids, packed by shard (the upper bits of a hash). Of
   a key's documents a task sends the least few and the largest, which is all that a count up to the floor and the
   keeper need, so a line that a third of all documents hold costs a few rows a task.
2. A shard's task builds a minimal perfect hash over all its distinct line hashes and fills the arrays in slot order:
   fingerprint, count of documents and keeper (largest doc_id). Keys whose count reaches the floor are read off.
3. These keys, which alone can drop a line, are indexed in the same way, and documents probe that index: broadcast
   whole up to a fixed size, else dealt out: hashes of lines (never texts) go to the shard that holds their arrays, in
   portions of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .kernels import mix, slices

BLANKS = b" \t\n\x0b\x0c\r"
#: Hashes that a task gathers before it sends them, and input bytes for each shard that counts.
FLUSH, COUNT_BYTES = 400_000, 32 << 20
SHARD_KEYS = 200_000
#: An index up to this size is broadcast whole; the shards of a larger one are dealt out.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 28
#: Lines that one portion of a dealt shard probes, about.
PORTION = 1_000_000


class PerfectHash:
    """Minimal perfect hash by levels of bits: a key takes the first level at which no other key hits its bit.

    The rank of that bit among all set bits is the key's slot. What is left after the last level is searched sorted.
    """

    GAMMA, LEVELS = 2.0, 24

    def __init__(self, keys: np.ndarray):
        self.sizes: list[int] = []
        bits: list[np.ndarray] = []
        left = keys
        for level in range(self.LEVELS):
            if not len(left):
                break
            size = max(64, int(self.GAMMA * len(left)))
            at = self.place(left, level, size)
            hits = np.bincount(at, minlength=size)
            bits.append(hits == 1)
            self.sizes.append(size)
            left = left[hits[at] > 1]
        self.rest = np.sort(left)
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int32)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was never added gets any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        if len(self.rest):
            at = np.searchsorted(self.rest, keys[open_])
            hit = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_])
            out[open_[hit]] = self.rank[-1] + at[hit]
        return out


class Shard:
    """Perfect hash over all given hashes with arrays in slot order: fingerprint, count of documents, largest doc_id.

    h1 places a key and h2 is its fingerprint. Should two keys have one h1, the later ones are kept apart, sorted.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        """Distinct (h1, h2), sorted; counts are 0 and no document is a keeper yet."""
        again = np.zeros(len(h1), bool)
        again[1:] = h1[1:] == h1[:-1]
        self.extra = {(int(a), int(b)): len(h1) - int(again.sum()) + k for k, (a, b) in enumerate(zip(h1[again], h2[again], strict=True))}
        self.hash = PerfectHash(h1[~again])
        self.fingerprint, self.count = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.int32)
        self.keeper = np.full(len(h1), np.iinfo(np.int64).min)
        self.fingerprint[self.hash.slots(h1[~again])] = h2[~again]
        if self.extra:
            self.fingerprint[[*self.extra.values()]] = h2[again]

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that was never added."""
        if not len(self.fingerprint):
            return np.full(len(h1), -1, np.int64)
        at = self.hash.slots(h1)
        at[(at >= 0) & (self.fingerprint[at] != h2)] = -1
        if self.extra:
            for k in np.flatnonzero(at < 0).tolist():
                at[k] = self.extra.get((int(h1[k]), int(h2[k])), -1)
        return at

    def fill(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, n: np.ndarray | int = 1) -> None:
        at = self.slots(h1, h2)
        np.add.at(self.count, at, n)
        np.maximum.at(self.keeper, at, doc)

    def dump(self) -> dict:
        h = self.hash
        extra = np.asarray([(*k, v) for k, v in self.extra.items()], np.uint64).tobytes()
        return {"sizes": h.sizes, "bits": np.packbits(h.bits).tobytes(), "rest": h.rest.tobytes(), "extra": extra, "fingerprint": self.fingerprint.tobytes(), "counts": self.count.tobytes(), "keeper": self.keeper.tobytes()}

    @classmethod
    def load(cls, row) -> Shard:
        self, h = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        h.sizes = list(row["sizes"])
        h.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(h.sizes)).astype(bool)
        h.rest = np.frombuffer(row["rest"], np.uint64)
        h.rank = np.concatenate([[0], np.cumsum(h.bits)]).astype(np.int32)
        self.extra = {(a, b): c for a, b, c in np.frombuffer(row["extra"], np.uint64).reshape(-1, 3).tolist()}
        self.hash, self.fingerprint = h, np.frombuffer(row["fingerprint"], np.uint64)
        self.count, self.keeper = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["keeper"], np.int64)
        return self

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether the line of each hash goes from each document: its count reaches the floor and another one keeps it."""
        at = self.slots(h1, h2)
        return (at >= 0) & (self.count[at] >= min_docs) & (self.keeper[at] != doc) if len(self.count) else np.zeros(len(h1), bool)


INDEX = "shard int, sizes array<long>, bits binary, rest binary, extra binary, fingerprint binary, counts binary, keeper binary"
TRIPLE = np.dtype([("h1", np.uint64), ("h2", np.uint64), ("doc", np.int64)])


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 % np.uint64(shards)).astype(np.int32)


def enough(triples: np.ndarray, min_docs: int) -> np.ndarray:
    """Sorted (h1, h2, doc) without repeats, of each key the min_docs least documents and the largest."""
    t = triples[np.lexsort((triples["doc"], triples["h2"], triples["h1"]))]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    t = t[new]
    first = np.ones(len(t), bool)
    first[1:] = (t["h1"][1:] != t["h1"][:-1]) | (t["h2"][1:] != t["h2"][:-1])
    begins = np.flatnonzero(first)
    place = np.arange(len(t)) - np.repeat(begins, np.diff(np.append(begins, len(t))))
    last = np.append(first[1:], True)
    return t[(place < min_docs) | last]


def line_keys(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines whose key is long enough, and the 128-bit hashes of these keys as pairs."""
    at, digests = [], []
    for k, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(k)
                digests.append(xxhash.xxh3_128_digest(key))
    return np.asarray(at, np.int64), np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def split_lines(column):
    """(row, its lines as bytes) for each text; a null or empty text is one empty line."""
    for a, b, data, offsets in slices(column):
        blob = data.tobytes()
        for k in range(b - a):
            yield a + k, blob[offsets[k] : offsets[k + 1]].split(b"\n")


def send_hashes(batches, min_chars: int, min_docs: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Packed triples by shard from batches of doc_id and text."""

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        t = enough(np.concatenate(parts), min_docs)
        shard = shard_of(t["h1"], shards)
        order = np.argsort(shard, kind="stable")
        t, shard = t[order], shard[order]
        begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        packed = [x.tobytes() for x in np.split(t, begins[1:])]
        return pa.RecordBatch.from_arrays([pa.array(shard[begins]), pa.array(packed, pa.binary())], names=["shard", "packed"])

    parts, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, lines in split_lines(batch.column(1)):
            _, found = line_keys(lines, min_chars)
            if len(found):
                t = np.empty(len(found), TRIPLE)
                t["h1"], t["h2"], t["doc"] = found[:, 0], found[:, 1], ids[row]
                parts.append(t)
                size += len(t)
                if size >= FLUSH:
                    yield send(parts)
                    parts, size = [], 0
    if size:
        yield send(parts)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """h1, h2, n_docs and keeper (largest doc_id) of each line key found in min_docs distinct doc_ids at least.

    n_docs is exact up to min_docs and a lower bound beyond it.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(8, -(-size // COUNT_BYTES))

    def run(batches):
        return send_hashes(batches, min_chars, min_docs, shards)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        t = enough(np.concatenate([np.frombuffer(x, TRIPLE) for x in pdf["packed"]]), min_docs)
        new = np.ones(len(t), bool)
        new[1:] = (t["h1"][1:] != t["h1"][:-1]) | (t["h2"][1:] != t["h2"][:-1])
        keys = t[new]
        shard = Shard(keys["h1"], keys["h2"])
        shard.fill(t["h1"], t["h2"], t["doc"])
        at = shard.slots(keys["h1"], keys["h2"])
        found = shard.count[at] >= min_docs
        at, keys = at[found], keys[found]
        return pd.DataFrame({"h1": keys["h1"].view(np.int64), "h2": keys["h2"].view(np.int64), "n_docs": shard.count[at].astype(np.int64), "keeper": shard.keeper[at]})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    return texts.mapInArrow(run, "shard int, packed binary").groupBy("shard").applyInPandas(count, "h1 long, h2 long, n_docs long, keeper long")


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """An index row of one shard's repeated keys."""
    t = np.empty(len(pdf), TRIPLE)
    t["h1"], t["h2"], t["doc"] = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64), pdf["keeper"].to_numpy()
    order = np.lexsort((t["h2"], t["h1"]))
    t = t[order]
    shard = Shard(t["h1"], t["h2"])
    shard.fill(t["h1"], t["h2"], t["doc"], pdf["n_docs"].to_numpy()[order].astype(np.int32))
    return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **shard.dump()}])


def dropped_by_index(groups, shards: int, min_docs: int):
    """A function (doc, row, hashes) -> whether each hash's line goes, out of a broadcast index."""
    index = {row["shard"]: Shard.load(row) for row in groups.value}

    def gone(doc: int, _: int, pairs: np.ndarray) -> np.ndarray:
        h1, h2 = pairs[:, 0], pairs[:, 1]
        where, out = shard_of(h1, shards), np.zeros(len(h1), bool)
        for shard in np.unique(where).tolist():
            if shard in index:
                mine = where == shard
                out[mine] = index[shard].drops(h1[mine], h2[mine], np.int64(doc), min_docs)
        return out

    return gone


NO_DOC = -(1 << 63)


def drop_lines(docs: DataFrame, min_chars: int, choose) -> DataFrame:
    """docs with the lines that go left out, n_lines and n_dropped.

    choose(batch) gives a function (doc, row, hashes) -> whether each line with a long enough key goes.
    """
    columns = [f for f in docs.schema if f.name not in ("n_lines", "n_dropped", "_gone")]
    names = [f.name for f in columns]
    id_at, text_at = names.index("doc_id"), names.index("text")
    asked = [F.col(f"`{n}`") for n in names] + ([F.col("_gone")] if "_gone" in docs.columns else [])

    def run(batches):
        start = choose()
        for batch in batches:
            decide = start(batch)
            ids = batch.column(id_at).cast(pa.int64()).fill_null(NO_DOC).to_pylist()
            total, dropped, texts = [], [], []
            for row, lines in split_lines(batch.column(text_at)):
                at, pairs = line_keys(lines, min_chars)
                gone = set(at[decide(ids[row], row, pairs)].tolist()) if len(at) else set()
                total.append(len(lines))
                dropped.append(len(gone))
                texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode("utf-8", "replace"))
            arrays = [batch.column(k) for k in range(len(names))]
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.select(*asked).mapInArrow(run, T.StructType([*columns, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


PROBE = "shard int, portion int, h1 long, h2 long, doc long, tag1 long, tag2 long, arrays binary"


def dealt_drops(docs: DataFrame, index: DataFrame, work: Workspace, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """docs with _gone: hashes (16 bytes each) of the lines that go, found by the shards that the hashes are dealt to.

    A shard's arrays are the first row of each of its portions, and the probes stream past them. A document that holds a
    key several times asks once. Answers come back by document (doc_id and a 128-bit hash of its text).
    """
    tag = [F.xxhash64("doc_id", "text").alias("tag1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("tag2")]
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", "text", *tag)

    def ask(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), [batch.column(k).to_pylist() for k in (2, 3)]
            rows, h = [], []
            for row, lines in split_lines(batch.column(1)):
                _, found = line_keys(lines, min_chars)
                if len(found):
                    h.append(np.unique(found, axis=0))
                    rows += [row] * len(h[-1])
            if rows:
                pairs = np.concatenate(h)
                n = len(rows)
                portion = (mix(np.asarray([tags[0][r] for r in rows], np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(pairs[:, 0], shards)), pa.array(portion.astype(np.int32)), *[pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], pa.array([ids[r] for r in rows], pa.int64()), *[pa.array([t[r] for r in rows], pa.int64()) for t in tags], pa.nulls(n, pa.binary())], names=[x.split()[0] for x in PROBE.split(", ")])

    def pack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([row["portions"]], pa.int32()), pa.array([pickle.dumps(row)], pa.binary())], names=["shard", "portions", "arrays"])

    def answer(batches):
        here, current = None, None
        for batch in batches:
            shard, portion, arrays = (batch.column(k).to_pylist() for k in (0, 1, 7))
            h1, h2, doc = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            keys = np.asarray(shard, np.int64) << 32 | np.asarray(portion, np.int64)
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)] if len(keys) else []
            keep = np.zeros(len(keys), bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if arrays[a] is not None:
                    here, current = Shard.load(pickle.loads(arrays[a])), int(keys[a])  # noqa: S301  our own bytes
                    a += 1
                if here is not None and current == int(keys[min(a, b - 1)]) and a < b:
                    keep[a:b] = here.drops(h1[a:b].view(np.uint64), h2[a:b].view(np.uint64), doc[a:b], min_docs)
            if keep.any():
                found = np.column_stack([h1[keep], h2[keep]])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(pa.array(keep)) for k in (4, 5, 6)], pa.array([x.tobytes() for x in found], pa.binary())], names=["doc", "tag1", "tag2", "h"])

    asked = work.save(base.mapInArrow(ask, PROBE), "asked")
    portions = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(PORTION)).cast("int").alias("portions"))
    sized = index.join(portions, "shard")
    small = F.broadcast(work.save(sized.select("shard", "portions"), "portions"))  # one row a shard
    probes = asked.join(small, "shard").withColumn("portion", F.pmod("portion", "portions")).drop("portions")
    heads = sized.mapInArrow(pack, "shard int, portions int, arrays binary")
    heads = heads.select("shard", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "doc", "tag1", "tag2")], "arrays")
    streams = probes.unionByName(heads).repartition("shard", "portion").sortWithinPartitions("shard", "portion", F.col("arrays").isNull())
    found = streams.select(*[x.split()[0] for x in PROBE.split(", ")]).mapInArrow(answer, "doc long, tag1 long, tag2 long, h binary")
    gone = work.save(found.groupBy("doc", "tag1", "tag2").agg(F.collect_set("h").alias("_gone")), "gone")  # lines of one document
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))
    named = docs.withColumns({"_doc": doc, "_tag1": F.xxhash64(doc, text), "_tag2": F.xxhash64(text, doc, F.lit(1))})
    return named.join(gone, (named["_doc"] == gone["doc"]) & (named["_tag1"] == gone["tag1"]) & (named["_tag2"] == gone["tag2"]), "left").select(*[docs[f"`{c}`"] for c in docs.columns], "_gone")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents whose text lost every repeated line except in the largest doc_id that holds it.

    A line's key is the line without ASCII white space at both ends, in ASCII lower case. Keys of at least ``min_chars``
    code points in at least ``min_docs`` documents (distinct doc_ids) are repeated. Adds n_lines and n_dropped, replacing
    columns of these names and of the name _gone; all others stay. A null or empty text is one empty line and comes back
    empty; rows of equal doc_id are one document, and all that hold the largest doc_id keep the line; a null doc_id
    counts as no document and never keeps a repeated line. An empty table gives no rows.

    The index has about KEY_BYTES a repeated line. Up to ``broadcast_bytes`` it is broadcast; a larger one stays dealt
    over tasks, and one pass sends it the hashes of all lines.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "linededup")
    if "_gone" in docs.columns:
        docs = docs.drop("_gone")
    repeated = work.save(repeated_lines(docs, min_chars, min_docs), "repeated")
    keys = repeated.count()
    shards = max(1, -(-keys // max(1, min(SHARD_KEYS, broadcast_bytes // KEY_BYTES))))
    # the unsigned remainder, as shard_of() takes it
    shard = F.expr(f"cast(pmod(pmod(shiftrightunsigned(h1, 1), {shards}L) * 2 + (h1 & 1), {shards}L) as int)")
    index = work.save(repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(build_shard, INDEX), "index")
    if keys * KEY_BYTES <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])

        def choose():
            gone = dropped_by_index(shared, shards, min_docs)
            return lambda _: gone

        return drop_lines(docs, min_chars, choose)

    def choose_answers():
        def start(batch):
            found = batch.column(batch.schema.names.index("_gone")).to_pylist()
            known = [None if x is None else {bytes(h) for h in x} for x in found]

            def gone(_: int, row: int, pairs: np.ndarray) -> np.ndarray:
                if known[row] is None:
                    return np.zeros(len(pairs), bool)
                return np.asarray([p.tobytes() in known[row] for p in pairs], bool)

            return gone

        return start

    return drop_lines(dealt_drops(docs, index, work, shards, min_chars, min_docs), min_chars, choose_answers)
