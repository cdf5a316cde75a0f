"""Content-addressed store of token ids: content-defined chunks, document recipes, Merkle manifests.

Layout below one folder, all Parquet written by Spark:
  pieces/    chunk rows (address, n, data: ids as little-endian unsigned 16 or 32 bit), each address once, and the
             recipe of each document (addresses of its chunks in order)
  recipes/   the recipes in ascending doc_id order, with start (ids of all documents before) and their Merkle root
  manifest/  for each part of recipes an order-bound digest over the Merkle roots of its documents
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Workspace
from .kernels import mix, slices

WINDOW, MASK, SHORTEST, LONGEST = 8, 511, 128, 4096
FACTOR = 0x9E3779B97F4A7C15
DIGEST = 16
#: Addresses that a writing task remembers so as to send each chunk's bytes once; the store drops the rest.
SEEN = 200_000


def breaks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where the rolling hash of the last WINDOW ids has its low bits clear.

    Ids of several documents may follow one another: no chunk ends within SHORTEST ids of a document's start, so what
    the window holds of the document before decides nothing.
    """
    h, factor, width = ids.astype(np.uint64), FACTOR, 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[: max(0, len(h) - width)] * np.uint64(factor)
        h, factor, width = longer, factor * factor % (1 << 64), 2 * width
    return np.flatnonzero((mix(h) & np.uint64(MASK)) == 0) + 1


def ends_of(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of n ids with these breaks."""
    ends, last = [], 0
    for at in [*places, n]:
        if at > n:
            break
        while at - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if at - last >= SHORTEST or at == n and at > last:
            last = at
            ends.append(at)
    return ends


def cut(ids: np.ndarray) -> list[int]:
    """Ends of content-defined chunks of one document."""
    return ends_of(breaks(ids).tolist(), len(ids))


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is. No leaves: the digest of nothing."""
    if not leaves:
        return address(b"")
    level = [address(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [address(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def payload(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else ids.astype("<u4").tobytes()


def ids_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def encode(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Chunk rows (data of addresses new to the task) and one recipe row a document, with a key that spreads both."""

    def run(batches):
        encoder, seen, end = tokens.encoder(vocabulary), set(), np.uint32(end_id)
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column(1), 1 << 20):
                rows = []
                found, bounds = encoder.encode(raw, offsets)
                ids = np.insert(found, bounds[1:], end)
                bounds = bounds + np.arange(len(bounds))
                places = breaks(ids)
                first = np.searchsorted(places, bounds, "right").tolist()
                narrow = ids.astype("<u2").tobytes() if ids.max() < 65536 else None
                for k, doc in enumerate(batch.column(0)[a:b].to_pylist()):
                    base, n = int(bounds[k]), int(bounds[k + 1] - bounds[k])
                    chain, at = [], 0
                    for to in ends_of((places[first[k] : first[k + 1]] - base).tolist(), n):
                        part = payload(ids[base + at : base + to]) if narrow is None else narrow[2 * (base + at) : 2 * (base + to)]
                        chain.append(name := address(part))
                        if name not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(name)
                            rows.append((name, to - at, part, None, None, int.from_bytes(name[:6], "big")))
                        at = to
                    rows.append((None, n, None, doc, b"".join(chain), int.from_bytes(address(repr(doc).encode())[:6], "big")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["address", "n", "data", "doc_id", "chain", "route"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "address binary, n long, data binary, doc_id long, chain binary, route long")


def drop_repeats(batches):
    """Keeps the first chunk row of each address; rows come sorted by address, recipes (null address) stay all."""
    last = None
    for batch in batches:
        keep = []
        for name in batch.column(0).to_pylist():
            keep.append(name is None or name != last)
            last = name
        yield batch.filter(pa.array(keep))


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> None:
    """Writes the store for documents (doc_id, text) into folder.

    A null or empty text has the end id alone. Rows of equal doc_id are documents of their own, in any order. An empty
    table gives an empty store. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = encode(docs, vocabulary, end_id).repartition("route").sortWithinPartitions("address")
    schema = pieces.drop("route").schema
    pieces.drop("route").mapInArrow(drop_repeats, schema).write.option("compression", "zstd").parquet(f"{folder}/pieces")

    def place(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            roots = [merkle([c[k : k + DIGEST] for k in range(0, len(c), DIGEST)]) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(starts), pa.array([part] * len(n), pa.int32()), pa.array(roots, pa.binary())], names=["doc_id", "n_tokens", "chain", "within", "part", "root"])

    stored = spark.read.schema(schema).parquet(f"{folder}/pieces").filter("address is null")
    ordered = stored.select("doc_id", F.col("n").alias("n_tokens"), "chain").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(place, "doc_id long, n_tokens long, chain binary, within long, part int, root binary").write.parquet(f"{folder}/recipes")

    recipes = read_recipes(spark, folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.hex(part_root()).alias("root"))
    sums.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")


def part_root():
    """Order-bound digest of a part's document roots: each is hashed with its place, and the digests are summed.

    Sums combine before the shuffle, so no task gathers a part's roots.
    """
    digest = F.sha2(F.concat(F.col("root"), F.encode(F.concat_ws("|", "doc_id", "within", "n_tokens"), "utf-8")), 256)
    lane = lambda k: F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")
    return F.encode(F.concat_ws(",", *[F.sum(lane(k)).cast("string") for k in range(5)]), "utf-8")


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, chain binary, within long, part int, root binary").parquet(f"{folder}/recipes")


MANIFEST = "part int, n_tokens long, n_docs long, root string, start long"
POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (POLY if b & 1 else 0)
    return out


_shift: dict[int, int] = {}


def crc_join(first: int, second: int, length: int) -> int:
    """CRC-32 of a concatenation from the CRCs of its halves and the byte length of the second."""
    if not first:  # nothing before it, as for the first chunk of a document
        return second
    if length not in _shift:
        if len(_shift) > 100_000:
            _shift.clear()
        power, square, n = 0x80000000, 0x00800000, length  # x**0, x**8
        while n:
            if n & 1:
                power = _times(power, square)
            square, n = _times(square, square), n >> 1
        _shift[length] = power
    return _times(_shift[length], first) ^ second


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Reads every stored chunk, recomputes its address from its bytes, and gives address, n and the CRC of its ids."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if address(data) != name:
                    raise ValueError("a stored chunk does not match its address")
                rows.append((name, n, zlib.crc32(ids_of(data, n).tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["address", "n", "crc"])

    stored = spark.read.schema("address binary, n long, data binary").parquet(f"{folder}/pieces").filter("address is not null")
    return stored.mapInArrow(run, "address binary, n long, crc long")


def links(spark: SparkSession, folder: str) -> DataFrame:
    """One row a chunk of a document: part, within, doc_id, n_tokens, root, k and address."""
    pieces = F.expr(f"transform(sequence(0, cast(length(chain) / {DIGEST} as int) - 1), k -> struct(k, substring(chain, k * {DIGEST} + 1, {DIGEST}) as address))")
    return read_recipes(spark, folder).filter("length(chain) > 0").select("part", "within", "doc_id", "n_tokens", "root", F.explode(pieces).alias("c")).select("part", "within", "doc_id", "n_tokens", "root", "c.k", "c.address")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    Every chunk's bytes are read once and checked against their address; a document's Merkle root is rebuilt from the
    addresses of the chunks found, and its CRC is put together from theirs, so no chunk is sent to its documents. The
    manifest's part digests are checked as well. A mismatch or a missing chunk raises an error.
    """

    def fold(batches):
        for batch in batches:
            out = []
            for doc, start, n, root, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.sort(key=lambda x: x["k"])
                if merkle([x["address"] for x in found]) != root or sum(x["n"] for x in found) != n:
                    raise ValueError(f"document {doc} does not match its manifest")
                crc = 0
                for x in found:
                    crc = crc_join(crc, x["crc"], 4 * x["n"])
                out.append((doc, start, n, crc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    again = read_recipes(spark, folder).groupBy("part").agg(F.hex(part_root()).alias("again"))
    bad = manifest.join(again, "part", "full").filter("not (root <=> again)").limit(1).count()
    if bad:
        raise ValueError("the recipes do not match the manifest")
    verified = links(spark, folder).join(chunks(spark, folder), "address")
    grouped = verified.groupBy("part", "within", "doc_id", "n_tokens", "root").agg(F.collect_list(F.struct("k", "address", "n", "crc")).alias("found"))
    starts = F.broadcast(manifest.select("part", F.col("start").alias("base")))  # one row a part
    return grouped.join(starts, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "root", "found").mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array of int) of every document, put together from the stored chunks."""

    def fold(batches):
        for batch in batches:
            ids = [np.concatenate([ids_of(x["data"], x["n"]) for x in sorted(found, key=lambda x: x["k"])]).astype(np.int32) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    stored = spark.read.schema("address binary, n long, data binary").parquet(f"{folder}/pieces").filter("address is not null")
    joined = links(spark, folder).join(stored, "address").groupBy("part", "within", "doc_id").agg(F.collect_list(F.struct("k", "n", "data")).alias("found"))
    return joined.select("doc_id", "found").mapInArrow(fold, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """write() to the shared folder, then read()."""
    work = Workspace(docs.sparkSession, "tokenstore")
    write(docs, work.root, vocabulary or tokens.default_vocabulary(), end_id)
    return read(docs.sparkSession, work.root)
