"""Benchmark decontamination, with DataFrame functions alone.

1. Words are lower-cased runs of letters and digits; a shingle is five consecutive words (all words of an item with fewer).
2. A window of an item's size that is similar enough must hold a certain number of the item's shingles. Shingle hashes
   of all documents are joined with those of the benchmark, and only windows with that many hits go on: none that
   could be similar enough is lost.
3. Windows and items get 64-bit SimHash fingerprints. Fingerprints are cut into eight blocks; two within radius 23 agree
   in some block up to two bits, so items are indexed under every block value within two bits (multi-index hashing)
   and windows look up their own block values: all pairs within the radius are found.
4. Pairs within the radius are verified by the weighted Jaccard similarity of their shingle counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SHINGLE = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
LANE_BITS = 16
#: Largest benchmark side, in rows of about 40 bytes, that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of the runs of k words, in order."""
    run = lambda x, i: F.xxhash64(x, *[F.get(words, i + d) for d in range(1, k)])
    return F.slice(F.transform(words, run), 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def fingerprint(hashes: Column, lane: int = LANE_BITS) -> Column:
    """SimHash: bit b is set if more than half of the hashes (repeats count) have it.

    Counts are kept in lanes of 16 bits, or of 32 bits where there are 65,536 hashes or more.
    """
    lanes, zero = F.lit(sum(1 << k for k in range(0, 64, lane))), F.lit(0).cast("long")
    sums = F.transform(F.sequence(F.lit(0), F.lit(lane - 1)), lambda r: F.aggregate(hashes, zero, lambda a, h: a + shifted(h, r).bitwiseAND(lanes)))

    def bits(s: Column) -> Column:
        # bit b is counted in lane b // lane of the sum for b % lane
        count = lambda b: shifted(F.get(s, b % lane), (b - b % lane)).bitwiseAND(F.lit((1 << lane) - 1))
        one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda out, b: out.bitwiseOR(F.when(2 * count(b) > F.size(hashes), one(b)).otherwise(zero)))

    return bind(sums, bits)


def blocks(value: Column, near: bool) -> Column:
    """(block number b, value v) of each block; near: every value within two bits as well."""
    masks = [0]
    if near:
        masks += [sum(1 << b for b in bits) for n in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]
    own = lambda k: shifted(value, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    each = lambda k: F.transform(F.lit(masks), lambda m: F.struct(k.alias("b"), own(k).bitwiseXOR(m.cast("long")).alias("v")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), each))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes, each with its number of occurrences.

    Distinct hashes are intersected as sets; what an array holds beyond the first of each hash, in natural text little,
    is then compared in the same way, and only what occurs three times or more is counted hash by hash.
    """
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    counted = lambda x, y: F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, v: n + F.least(times(x, v), times(y, v)))

    def again(x: Column) -> Column:
        """Every hash once less than it occurs."""
        none = F.slice(x, 1, 0)
        spare = lambda s: F.filter(s, lambda v, i: F.coalesce(F.get(s, i - 1) == v, F.lit(False)))
        return F.when(F.size(F.array_distinct(x)) == F.size(x), none).otherwise(bind(F.array_sort(x), spare))

    def shared(x: Column, y: Column, depth: int) -> Column:
        if not depth:
            return counted(x, y)
        rest = bind(F.struct(again(x).alias("x"), again(y).alias("y")), lambda r: F.when((F.size(r["x"]) == 0) | (F.size(r["y"]) == 0), F.lit(0)).otherwise(shared(r["x"], r["y"], depth - 1)))
        return F.size(F.array_intersect(x, y)) + rest

    return bind(shared(a, b, 2), lambda n: n / (F.size(a) + F.size(b) - n))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k (words a shingle), m (shingles) and hashes; items without words are left out."""
    words = benchmark.select("item_id", F.explode(F.array(tokens(F.col("text")))).alias("words")).filter(F.size("words") > 0)
    hashes = F.coalesce(*[F.when(F.least(F.size("words"), F.lit(SHINGLE)) == k, shingles(F.col("words"), k)) for k in range(1, SHINGLE + 1)])
    return words.select("item_id", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), hashes.alias("hashes")).withColumn("m", F.size("hashes"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, start (word of the most similar window; least on ties) and similarity of every leaked item.

    A document leaks an item if some window with the item's number of words (the whole document, if that is shorter)
    has a weighted shingle similarity of ``percent`` / 100 at least, and its fingerprint is within RADIUS of the item's
    (at similarity 0.8 the expected distance is 10 with deviation 3). Null texts have no words; equal rows of either
    table give one row a pair of ids; empty tables give no rows; other columns are ignored. Items and texts may have any
    length; windows of one item overlap in all but the first and the last tenth at most, so a leaked item of n words
    costs up to about n / 5 windows of n words.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    items = work.save(benchmark_items(benchmark.select(F.col("item_id").cast("long"), "text")), "items")
    most, sizes = items.agg(F.max("m"), F.collect_set("k")).first()
    lane = LANE_BITS if (most or 0) < 1 << LANE_BITS else 32
    # distinct hashes of an item; need: hits that a window of m shingles must have
    need = F.ceil(2 * F.col("m") * percent / (100 + percent)).cast("int")
    wanted = items.select("item_id", "n", "k", "m", need.alias("need"), F.explode(F.array_distinct("hashes")).alias("h"))
    small = wanted.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda df: df

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(tokens(F.col("text")))).alias("words"))
    found = None
    for k in sorted(sizes or []):
        runs = texts.select("doc_id", F.size("words").alias("n_doc"), F.posexplode(shingles(F.col("words"), k)).alias("p", "h"))
        hits = runs.join(hint(wanted.filter(F.col("k") == k)), "h").select("doc_id", "n_doc", "item_id", "n", "k", "m", "need", "p")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.sql("select cast(null as long) doc_id, cast(null as long) item_id, 0 start, 0D similarity where false")

    # shorter documents make one window; theirs have fewer shingles, and need as large a share of the item's
    pairs = found.groupBy("doc_id", "item_id", "n_doc", "n", "k", "m", "need").agg(F.array_sort(F.collect_set("p")).alias("at"))
    short = F.col("n_doc") < F.col("n")
    need_here = F.when(short, F.ceil(F.col("m") * percent / 100).cast("int")).otherwise(F.col("need"))
    pairs = pairs.withColumn("need", need_here).filter(F.size("at") >= F.col("need"))
    dense = F.filter(F.transform("at", lambda p, i: F.when(F.get(F.col("at"), i + F.col("need") - 1) - p < F.col("m"), p)), lambda p: p.isNotNull())
    first = lambda p: F.greatest(p - (F.col("m") - F.col("need")), F.lit(0))
    last = lambda p: F.least(p, F.col("n_doc") - F.col("n"))

    def reach(places: Column) -> Column:
        """All starts that a place permits; first() and last() rise with it, so each place adds those beyond the one before."""
        begin = lambda p, i: F.greatest(F.least(first(p), last(p)), F.when(i > 0, last(F.get(places, i - 1)) + 1).otherwise(F.lit(0)))
        return F.flatten(F.transform(places, lambda p, i: F.when(begin(p, i) <= last(p), F.sequence(begin(p, i), last(p))).otherwise(F.slice(places, 1, 0))))

    pairs = pairs.withColumn("starts", F.when(short, F.array(F.lit(0))).otherwise(bind(dense, reach))).filter(F.size("starts") > 0)
    candidates = work.save(pairs.groupBy("doc_id", "k", "n").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts")), "candidates")

    window = F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice(F.col("words"), s + 1, F.col("n")).alias("w"))))
    windows = candidates.join(texts, "doc_id").select("doc_id", "k", "n", window.alias("x")).select("doc_id", "k", "n", "x.start", "x.w")
    by_size = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("w"), k)) for k in sorted(sizes)])
    windows = windows.select("doc_id", "n", "k", "start", F.explode(F.array(by_size)).alias("hashes")).filter(F.size("hashes") > 0)
    windows = work.save(windows.withColumn("print", fingerprint(F.col("hashes"), lane)), "windows")

    prints = items.withColumn("print", fingerprint(F.col("hashes"), lane))
    index = prints.select("item_id", "n", "k", F.col("print").alias("item_print"), F.explode(blocks(F.col("print"), True)).alias("x")).select("item_id", "n", "k", "item_print", "x.b", "x.v")
    index_rows = items.count() * BLOCKS * 37
    hint_index = F.broadcast if index_rows <= BROADCAST_ROWS else lambda df: df
    keyed = windows.select("doc_id", "n", "k", "start", "print", F.explode(blocks(F.col("print"), False)).alias("x")).select("doc_id", "n", "k", "start", "print", "x.b", "x.v")
    near = keyed.join(hint_index(index), ["n", "k", "b", "v"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("doc_id", "item_id", "n", "k", "start").distinct()
    checked = near.join(windows.select("doc_id", "n", "k", "start", "hashes"), ["doc_id", "n", "k", "start"]).join(hint(items.select("item_id", F.col("hashes").alias("item_hashes"))), "item_id")
    scored = checked.select("doc_id", "item_id", "start", similarity(F.col("hashes"), F.col("item_hashes")).alias("similarity"))
    scored = scored.filter(F.col("similarity") * 100 >= percent - 1e-9)
    best = F.max_by(F.struct("similarity", "start"), F.struct(F.col("similarity"), -F.col("start")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.start", "x.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that leak no item, with all their columns; a document without doc_id stays."""
    bad = leaks(docs, benchmark, percent).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_leaked"], "left_anti")
