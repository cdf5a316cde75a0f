import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepforge.llm import common, components, jaccard, linededup, phrases, queries, suffixes
from stepforge.llm.common import Workspace

EMPTY = "doc_id long, text string"
SCALE = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, EMPTY)


def patched(seed, alphabet, n=120, lone="xyz"):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50, 300))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rnd.randrange(0, 5)):
            x = rnd.choice(base)
            a = rnd.randrange(len(x))
            t += x[a : rnd.randrange(a, len(x) + 1)] + rnd.choice(lone) * rnd.randrange(3)
        out.append(t or rnd.choice([None, ""]))
    return out


# ---- line dedup ----
def lines_by_hand(rows, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    key = lambda x: x.encode().strip(linededup.BLANKS).lower().decode()
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(d)
    out = []
    for d, t in rows:
        kept = [x for x in (t or "").split("\n") if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        n = len((t or "").split("\n"))
        out.append((d, n, n - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows(seed, n=60):
    rnd = random.Random(seed)
    pool = ["Line %02d " % i + "é" * rnd.randrange(20, 60) for i in range(30)]
    return [(i, None if i == 3 else "\n".join(rnd.choice(["  ", "", "\t"]) + (x.upper().replace("É", "é") if rnd.random() < 0.3 else x) for x in rnd.choices(pool, k=rnd.randrange(0, 9)))) for i in range(n)]


@pytest.mark.parametrize(("limit", "portion"), [(linededup.BROADCAST_BYTES, 0), (100, linededup.PORTION), (60, 3)])
def test_lines(spark, monkeypatch, limit, portion):
    monkeypatch.setattr(linededup, "PORTION", portion or linededup.PORTION)
    rows = line_rows(1)
    got = linededup.dedup_lines(frame(spark, rows), broadcast_bytes=limit).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == lines_by_hand(rows)
    assert sum(r["n_dropped"] for r in got) > 0


@pytest.mark.parametrize("limit", [linededup.BROADCAST_BYTES, 60])
def test_lines_of_repeated_and_missing_ids(spark, limit):
    """Documents are distinct doc_ids: four of them, one with two rows, drop nothing."""
    four, five = "four documents hold this line, one of them twice", "five documents hold this line, one of them twice"
    rows = [(k, four) for k in (1, 2, 3, 4, 4)] + [(k, five + "\n" + five) for k in (1, 2, 3, 4, 5, 5)] + [(None, five), (9, "x" * 200_000 + "\n" + five)]
    out = linededup.dedup_lines(frame(spark, rows).withColumns({"_lines0": F.lit("a"), "_dropped0": F.lit("b"), "_gone": F.lit("c"), "shard": F.lit("d"), "tag1": F.lit("e")}), broadcast_bytes=limit).collect()
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"]) for r in out)
    singles = [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 1, 0)]
    assert got == sorted([*singles, (0, 1, 1), *[(k, 2, 2) for k in (1, 2, 3, 4, 5, 5)], (9, 2, 0)])
    assert {r["_lines0"] for r in out} == {"a"} and {r["_dropped0"] for r in out} == {"b"}


def test_a_line_of_very_many_documents_costs_few_rows(spark):
    line = "a license line that very many of the documents hold"
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array([line] * 5000)], names=["doc_id", "text"])
    sent = [np.frombuffer(x, linededup.TRIPLE) for b in linededup.send_hashes([batch], 40, 5, 8) for x in b.column(1).to_pylist()]
    assert sorted(np.concatenate(sent)["doc"].tolist()) == [0, 1, 2, 3, 4, 4999]


def test_lines_other_columns_and_no_rows(spark):
    df = frame(spark, [(1, "a"), (None, "b")]).withColumns({"n_lines": F.lit("clash"), "h1": F.lit(1)})
    out = linededup.dedup_lines(df)
    assert out.count() == 2 and dict(out.dtypes)["n_lines"] == "bigint" and "h1" in out.columns
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64))
    h = linededup.PerfectHash(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    # two keys that share h1 are told apart
    h1, h2 = np.sort(np.append(keys, keys[:3])), None
    h2 = h1 ^ np.uint64(5)
    h2[1:][h1[1:] == h1[:-1]] += np.uint64(99)
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    full = linededup.Shard(h1, h2)
    doc = np.arange(len(h1)) * 2
    full.fill(h1, h2, doc)
    full.fill(h1[::2], h2[::2], doc[::2] - 1)
    for shard in (full, linededup.Shard.load(full.dump())):
        at = shard.slots(h1, h2)
        assert sorted(at) == list(range(len(h1))) and (shard.keeper[at] == doc).all()
        assert (shard.count[at] == 1 + (np.arange(len(h1)) % 2 == 0)).all()
        assert (shard.slots(h1, h2 ^ np.uint64(1 << 40)) == -1).all()
        assert shard.drops(h1, h2, doc, 1).sum() == 0 and shard.drops(h1, h2, doc + 1, 2).sum() == (len(h1) + 1) // 2


# ---- repeated byte strings ----
def bytes_by_hand(texts, w):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + w] for b in raw for i in range(len(b) - w + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if times[b[i : i + w]] > 1:
                gone[i : i + w] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return Counter(out)


@pytest.mark.parametrize(("window", "hot"), [(64, suffixes.HOT_CORE), (70, 1), (110, suffixes.HOT_CORE)])
def test_substrings(spark, window, hot):
    texts = patched(window, "abcdeé \n")
    out = suffixes.dedup_substrings(frame(spark, [(i % 110 if i % 11 else None, t) for i, t in enumerate(texts)]), window, hot).collect()
    want = bytes_by_hand(texts, window)
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out) == want
    assert sum(x[1] for x in want.elements()) > 0


def test_substrings_and_phrases_of_long_texts_and_clashing_columns(spark):
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, "own start " + " ".join(words[5000:90_000]) + " own end"), (3, None), (3, "short"), (3, "short")]
    df = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("tag", "doc", "m", "kept", "n_bytes", "s")})
    out = suffixes.dedup_substrings(df).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out) == bytes_by_hand([t for _, t in rows], 200)
    out = phrases.dedup_phrases(df).collect()
    assert Counter((r["n_words"], r["n_removed"], r["kept"]) for r in out) == words_by_hand(rows, 13)
    assert phrases.dedup_phrases(frame(spark, [])).count() == 0


def test_substrings_of_nothing_and_of_one_text(spark):
    assert suffixes.dedup_substrings(frame(spark, [])).count() == 0
    r = suffixes.dedup_substrings(frame(spark, [(1, "a" * 500)])).first()
    assert (r["n_removed"], r["n_spans"]) == (500, 1)
    assert {x["n_removed"] for x in suffixes.dedup_substrings(frame(spark, [(1, "b" + "ab" * 150), (1, "b" + "ab" * 150)])).collect()} == {301}


def test_suffix_sort():
    rnd = random.Random(5)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12))) for _ in range(40)]
    width = max(map(len, strings))
    table = np.zeros((len(strings), width), np.int32)
    for k, s in enumerate(strings):
        table[k, width - len(s) :] = [ord(c) for c in s]
    string, size, lcp = suffixes.multi_string_sort(table, np.asarray([len(s) for s in strings]), 6)
    got = [strings[k][len(strings[k]) - n :] for k, n in zip(string, size, strict=True)]
    assert got == sorted(s[i:] for s in strings for i in range(len(s) + 1))
    for a, b, n in zip(got, got[1:], lcp[1:], strict=False):
        common = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert n == min(common, 6)


# ---- repeated phrases ----
def words_by_hand(rows, w):
    least = {}
    parts = [(-(1 << 63) if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, x in parts:
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, x in parts:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if least[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        out.append((len(x), sum(gone), b" ".join(a for a, b in zip(x, gone, strict=True) if not b).decode()))
    return Counter(out)


@pytest.mark.parametrize(("window", "hot"), [(6, phrases.HOT_ANCHOR), (9, 1), (13, phrases.HOT_ANCHOR)])
def test_phrases(spark, window, hot):
    rows = [(i % 100 if i % 13 else None, t and " ".join(t)) for i, t in enumerate(patched(window, "abcé", lone=["\n", "q", "\t"]))]
    out = phrases.dedup_phrases(frame(spark, rows), window, hot).collect()
    want = words_by_hand(rows, window)
    assert Counter((r["n_words"], r["n_removed"], r["kept"]) for r in out) == want
    assert sum(x[1] for x in want.elements()) > 0


# ---- Jaccard ----
def links_by_hand(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("width", "percent", "hot"), [(3, 90, jaccard.HOT_KEY), (3, 90, 2), (5, 80, jaccard.HOT_KEY), (2, 60, 3)])
def test_links(spark, monkeypatch, width, percent, hot):
    monkeypatch.setattr(jaccard, "HOT_KEY", hot)
    if hot < jaccard.BLOCK // 100:
        monkeypatch.setattr(jaccard, "BLOCK", 4)  # many blocks and cells
    rnd = random.Random(width)
    rows = []
    for i in range(150):
        if i < 8 or rnd.random() < 0.2:
            words = [rnd.choice("abcdefgh") + str(rnd.randrange(12)) for _ in range(rnd.randrange(0, 90))]
        else:
            words = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randrange(0, 4)):
                if words:
                    words[rnd.randrange(len(words))] = "n" + str(rnd.randrange(30))
            if rnd.random() < 0.3:
                words = [w.upper() for w in words]
        rows.append((1000 - i, " ".join(words) or rnd.choice([None, " \n"])))
    got = {tuple(r) for r in jaccard.link(frame(spark, rows), width, percent).collect()}
    want = links_by_hand(rows, width, percent)
    assert got == want
    assert len({c for _, _, c in want}) < len(want)


def test_links_of_nothing_and_repeated_rows(spark):
    assert jaccard.link(frame(spark, [])).count() == 0
    rows = jaccard.link(frame(spark, [(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (7, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"]) == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (7, 0, 7)]


def test_many_sets_of_one_size_under_one_key(spark, monkeypatch):
    """Distinct sets of one size that share shingles spread over cells of at most two blocks, and no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(k, f"{shared} " + " ".join(f"u{k}x{j}" for j in range(8))) for k in range(700)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 700, 50)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.link(frame(spark, rows), 3, 90).collect()}
    assert got == {(d, d) for d, _ in rows[:700]} | {(1000 + k, k) for k in range(0, 700, 50)}


def test_links_ignore_other_columns_and_take_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(150_000))
    df = frame(spark, [(1, text), (2, text + " more"), (3, "w1 w2 w3")]).withColumns({c: F.lit("clash") for c in ("n", "key", "band", "label", "component_id", "a")})
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df).collect()} == {(1, 149_998, 1), (2, 149_999, 1), (3, 1, 3)}


def test_components_that_do_not_settle(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(path, Workspace(spark, "test"), rounds=2)
    assert {r["component"] for r in components.components(path, Workspace(spark, "test")).collect()} == {0}


def test_contracted_edges_have_the_same_components(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (330, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    least = {x: x for e in edges for x in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    table = Workspace(spark, "test").save(spark.createDataFrame(edges, "a long, b long").repartition(5), "edges")
    assert {tuple(r) for r in components.contracted(table).collect()} == {x for x in least.items() if x[0] != x[1]}
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 50)
    found = components.components(components.contracted(table), Workspace(spark, "test")).collect()
    assert {(r["node"], r["component"]) for r in found} == {x for x in least.items() if x[1] in {m for n, m in least.items() if n != m}}


def test_saving_a_table_gives_native_memory_back(spark, monkeypatch):
    common.trim(spark)  # without an error
    called = []
    monkeypatch.setattr(common, "trim", called.append)
    Workspace(spark, "test").save(spark.range(3).toDF("id"), "t")
    assert called == [spark]


def test_tree_finds_all_that_bounds_permit():
    rnd = np.random.default_rng(1)
    vectors = rnd.integers(0, 9, (300, jaccard.GROUPS)).astype(np.int32)
    vectors = vectors[np.argsort(vectors.sum(axis=1))]
    sizes, labels = vectors.sum(axis=1).astype(np.int64), rnd.integers(0, 200, 300)
    got = {(int(a), int(b)) for i, j in jaccard.tree_pairs(vectors, sizes, labels, 50) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if labels[a] != labels[b] and 100 * sizes[a] >= 50 * sizes[b] and np.minimum(vectors[a], vectors[b]).sum() >= jaccard.need(sizes[a], sizes[b], 50)}
    assert got == want and want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    from oracle import same

    same(spark, name, queries.QUERIES[name], queries.ORACLES[name], SCALE)


def test_queries_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SCALE}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_suffix_dedup(spark, SCALE).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((*x[:3], sha(x[3])) for x in bytes_by_hand([t for _, t in rows], 200).elements())
    assert {tuple(r) for r in queries.op10_ngram_jaccard(spark, SCALE).collect()} == links_by_hand(rows, 3, 90)
