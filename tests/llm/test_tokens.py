import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stepforge.llm import kernels, packing, queries, tokens, tokenstore
from stepforge.llm.common import Workspace

EMPTY = "doc_id long, text string"
SCALE = "/root/testdata/sf0.001"
VOCABULARY = tokens.default_vocabulary()


LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids_by_hand(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["ab sS'tmdrelvA9 .\n\t\r  !çéßñ", "ab 's×’\x1f日\x00'll"])
def test_ids_are_the_library_s(letters):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 25))) for _ in range(1500)] + [None, "", "<|endoftext|> a"]
    encoder = tokens.Encoder(VOCABULARY)
    for a, b, data, offsets in kernels.slices(pa.array(texts), 400):
        ids, at = encoder.encode(data, offsets)
        for k in range(b - a):
            assert ids[at[k] : at[k + 1]].tolist() == ids_by_hand(texts[a + k]), repr(texts[a + k])


def test_added_tokens_are_the_untouched_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    texts = ["end of one.<|endoftext|>next", "plain words", "<|endoftext|>", "a <|endoftext", "|> b", "x<|endoftext|><|endoftext|> y", "é<|endoftext|>日", ""]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [437, 286, 530, 13, 50256, 19545]
    encoder = tokens.Encoder(VOCABULARY)
    for size in (10, 1 << 20):
        for a, b, data, offsets in kernels.slices(pa.array(texts), size):
            ids, at = encoder.encode(data, offsets)
            assert [ids[at[k] : at[k + 1]].tolist() for k in range(b - a)] == expected[a:b]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    for r in packing.pack_documents(df).collect():
        assert r["ids_crc32"] == zlib.crc32(np.asarray([*expected[r["doc_id"]], 0], "<u4").tobytes())
    work = Workspace(spark, "store")
    tokenstore.write(df, work.root, VOCABULARY)
    assert {r["doc_id"]: r["ids"] for r in tokenstore.reconstruct(spark, work.root).collect()} == {k: [*x, 2] for k, x in enumerate(expected)}
    assert {r["doc_id"]: r["start"] for r in tokenstore.read(spark, work.root).collect()} == {k: sum(len(x) + 1 for x in expected[:k]) for k in range(len(texts))}


def test_added_tokens_that_words_would_make(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.add_tokens([AddedToken("word other", normalized=False)])
    library.save(str(tmp_path / "v.json"))
    texts = ["one word", "an other", "a word other b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, at = tokens.Encoder(str(tmp_path / "v.json")).encode(data, np.cumsum([0, *map(len, texts)]))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(3)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "ENTRIES", 5)
    monkeypatch.setattr(tokens, "RECENT", 2)
    encoder = tokens.Encoder(VOCABULARY)
    for text in ("one two three four", "five six seven", "one two nine"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.asarray([0, len(data)]))[0].tolist() == ids_by_hand(text)


def fewest(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    for n in range(-(-sum(sizes) // capacity), len(sizes) + 1):
        room = [capacity] * n

        def place(k):
            if k == len(sizes):
                return True
            seen = set()
            for i in range(n):
                if room[i] >= sizes[k] and room[i] not in seen:
                    seen.add(room[i])
                    room[i] -= sizes[k]
                    if place(k + 1):
                        return True
                    room[i] += sizes[k]
            return False

        if place(0):
            return n
    return len(sizes)


def test_bin_completion_against_exhaustive_search():
    rnd = random.Random(3)
    better = 0
    for _ in range(120):
        capacity = rnd.choice([10, 20, 37])
        sizes = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 10))]
        counts = Counter(sizes)
        solution = packing.bin_completion(counts, capacity)
        used = Counter()
        for n, pattern in solution:
            assert sum(pattern) <= capacity
            for s in pattern:
                used[s] += n
        assert used == counts
        n, best = sum(n for n, _ in solution), fewest(sizes, capacity)
        assert packing.lower_bound(counts, capacity) <= best <= n <= best + (n > best) * 0
        better += n < sum(n for n, _ in packing.best_fit(counts, capacity))
    assert packing.bin_completion({}, 10) == []
    hard = Counter({27: 1, 23: 2, 22: 1, 19: 1, 18: 1, 17: 1, 16: 1, 13: 1, 12: 1, 10: 1})
    assert sum(n for n, _ in packing.bin_completion(hard, 50)) == 4


def fillings_by_hand(counts, left, waste):
    """All fillings in which no piece left out can take the place of smaller ones, or of none."""
    pieces = sorted(counts.elements(), reverse=True)
    every = {tuple(p for k, p in enumerate(pieces) if m >> k & 1) for m in range(1 << len(pieces))}
    every = {p for p in every if sum(p) <= left}

    def dominated(p):
        room, out = left - sum(p), counts - Counter(p)
        for x in out:
            small = [y for y in p if y < x]
            if any(x - room <= sum(y for k, y in enumerate(small) if m >> k & 1) <= x for m in range(1 << len(small))):
                return True
        return False

    return {p for p in every if left - sum(p) <= waste and not dominated(p)}


def test_completions_are_all_the_undominated_fillings():
    triple = Counter({4: 1, 6: 2, 8: 2})  # 6, 6, 4 fills as much as 8, 8, but no piece of 8 can replace any of it
    assert (6, 6, 4) in list(packing.completions(triple, 16, 0))
    rnd = random.Random(8)
    for _ in range(150):
        counts = Counter(rnd.randrange(1, 15) for _ in range(rnd.randrange(0, 9)))
        left, waste = rnd.randrange(0, 30), rnd.randrange(0, 8)
        found = [p for p in packing.completions(counts, left, waste) if p is not None]
        assert len(found) == len(set(found)) and set(found) == fillings_by_hand(counts, left, waste)


def test_large_counts_pack_in_few_steps():
    counts = {s: 10**9 + s for s in range(1, 2049, 7)}
    solution = packing.bin_completion(counts, 2048)
    assert sum(n for n, _ in solution) <= packing.lower_bound(counts, 2048) * 1.001
    assert sum(n * sum(p) for n, p in solution) == sum(s * n for s, n in counts.items())


def check_packing(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = ids_by_hand(text) + [0]
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // capacity)))
        at = 0
        for p in pieces:
            part = np.asarray(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids) and all(p["length"] == capacity for p in pieces[1:])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = queries.op1_best_fit_packing(spark, SCALE).collect()
    n = check_packing(rows, texts, 2048)
    assert n == packing.lower_bound(Counter(r["length"] for r in rows), 2048)


def test_packing_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a b " * 300, 4: "é\x00日" * 5}
    df = spark.createDataFrame(list(texts.items()), EMPTY).selectExpr("*", "1 as task", "2 as rank", "3 as length")
    check_packing(packing.pack_documents(df, capacity=50).collect(), texts, 50)
    assert packing.pack_documents(spark.createDataFrame([], EMPTY)).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(1, "x"), (1, "x")], EMPTY)).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_chunks_cover_and_survive_shifts():
    ids = np.random.default_rng(2).integers(0, 50000, 20000).astype(np.uint32)
    ends = tokenstore.cut(ids)
    assert ends[-1] == len(ids) and ends == sorted(set(ends))
    parts = lambda x: {x[a:b].tobytes() for a, b in zip([0, *tokenstore.cut(x)], tokenstore.cut(x), strict=False)}
    shifted = np.concatenate([ids[:100], np.asarray([7], np.uint32), ids[100:]])
    assert len(parts(ids) & parts(shifted)) > 0.8 * len(parts(ids))
    assert tokenstore.cut(ids[:0]) == [] and tokenstore.cut(ids[:3]) == [3]


def test_crc_join():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(0, 40)), rnd.randbytes(rnd.randrange(0, 5000))
        assert tokenstore.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "día", "日"]) for _ in range(rnd.randrange(0, 900))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(40, texts[3]), (41, None), (42, "")]
    work = Workspace(spark, "store")
    tokenstore.write(spark.createDataFrame(rows, EMPTY).repartition(5), work.root, VOCABULARY)
    got = {r["doc_id"]: r for r in tokenstore.read(spark, work.root).collect()}
    whole = {r["doc_id"]: r["ids"] for r in tokenstore.reconstruct(spark, work.root).collect()}
    at = 0
    for doc, text in rows:
        ids = [*ids_by_hand(text), 2]
        assert whole[doc] == ids
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    stored = spark.read.parquet(work.path("pieces")).filter("address is not null")
    assert stored.count() == stored.select("address").distinct().count()


def test_store_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got, at = {r["doc_id"]: r for r in queries.op6_token_store(spark, SCALE).collect()}, 0
    for r in docs:
        ids = np.asarray([*ids_by_hand(r["text"]), 2], "<u4")
        x = got.pop(r["doc_id"])
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_store_of_odd_rows(spark):
    """Equal doc_ids are documents of their own, very long texts make many chunks, clashing columns do no harm."""
    rows = [(5, "same"), (5, "same"), (None, "lost"), (1, "ab " * 400_000)]
    df = spark.createDataFrame(rows, EMPTY).selectExpr("*", "'x' chain", "0 n_tokens", "'y' address")
    out = tokenstore.round_trip(df, VOCABULARY).collect()
    count = lambda t: len(ids_by_hand(t)) + 1
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter({(5, count("same")): 2, (None, count("lost")): 1, (1, count(rows[3][1])): 1})
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_breaks_of_a_document_do_not_depend_on_the_one_before():
    rnd = np.random.default_rng(8)
    docs = [rnd.integers(0, 50000, n).astype(np.uint32) for n in (0, 1, 5, 127, 128, 3000, 9000)]
    joined, bounds = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    places = tokenstore.breaks(joined)
    for d, a, b in zip(docs, bounds, bounds[1:], strict=False):
        assert tokenstore.ends_of((places[(places > a) & (places <= b)] - a).tolist(), len(d)) == tokenstore.cut(d)


def test_store_tells_damage(spark):
    work = Workspace(spark, "store")
    tokenstore.write(spark.createDataFrame([(1, "a b c"), (2, "d e f")], EMPTY), work.root, VOCABULARY)
    recipes = tokenstore.read_recipes(spark, work.root).collect()
    broken = spark.createDataFrame([(*r[:1], r["n_tokens"] + 1, *r[2:]) for r in recipes], tokenstore.read_recipes(spark, work.root).schema)
    broken.write.mode("overwrite").parquet(work.path("recipes"))
    with pytest.raises(ValueError):
        tokenstore.read(spark, work.root)


def test_store_of_nothing(spark):
    assert tokenstore.round_trip(spark.createDataFrame([], EMPTY)).count() == 0
