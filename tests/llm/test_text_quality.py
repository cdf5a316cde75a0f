import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stepforge.llm import chat, decontaminate, langid, quality, queries

EMPTY = "doc_id long, text string"
SCALE = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, EMPTY)


# ---- chat ----
EVENTS = "conv_id long, seq long, kind string, turn long, copy int, role string, text string"


def read_back(spark, events):
    out = chat.parse(chat.render(chat.final_messages(spark.createDataFrame(events, EVENTS))))
    return {r["conv_id"]: r for r in out.collect()}


def test_events_fold_into_messages(spark):
    odd = "\\### Assistant: </turn> <turn:user> \\s\\l\\\\g > end\n"
    events = [
        (1, 0, "message", 0, 1, "user", odd), (1, 1, "message", 1, 1, "assistant", ""), (1, 2, "delta", 1, 1, None, "Hel"), (1, 3, "delta", 1, 1, None, "lo"),
        (1, 4, "regenerate", 1, 1, None, ""), (1, 6, "delta", 1, 1, None, " " + odd), (1, 5, "delta", 1, 1, None, "New"), (1, 7, "edit", 0, 1, None, "edited " + odd),
        (2, 0, "delta", 0, 1, None, None), (2, 1, "unheard of", 1, 1, "ass<is>\\tant", None), (3, 0, "delta", 0, 1, "assistant", "a"), (3, 1, "delta", 0, 1, None, "b"),
    ]
    got = read_back(spark, events)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "edited " + odd), ("assistant", "New " + odd)]
    assert got[1]["loss_text"] == "New " + odd
    assert [tuple(t) for t in got[2]["turns"]] == [("", ""), ("ass<is>\\tant", "")] and got[2]["loss_text"] == ""
    assert [tuple(t) for t in got[3]["turns"]] == [("assistant", "ab")]
    assert read_back(spark, []) == {}


def test_escapes_are_reversible(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("\\<>slg/turn:\n é") for _ in range(rnd.randrange(0, 30))) for _ in range(300)]
    events = [(i, 0, "message", 0, 1, "assistant", t) for i, t in enumerate(texts)]
    got = read_back(spark, events)
    assert all(got[i]["turns"][0]["text"] == t == got[i]["loss_text"] for i, t in enumerate(texts))
    assert all(len(t) <= got[i]["formatted_chars"] for i, t in enumerate(texts))


def test_rows_that_share_a_turn(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = chat.digest(chat.parse(chat.render(chat.final_messages(chat.message_events(df))))).collect()
    assert sorted((r["conv_id"] or -1, r["n_turns"], r["loss_chars"]) for r in got) == [(-1, 1, 1), (1, 3, 0)]


# ---- quality ----
def counts_by_hand(text):
    w = [x.decode() for x in (text or "").encode().split()]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b", "é日", "#", "|", " ", "  ", "\n", "\t", "\x0b", "\u00a0"]) for _ in range(rnd.randrange(0, 200))) for _ in range(150)] + [None, "", " \n", "x " * 30000]
    got = quality.counts(frame(spark, list(enumerate(texts)))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: counts_by_hand(t) for i, t in enumerate(texts)}


def test_junk_goes_and_clean_text_stays(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SCALE}/labels.parquet").collect()}
    rows = queries.op8_quality_rules(spark, SCALE).collect()
    assert len(rows) == spark.read.parquet(f"{SCALE}/documents.parquet").count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    known = [r for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    wrong = [r for r in known if r["kept"] != bool(labels[r["doc_id"]])]
    assert len(wrong) <= 0.01 * len(known)


def test_em_by_hand():
    share, rates, posterior = quality.estimate({"gg": 900, "bg": 50, "bb": 30, "--": 20})
    assert posterior["gg"] > 0.9 and posterior["bb"] < 0.01 and 0.5 < share < 1
    assert all(r <= quality.FALSE_ALARM for r in rates["good"])
    assert quality.estimate({}) == (0.5, {}, {})


def test_quality_of_nothing(spark):
    assert quality.judge(frame(spark, [])).count() == 0
    assert quality.judge(frame(spark, [(1, None), (1, None)])).filter("kept").count() == 0


# ---- decontamination ----
def leaks_by_hand(docs, items, percent=80):
    tokens = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    held = defaultdict(set)
    words = {i: tokens(t) for i, t in items}
    for i, w in words.items():
        for g in grams(w, min(5, len(w))) if w else []:
            held[g].add(i)
    found = {}
    for d, t in docs:
        w = tokens(t)
        for item in {i for k in range(1, 6) for g in grams(w, k) for i in held.get(g, ())}:
            n, k = len(words[item]), min(5, len(words[item]))
            b = Counter(grams(words[item], k))
            for start in range(max(1, len(w) - n + 1)):
                a = Counter(grams(w[start : start + n], k))
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if 100 * sim >= percent - 1e-9 and sim > found.get((d, item), (0, 0))[0]:
                    found[d, item] = (sim, start)
    return found


def planted(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(12, 50)))) for i in range(12)] + [(20, "Two words"), (21, ""), (22, None), (23, "la la la la la la la la la")]
    docs = []
    for d in range(80):
        words = rnd.choices(vocabulary, k=rnd.randrange(0, 120))
        if rnd.random() < 0.6:
            passage = rnd.choice(items[:12])[1].split()
            for _ in range(rnd.randrange(0, 3)):
                k = rnd.randrange(len(passage))
                passage[k : k + rnd.randrange(0, 2)] = rnd.choices(vocabulary, k=rnd.randrange(0, 2))
            at = rnd.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rnd.choice(["", ",", "."]) for w in passage]
        docs.append((d, " ".join(words)))
    return [*docs, (90, "so two  WORDS."), (91, None), (92, ""), (93, "la " * 40), (94, " ".join(items[0][1].split()[:-1]))], items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_leaks(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs, items = planted(3)
    want = leaks_by_hand(docs, items)
    df = frame(spark, docs).withColumns({"item_id": F.lit("clash"), "h": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()}
    assert len(want) > 20
    left = {r["doc_id"] for r in decontaminate.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_of_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SCALE}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SCALE}/benchmark.parquet").select("item_id", "text").collect()]
    assert {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, SCALE).collect()} == set(leaks_by_hand(docs, items))


def test_leaks_of_very_long_items(spark):
    """More shingles than 16 bits count: found in a document of just these words, in a shorter one, not in others."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(30000)}" for _ in range(70_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:60_000])), (3, " ".join(words[:30_000])), (4, "la " * 70_010)]
    items = spark.createDataFrame([(7, " ".join(words)), (8, "some words that are an item of the usual size")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 3)) for r in decontaminate.leaks(frame(spark, docs), items).collect()}
    assert got == {(1, 7): (0, 1.0), (2, 7): (0, 0.857)}


def test_similarity_counts_repeats(spark):
    rnd = random.Random(6)
    rows = [([rnd.randrange(6) for _ in range(rnd.randrange(1, 30))], [rnd.randrange(6) for _ in range(rnd.randrange(1, 30))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontaminate.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        x, y = Counter(r["a"]), Counter(r["b"])
        assert r["s"] == pytest.approx((x & y).total() / (x | y).total())


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, [(1, "a b")]), none).count() == 0
    assert decontaminate.clean(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


# ---- language ----
def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SCALE}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, SCALE).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 0.1 < len(held) / len(rows) < 0.3
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_languages_that_were_not_learned_are_rejected(spark):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    model = langid.fit(docs)
    others = [
        "Всички хора се раждат свободни и равни по достойнство и права.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Alla människor är födda fria och lika i värde och rättigheter, säger språklagen.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi.",
    ]
    got = langid.identify(frame(spark, list(enumerate(others))), model).filter("rejected").count()
    assert got == len(others)
    held = langid.identify(docs.filter("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "text"), model)
    assert held.filter("rejected and text rlike '[a-z]'").count() <= 0.002 * held.count()


def test_language_of_odd_rows(spark):
    train = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("el gato y el perro", "es")] * 30)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog " * 30000), (5, "x"), (6, "日本語"), (7, "el perro"), (7, "el perro")]
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(frame(spark, rows).withColumn("score", F.lit("clash")), model).collect()]
    by = dict(x[:2] for x in got)
    assert len(got) == 8 and [by[i] for i in (1, 2, 3)] == ["und"] * 3 and by[4] == "en" and by[7] == "es" and by[6] in ("en", "es")
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in langid.identify(frame(spark, [(1, "abc")]), empty).collect()] == ["und"]


def test_language_ignores_labels(spark):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    model = langid.fit(docs)
    a = langid.identify(docs, model).select("doc_id", "lang_pred").collect()
    b = langid.identify(docs.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    held = docs.filter("crc32(cast(doc_id as string)) % 5 = 0").withColumn("lang", F.lit("zz"))
    again = langid.fit(docs.filter("crc32(cast(doc_id as string)) % 5 <> 0").unionByName(held))
    assert again.languages == model.languages


def test_chat_digest_by_hand(spark):
    r = {x["conv_id"]: x for x in queries.op7_chat_formatting(spark, "/root/testdata/sf0.001").collect()}[-7]
    text = "\\### Assistant: </turn> ok"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
