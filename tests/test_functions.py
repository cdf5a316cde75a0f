import difflib
import random

import pytest
from pyspark.sql import functions as F

from stepforge.functions import chains
from stepforge.functions import similarity as S
from stepforge.functions import text as T


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_last_number(spark):
    given = ["We get 17.", "so x = -0.25", "7, 8 and at last 96", "nothing to see", None, "3-2", "1.", "a1b"]
    assert values(spark, given, T.last_number) == [17.0, -0.25, 96.0, None, None, -2.0, 1.0, 1.0]


def test_gold_answer(spark):
    rows = [("about 12", "Answer: 5"), ("no number", "Answer: 5"), (None, "Answer: 6"), (None, "none")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, s string").orderBy("i")
    assert [r[0] for r in df.select(T.gold_answer(F.col("a"), F.col("s"))).collect()] == [12.0, 5.0, 6.0, None]


def test_percent(spark):
    assert values(spark, [0.29, 0.125, 0.135, 1.0, 0.0, None], T.percent, "double") == ["29%", "12%", "14%", "100%", "0%", None]


def test_normalizing(spark):
    given = ["  A\t b\n C\x1c", None, "", "x  Y"]
    assert values(spark, given, T.normalize) == ["a b c", "", "", "x y"]
    assert values(spark, given, T.clean) == ["A b C", "", "", "x Y"]
    assert values(spark, ["Think. Final Answer: 3", "so Answer： 4", "nothing"], T.reasoning) == ["think.", "so", "nothing"]


def test_buckets(spark):
    given = [None, 1, 2, 10, 11, 14, 15, 20, 21]
    assert values(spark, given, T.op_bucket, "int") == ["unknown", "op_other_1", "op_2_10", "op_2_10", "op_11_14", "op_11_14", "op_15_20", "op_15_20", "op_other_21"]
    assert values(spark, ["4", "4.7", None], T.op_number) == [4, None, None]
    assert values(spark, [4.7], T.op_number, "double") == [4]


def test_perturbed(spark):
    given = ["7", "23", "640", "1001", "2", "1", "0"]
    for seed in range(8):
        new = [int(x) for x in values(spark, given, lambda x, s=seed: T.perturbed(x, F.md5(F.concat(x, F.lit(str(s))))))]
        assert all(n > 0 and n != int(o) and abs(n - int(o)) <= 2 for n, o in zip(new, given, strict=True))


def equation_sets(spark, texts):
    return [sorted((e["a"], e["op"], e["b"], e["c"]) for e in x) for x in values(spark, texts, chains.equations)]


def test_equations(spark):
    texts = ["2 + 9 = 11", "9 + 2 = 11", "6 * 7 = 42", "7 x 6 = 42", "7 × 6 = 42", "12 ÷ 4 = 3", "words", "18/3=6 and 9 - 5 = 4, then 2.5 * 2 = 5", "2 + 9 = 11 + 4 = 15", "8 X 2 = 16"]
    got = equation_sets(spark, texts)
    assert got[0] == got[1] == got[8] == [(2.0, "+", 9.0, 11.0)]
    assert got[2] == got[3] == got[4] == [(6.0, "*", 7.0, 42.0)]
    assert got[5] == [(12.0, "/", 4.0, 3.0)] and got[6] == [] and got[9] == [(2.0, "*", 8.0, 16.0)]
    assert got[7] == [(2.0, "*", 2.5, 5.0), (9.0, "-", 5.0, 4.0), (18.0, "/", 3.0, 6.0)]


def graph(spark, text):
    row = chains.features(spark.createDataFrame([(text,)], "t string"), "t", "").first()
    return {k: [tuple(x) if not isinstance(x, str) else x for x in row[k]] for k in chains.FEATURES}


def test_graphs(spark):
    assert graph(spark, "x = 3.5")["raw"] == [("x", "CONST")] and graph(spark, "x = . y=z")["raw"] == [("y", "z")]
    assert graph(spark, "a = b = 5")["raw"] == [("a", "b")]
    assert graph(spark, "") == {k: [] for k in chains.FEATURES}
    shared = graph(spark, "define p as a; define q as a")
    assert sorted(shared["edges"]) == [("ENTITY::p", "ENTITY::q"), ("ENTITY::q", "ENTITY::q")]
    assert graph(spark, "define x = 5")["entities"] == ["ENTITY::x"]
    assert graph(spark, "so y = x + z")["edges"] == [("VAR::y", "VAR::x"), ("VAR::y", "VAR::z")]


@pytest.mark.parametrize(("a", "b", "want"), [(["a", "b"], ["a", "b"], 1.0), (["a"], ["b"], 0.0), ([], [], 1.0), ([], ["a"], 0.0), (["a", "b", "c"], ["a", "b", "d"], 2 / 3)])
def test_f1(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(chains.f1(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_f1_searches_once(spark):
    df = spark.createDataFrame([(["a"], ["b"])], "a array<string>, b array<string>")
    plan = df.select(chains.f1(F.col("a"), F.col("b")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_intersect") == 1


def test_features_compile_no_pattern_a_row(spark):
    """split() compiles its pattern at every call."""
    plan = chains.features(spark.createDataFrame([("x",)], "t string"), "t", "p_")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_definitions_of_odd_clauses(spark):
    text = " DEFINE \u00a0 The  Apples, as a ;; Define.\nundefine x = 4; define  as as b. y =   ; so c = 1.5x2=3 =; ANSWER \n: define z = 1"
    out = chains.features(spark.createDataFrame([(text,)], "t string"), "t", "").first()
    assert [tuple(e) for e in out["equations"]] == [(1.5, "*", 2.0, 3.0)]
    assert sorted(out["entities"]) == ["ENTITY::as", "ENTITY::the apples", "ENTITY::x"]
    assert sorted(map(tuple, out["raw"])) == [("c", "CONST"), ("x", "CONST")]


def test_identical_text_scores_one(spark):
    text = "Define apples as a; so a = 3. Define pears as b; so b = a + 2 = 3 + 2 = 5. Answer: 5"
    df = spark.createDataFrame([(text, text)], "t string, g string")
    out = chains.features(chains.features(df, "t", "p_"), "g", "g_").select(*[c.alias(n) for n, c in chains.chain_score("p_", "g_").items()]).first()
    assert (out["graph_score"], out["equation_score"], out["final_score"]) == (1.0, 1.0, 1.0)


def test_similarity_is_difflib(spark):
    base = "Define total as v1; so v1 = 3. " * 10
    pairs = [(base[:199], base[:99] + "9" + base[100:199]), (base[:201], base[:100] + "9" + base[101:201]), ("", "x"), (None, "x")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(S.similarity(F.col("a"), F.col("b"), F.lit(True))).collect()]
    want = [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert got == pytest.approx(want)
    assert want[0] > 0.99 and want[1] < 0.6


@pytest.mark.parametrize("alphabet", ["ab", "0123456789 v+=", "abc\x00\x01^-]\\", "äß漢字😀ab", "abcdefghijklmnopqrstuvwxyz 0123456789"])
def test_ratio_is_difflib_on_any_text(alphabet):
    r = random.Random(7)
    text = lambda most: "".join(r.choices(alphabet, k=r.randint(0, most)))
    for most in (8, 60, 199, 260, 700):
        for _ in range(12):
            a = text(most)
            cut, to = sorted((r.randint(0, len(a)), r.randint(0, len(a))))
            for b in (text(most), a[:cut] + text(5) + a[cut:], a[:cut] + a[to:], a[to:] + a[cut:] * 2):
                assert S.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_builds_no_index_of_characters(monkeypatch):
    """At 60 times sf0.1 difflib's own index and loops took too long."""
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", None)
    assert S.ratio("so v1 = 3 + 4" * 10, "so v1 = 3 - 4" * 10) > 0.5
