import json
import re

import pytest
from pyspark.sql import functions as F

from stepforge.operators import corrupt, dag, generation, passk, qc, reports, sampling
from stepforge.plans import pipelines
from stepforge.sources import files

TEXT = "We start. Define apples as a; so a = 3. Define pears as b; so b = a = 3. Define plums as c; so c = a + b = 3 + 3 = 6. Define sum as d; so d = c + b = 6 + 3 = 9. Answer: 9"


def parsed(spark, *texts):
    return dag.parse(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, solution string"))


def test_parse(spark):
    row = parsed(spark, TEXT).first()
    assert row["preamble"] == "We start." and row["tail"] == "Answer: 9" and row["parse_error"] is None
    assert [(s["var"], s["deps"]) for s in row["steps"]] == [("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("d", ["b", "c"])]


def test_parse_edges_of_format(spark):
    gap = "Define a as x; so x = 1. We know z. Define b as y; so y = x + 1. Answer: 2"
    skipped = "Define a as x; so x = 1. Define nothing here. Define b as y; so y = x + 1. Answer: 2"
    rows = {r["id"]: r for r in parsed(spark, gap, skipped, "This has no blocks", "", None, "Define a as 4. So").collect()}
    assert [s["deps"] for s in rows["0"]["steps"]] == [[], ["x"]]
    assert "We know" not in rows["0"]["tail"] and all("We know" not in s["step_text"] for s in rows["0"]["steps"])
    assert [(s["block_idx"], s["step_pos"]) for s in rows["1"]["steps"]] == [(0, 0), (2, 1)]
    assert [rows[k]["parse_error"] for k in "2345"] == ["no_define", "no_solution", "no_solution", "no_nodes"]


def test_json_keeps_last_definition(spark):
    row = parsed(spark, "Define a as x; so x = 1. Define b as x; so x = 2.").select(dag.as_json(F.col("preamble"), F.col("steps"), F.col("tail"))).first()[0]
    out = json.loads(row)
    assert out["order"] == ["x", "x"] and out["nodes"]["x"]["desc"] == "b"


@pytest.mark.parametrize("seed", range(5))
def test_corruptions_keep_their_promises(spark, seed):
    rows = {r["error_type"]: r for r in corrupt.corrupt(parsed(spark, TEXT), seed=seed).collect()}
    steps = [s["step_text"] for s in rows["disorder"]["steps"]]
    numbers = lambda t: re.findall(r"\d+", t)
    new = rows["computer_error"]["rejected"]
    changed = [(int(x), int(y)) for x, y in zip(numbers(TEXT), numbers(new), strict=True) if x != y]
    assert len(changed) == 1 and 1 <= abs(changed[0][0] - changed[0][1]) <= 2
    words = lambda t: re.findall(r"\w+", t)
    swapped = [(x, y) for x, y in zip(words(TEXT), words(rows["dependency_mismatch"]["rejected"]), strict=True) if x != y]
    assert len(swapped) == 1 and set(swapped[0]) <= set("abc")
    gone = [s for s in steps if s not in rows["missing_nodes"]["rejected"]]
    assert 1 <= len(gone) <= 2 and steps[0] not in gone and steps[-1] not in gone
    moved = rows["disorder"]["rejected"]
    assert moved != TEXT and sorted(words(moved)) == sorted(words(TEXT))


def test_corruption_of_unknown_type_and_bad_text(spark):
    with pytest.raises(ValueError):
        corrupt.corrupt(parsed(spark, TEXT), ("nonsense",))
    assert all(r["rejected"] is None for r in corrupt.corrupt(parsed(spark, "no blocks", None)).collect())
    single = {r["error_type"]: r["rejected"] for r in corrupt.corrupt(parsed(spark, "Define p as q; so q = 1. Answer: 1")).collect()}
    assert single["disorder"] is None and single["missing_nodes"] is None and single["computer_error"] is not None


def test_qc_reasons(spark):
    long = "Define total as v; so v = 3. " * 4
    cases = [
        ("disorder", long, "", "empty_rejected"), ("disorder", long, long, "identical"), ("disorder", long, "short", "too_short"),
        ("disorder", "x" * 40, "y" * 35, "chosen_too_short"), ("disorder", long, "Q" * len(long), "too_different"),
        ("missing_nodes", long, long[:-1] + "!", "missing_nodes_not_shorter"), ("disorder", long, "Error type here. " + long[:90], "bad_marker"),
        ("disorder", long, long[29:] + "Define x as v; so v = 4. ", "ok"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, error_type string, chosen string, rejected string")
    assert [r["reason"] for r in qc.with_reason(df).orderBy("i").collect()] == [c[3] for c in cases]


def test_training_rows(spark):
    rows = [("ask me this", "p", "q", "a good long answer", "a bad long answer"), (None, "Problem one", None, "same same same", "same  same same"), (None, "Problem one", "why", "a good long answer", "a bad long answer"), ("x", None, None, "a good long answer", "a bad long answer")]
    out = qc.clean_training(spark.createDataFrame(rows, "prompt string, problem string, question string, chosen string, rejected string")).collect()
    assert [r["problem"] for r in out] == ["p", "Problem one"] and "Question:" in out[1]["prompt"]


def test_decay(spark):
    rows = [("op_2_10", i < 8) for i in range(10)] + [("op_11_14", i < 4) for i in range(10)] + [("op_15_20", i < 6) for i in range(30)]
    got = passk.decay(spark.createDataFrame(rows, "bucket string, pass_1 boolean")).first()
    assert got["hard"] == pytest.approx(0.25) and got["decay"] == pytest.approx(0.6875)
    assert passk.decay(spark.createDataFrame(rows[10:], "bucket string, pass_1 boolean")).first()["decay"] is None


def test_moving_average_skips_missing(spark):
    df = spark.createDataFrame([("m", 2, 1.0), ("m", 3, None), ("m", 4, 3.0), ("n", 1, float("nan"))], "model string, op int, v double")
    got = {(r["model"], r["op"]): r["smoothed"] for r in reports.moving_average(df, "v").collect()}
    assert got == {("m", 2): 1.0, ("m", 3): 2.0, ("m", 4): 3.0, ("n", 1): None}


def test_names(spark):
    df = spark.createDataFrame([("Qwen_Qwen2-0.5B",), ("dpo_full_mismatch_414",), ("disorder_compute_error_200each",)], "raw string")
    assert [r[0] for r in df.select(reports.model_name(F.col("raw"))).collect()][:2] == ["base", "dependency_mismatch"]
    assert [r[0] for r in df.select(reports.figure_name(F.col("raw"))).collect()] == ["base", "dependency_mismatch", "compute_error"]


def test_quota_and_numbers(spark):
    rows = [(t, i, "ok" if i % 3 else "bad", f"{(i * 37 + 5) % 101:02x}{i}") for t in ("disorder", "computer_error") for i in range(60)]
    df = spark.createDataFrame(rows, "error_type string, id int, reason string, rank_hash string")
    tried = sampling.quota(df, 10).collect()
    for kind in ("disorder", "computer_error"):
        want, passed = [], 0
        for r in sorted((r for r in rows if r[0] == kind), key=lambda r: (r[3], r[1])):
            if passed >= 10:
                break
            want.append(r[1])
            passed += r[2] == "ok"
        assert sorted(r["id"] for r in tried if r["attempted"] and r["error_type"] == kind) == sorted(want)
    numbered = sampling.number_pairs(sampling.quota(df, 10).filter("kept")).collect()
    assert sorted(r["pair_idx"] for r in numbered) == list(range(20))
    assert {r["pair_idx"] for r in numbered if r["error_type"] == "computer_error"} == set(range(10))


def test_generation_retries_and_counts(spark):
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        model.calls = getattr(model, "calls", 0) + 1
        reply = '{"x": {"rejected": "r"}}' if prompt == "hello" or model.calls % 3 == 0 else "not json"
        return reply, {"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5}

    req = spark.createDataFrame([("1", "x", "hello"), ("2", "x", "bad"), ("3", "x", "third time")], "id string, error_type string, prompt string").coalesce(1)
    log = spark.createDataFrame(generation.generate(req, model, sleep=lambda _: None).collect(), generation.LOG)
    got = {r["id"]: r for r in log.collect()}
    assert (got["1"]["status"], got["1"]["attempts"], got["1"]["error"]) == ("ok", 1, None)
    assert (got["2"]["status"], got["2"]["attempts"], got["2"]["error"]) == ("failed", 3, "no")
    assert (got["3"]["status"], got["3"]["attempts"], got["3"]["total_tokens"]) == ("ok", 2, 10)
    assert [r["id"] for r in generation.pending(req, log).collect()] == ["2"]
    assert generation.token_usage(log).first()["total_tokens"] == 15


def test_a_reply_without_the_text_is_a_failure(spark):
    req = spark.createDataFrame([("1", "x", "p")], "id string, error_type string, prompt string")
    row = generation.generate(req, lambda _: ("not json", {"total_tokens": 1}), sleep=lambda _: None).first()
    assert (row["status"], row["attempts"], row["error"], row["total_tokens"]) == ("failed", 3, "not_json", 3)
    assert generation.generate(req, lambda _: ("not json", {}), check=None).first()["status"] == "ok"


def test_candidates(spark):
    problems = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    out = generation.candidates(problems, lambda p, k: [f"{p}{i}" for i in range(k)], 3)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a0"), (1, 1, "a1"), (1, 2, "a2"), (2, 0, "b0"), (2, 1, "b1"), (2, 2, "b2")]


def test_replies(spark):
    kind = "missing_nodes"
    cases = [('noise {"missing_nodes":{"rejected":"x"}} tail', None, "x"), ('{"missing_nodes":{"rejected":5}}', "not_string", None), ("{}", "missing_key", None), ("zz", "not_json", None), (None, "not_json", None), ('{"missing_nodes":{}}', "missing_rejected", None)]
    df = spark.createDataFrame([(i, c[0], kind) for i, c in enumerate(cases)], "i int, reply string, kind string")
    got = df.orderBy("i").select(*[c.alias(n) for n, c in generation.reply_fields(F.col("reply"), F.col("kind")).items()]).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]
    assert [generation.reply_error(c[0], kind) for c in cases] == [c[1] for c in cases]


def test_pairs_end_to_end(spark):
    df = spark.createDataFrame([(str(i), "How many?", None, TEXT.replace("plums", f"plums{i}")) for i in range(30)], "id string, problem string, question string, solution string")
    out = pipelines.build_pairs(df, per_type=5).collect()
    assert out and len({r["pair_id"] for r in out}) == len(out)
    assert all(r["chosen"] != r["rejected"] for r in out)


@pytest.mark.parametrize("margin", [1, 4])
def test_pairs_need_only_the_first_rows(spark, margin):
    """The rows tried are those of a run over everything, however few are looked at first."""
    texts = [TEXT.replace("plums", f"plums{i}") if i % 3 else "no steps at all" for i in range(120)]
    df = spark.createDataFrame([(str(i), "How many?", None, t, "t", 3) for i, t in enumerate(texts)], "id string, problem string, question string, solution string, template string, op int")
    whole = sampling.quota(pipelines.judged_pairs(df), 6)
    part = pipelines.tried_pairs(df, per_type=6, margin=margin)
    key = lambda rows: sorted((r["error_type"], r["id"], r["reason"], r["kept"]) for r in rows.filter("attempted").collect())
    assert key(part) == key(whole) and len({r[0] for r in key(part)}) == 4
    out = pipelines.build_pairs(df, per_type=6).first()
    assert (out["template"], out["op"]) == ("t", 3) and "nodes" in json.loads(out["dag"])


def test_corruption_of_one_text_and_rates(spark):
    assert corrupt.corrupt_solution(spark, TEXT, "disorder") not in (None, TEXT)
    assert corrupt.corrupt_solution(spark, None, "disorder") is None
    df = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, "Define p as q; so q = 1. Answer: 1")], "id int, solution string")
    got = {r["error_type"]: (r["attempted"], r["succeeded"]) for r in corrupt.corrupt_stats(df).collect()}
    assert got == {"computer_error": (2, 2), "dependency_mismatch": (2, 1), "missing_nodes": (2, 1), "disorder": (2, 1)}
    assert {r["attempted"] for r in corrupt.corrupt_stats(df, first=1).collect()} == {1}


def test_summary_text(spark):
    rows = parsed(spark, "It's on. Define a as x; so x = 1. Define b as y; so y = x. Define c as x; so x = 2. Answer: 2")
    text = rows.select(dag.summary(F.col("preamble"), F.col("steps"), F.col("tail"))).first()[0]
    lines = ["=== ReasoningDAG ===", '  Preamble: "It\'s on."', "  Steps (3):", "    [2] x  deps=[]", "    [1] y  deps=['x']", "    [2] x  deps=[]", "  Tail: 'Answer: 2'"]
    assert text.split("\n") == lines


def test_evaluate(spark):
    p = spark.createDataFrame([(1, "3", TEXT), (2, None, "Answer: 4")], "id long, op string, solution string")
    c = spark.createDataFrame([(1, 0, "Answer: 8"), (1, 1, TEXT)], "id long, j long, txt string")
    got = {r["id"]: r for r in pipelines.evaluate(p, c, (1, 2)).collect()}
    assert (got[1]["pass_1"], got[1]["pass_2"], got[1]["chain_2"]) == (False, True, True)
    assert got[2]["pass_2"] is False and got[2]["bucket"] == "unknown" and got[2]["op"] is None


def test_evaluate_by_the_answer_column(spark):
    p = spark.createDataFrame([(1, "3", "Answer: 7", "it is 42"), (2, "4", "Answer: 7", None)], "id long, op string, solution string, answer string")
    c = spark.createDataFrame([(1, 0, "Answer: 42"), (2, 0, "Answer: 7")], "id long, j long, txt string")
    assert all(r["pass_1"] for r in pipelines.evaluate(p, c, (1,)).collect())
    named = c.withColumn("model", F.lit("m"))
    got = {(r["model"], r["id"]): r["pass_1"] for r in pipelines.evaluate(p, named, (1,), models=["m", "none"]).collect()}
    assert got == {("m", 1): True, ("m", 2): True, ("none", 1): False, ("none", 2): False}


def test_similarity_queries_by_brute_force(spark):
    from stepforge.functions import similarity as S
    from stepforge.plans import queries

    folder = "/root/testdata/sf0.001"
    pairs = {(r["id"], r["j"]): r for r in queries.toy_pairs(spark, folder).collect()}
    limits = qc.Limits()
    for row in queries.qc_similarity(spark, folder).orderBy("id", "j").limit(400).collect():  # noqa: E501  the query itself runs over the whole table
        p = pairs[row["id"], row["j"]]
        ratio = S.ratio(p["chosen"], p["rejected"])
        if row["similarity"] is not None:
            assert row["similarity"] == ratio
            assert (row["reason"] == "too_similar") == (ratio > limits.max_similarity) and (row["reason"] == "too_different") == (ratio < limits.min_similarity)
        elif row["reason"] == "too_different":
            assert ratio < limits.min_similarity
    for row in queries.pair_differences(spark, folder).collect():
        p = pairs[row["id"], row["j"]]
        want = S.first_difference(p["chosen"], p["rejected"])
        assert (row["tag"], row["chosen_part"], row["rejected_part"]) == ((want["tag"], want["chosen"], want["rejected"]) if want else (None, None, None))


def test_files(spark, tmp_path):
    good, array = tmp_path / "a.jsonl", tmp_path / "b.json"
    good.write_text('{"id":"1","problem":"p"}\n\n{"id":"2","solution":"é"}\n')
    array.write_text('[{"id":"1"},{"id":"2"}]')
    assert files.read_records(spark, str(good)).count() == 2 == files.read_records(spark, str(array)).count()
    with pytest.raises(ValueError):
        files.read_records(spark, "x.txt")
    log = tmp_path / "log.jsonl"
    log.write_text('{"id":"1"}\n{"id":\n{"id":"3"}\n')
    rows, bad = files.read_log(spark, str(log), "id string")
    assert sorted(r["id"] for r in rows.collect()) == ["1", "3"] and bad.count() == 1
    assert files.read_log(spark, str(tmp_path / "none"), "id string")[0].count() == 0
    run = tmp_path / "runs" / "m1"
    run.mkdir(parents=True)
    (run / "summary_by_op.json").write_text(json.dumps({"model_path": "/x/Qwen_Qwen2-0.5B", "metrics": {"overall": {"num_samples": 4, "a": 0.5}, "by_bucket": {"op_2_10": {"a": 0.25}}, "by_op": {"3": {"a": 1.0}}}}))
    (run.parent / "summary_by_op.json").write_text("{broken")
    summaries = files.read_summaries(spark, str(tmp_path / "runs"))
    flat = {(r["model_name"], r["evaluation_type"], r["evaluation_target"]): (r["num_samples"], r["a"]) for r in reports.flatten_summary(summaries, ["a"]).collect()}
    name = "Qwen_Qwen2-0.5B"
    assert flat == {(name, "overall", "overall"): (4, 0.5), (name, "bucket", "op_2_10"): (0, 0.25), (name, "op", "3"): (0, 1.0)}
    assert "N/A" in reports.markdown([{"m": "x", "v": None}, {"m": "y", "v": 0.5}], ["m", "v"])


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "p", "s", "disorder", "a"), ("2", " ", "s", "missing_nodes", "b")], "id string, problem string, solution string, error_type string, pair_id string")
    assert [r["id"] for r in files.usable(rows).collect()] == ["1"]
    path = str(tmp_path / "log")
    files.write_records(rows, path)
    files.append_log(rows, path)
    assert files.read_log(spark, path, "id string")[0].count() == 4
    files.write_by_type(rows, str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs" / "by_type")).count() == 2 == spark.read.json(str(tmp_path / "pairs" / "mixed")).count()


def test_stream_answers_once(spark, tmp_path):
    from stepforge.streaming import resume

    source = tmp_path / "in"
    schema = "id string, error_type string, prompt string"
    spark.createDataFrame([("1", "x", "a"), ("1", "x", "a"), ("2", "x", "b")], schema).write.parquet(str(source))
    for _ in range(2):
        q = resume.answer_stream(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "log"), str(tmp_path / "cp"), lambda p: (p, {}), check=None)
        q.awaitTermination()
        spark.createDataFrame([("2", "x", "b"), ("3", "x", "c")], schema).write.mode("append").parquet(str(source))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["1", "2", "3"]
