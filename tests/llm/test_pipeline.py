from collections import Counter

from test_dedup import lines_by_hand, links_by_hand
from test_text_quality import leaks_by_hand
from test_tokens import check_packing

import corpus_pipeline
from stepforge.llm import langid
from stepforge.llm.common import Workspace

SCALE = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    """Every stage is held against a plain version on what its predecessor kept."""
    work = Workspace(spark, "test")
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    columns = docs.columns
    kept = {}
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        model = langid.fit(docs) if name == "language_id" else None
        rejected = {r["doc_id"] for r in langid.identify(docs, model).filter("rejected").collect()} if model else set()
        docs = work.save(stage(spark, docs, SCALE), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "language_id":
            assert set(kept[name]) == set(given[name]) - rejected
    lines = {d: t for d, _, _, t in lines_by_hand(list(given["line_dedup"].items()))}
    assert kept["line_dedup"] == lines
    groups = links_by_hand(list(given["near_duplicates"].items()), 5, 80)
    assert set(kept["near_duplicates"]) == {d for d, _, c in groups if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SCALE}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in leaks_by_hand(list(given["decontamination"].items()), items)}
    assert set(kept["decontamination"]) == set(given["decontamination"]) - bad
    check_packing(docs.collect(), given["best_fit_packing"], 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, SCALE)
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    text, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, text, "y"), (1, text, "x"), (1, other, "x"), (2, text + " end", "x"), (3, third, "x"), (3, third, "x"), (None, third, "x"), (None, "lone words", "y"), (None, "lone words", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, docs, SCALE)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter([(1, text, "x"), (1, other, "x"), (3, third, "x"), (None, "lone words", "x"), (None, None, "x")])


def test_rows_without_text_or_label(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SCALE)
    # texts without letters go, and the one language that was learned is kept
    assert {r["doc_id"] for r in docs.collect()} == {3}
