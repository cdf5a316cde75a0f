"""Quality rules as weak supervision, with DataFrame functions alone.

Each rule votes bad, votes good or abstains on a document. Votes are counted by pattern over all documents (at most
3 ** rules patterns), expectation-maximisation on that table estimates how often each rule votes each way on good and on
bad documents, and the posterior probability of being good replaces a demand that every rule pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]"
#: (name, votes bad, votes good) over the columns of counts(); neither: abstain.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("capitals", "2 * n_upper > word_chars", "5 * n_upper <= word_chars"),
    ("repeats", "5 * n_repeat_words > 2 * n_words", "20 * n_repeat_words <= n_words"),
    ("duplicate_lines", "4 * n_dup_lines > n_lines and n_dup_lines > 2", "n_dup_lines = 0"),
    ("exclamations", "10 * n_exclaimed > n_words", "100 * n_exclaimed <= n_words"),
    ("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("few_words", "n_words < 20", "n_words >= 50"),
)
ROUNDS = 50
#: Rules are written to be precise: on good documents a rule that votes is taken to vote bad this often at most.
FALSE_ALARM = 0.002
#: How often a rule that votes may be found to vote bad on bad documents, and what is expected before any data.
FIRES, EXPECTED = (0.05, 0.95), 0.25
PRIOR_WEIGHT = 20.0


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""

    def of(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))

        def count(h: Column) -> Column:
            ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def covered(s: Column) -> Column:
                again = F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
                start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
                return F.aggregate(F.array_sort(again), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

        return let(hashes, count)

    return let(words, of)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use, over whole texts; a null text has no words and one empty line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    words = F.filter(F.split(text, f"{BLANKS}+"), lambda x: x != "")
    # explode keeps the optimizer from repeating the splits in every expression that uses them
    cut = docs.select("doc_id", F.explode(F.array(F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")))).alias("c")).select("doc_id", "c.*")
    less = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    return cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        less("[#*$%&|<>]+").alias("n_symbols"),
        less("[A-ZÀ-ÖØ-Þ]+").alias("n_upper"),
        less("!+").alias("n_exclaimed"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def votes(counted: DataFrame, rules=RULES) -> DataFrame:
    """Adds votes, a string with b, g or - for each rule."""
    return counted.withColumn("votes", F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for _, bad, good in rules]))


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[float, dict[str, list[float]], dict[str, float]]:
    """EM over counts of vote patterns: share of good documents, rates of bad votes by class and rule, posterior by pattern.

    An abstention is no evidence. The bounds on the rates keep the classes from changing places.
    """
    if not patterns:
        return 0.5, {}, {}
    rules = range(len(next(iter(patterns))))
    rates = {"good": [FALSE_ALARM for _ in rules], "bad": [EXPECTED for _ in rules]}
    share = 0.8

    def posterior(pattern: str) -> float:
        odds = math.log(share / (1 - share))
        for k in rules:
            good, bad = rates["good"][k], rates["bad"][k]
            if pattern[k] != "-":
                odds += math.log(good / bad) if pattern[k] == "b" else math.log((1 - good) / (1 - bad))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        good = {p: posterior(p) for p in patterns}
        for k in rules:
            for c, expected in (("good", FALSE_ALARM), ("bad", EXPECTED)):
                mass = {p: n * (good[p] if c == "good" else 1 - good[p]) for p, n in patterns.items() if p[k] != "-"}
                rate = (sum(m for p, m in mass.items() if p[k] == "b") + PRIOR_WEIGHT * expected) / (sum(mass.values()) + PRIOR_WEIGHT)
                rates[c][k] = min(max(rate, 1e-6), FALSE_ALARM) if c == "good" else min(max(rate, FIRES[0]), FIRES[1])
        total = sum(patterns.values())
        share = min(0.999, max(0.001, (sum(n * good[p] for p, n in patterns.items()) + PRIOR_WEIGHT * 0.8) / (total + PRIOR_WEIGHT)))
    return share, rates, {p: posterior(p) for p in sorted(patterns)}


def judge(docs: DataFrame, rules=RULES, keep_from: float = 0.5, save=lambda df: df) -> DataFrame:
    """doc_id, counts, votes, base_failed, quality (posterior of being good) and kept for every row of documents.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows; such a document is not
    kept. Others are kept from a posterior of ``keep_from``. An empty table gives no rows; repeated rows are judged
    each by itself. ``save`` may store the counts, which are read twice.
    """
    voted = save(votes(counts(docs), rules))
    patterns = {r[0]: r[1] for r in voted.groupBy("votes").count().collect()}  # at most 3 ** rules rows
    _, _, quality = estimate(patterns)
    spark = docs.sparkSession
    values = ", ".join(f"('{p}', {q!r}D)" for p, q in (quality or {"": 0.5}).items())
    posteriors = F.broadcast(spark.sql(f"select * from values {values} as t(votes, quality)"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.join(posteriors, "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_from))
