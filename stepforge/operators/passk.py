"""pass@k and chain metrics: per problem, then over all, by bucket and by op in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions import chains
from stepforge.functions import constants as K
from stepforge.functions import text as T


def score_answers(candidates: DataFrame, gold: Column, text: str = "txt") -> DataFrame:
    """Adds is_correct: the candidate's last number equals the gold answer."""
    return candidates.withColumn("is_correct", chains.answer_correct(T.last_number(F.col(text)), gold))


def gold_answers(problems: DataFrame, solution: str = "solution") -> Column:
    """The last number of ``answer``, where problems have such a column and it holds one, else of the solution."""
    answer = F.col("answer") if "answer" in problems.columns else F.lit(None)
    return T.gold_answer(answer, F.col(solution))


def score_chains(candidates: DataFrame, problems: DataFrame, key: str = "id", text: str = "txt", solution: str = "solution") -> DataFrame:
    """Candidates joined with their problem's gold features (built once a problem), with scores and chain_correct.

    Candidates' features are built after the join, so their texts are shuffled and not the arrays made of them.
    """
    gold = chains.features(problems.select(key, solution, gold_answers(problems, solution).alias("gold_answer")), solution, "g_").drop(solution)
    joined = chains.features(candidates.join(gold, key).withColumn("pred_answer", T.last_number(F.col(text))), text, "p_")
    joined = joined.withColumn("is_correct", chains.answer_correct(F.col("pred_answer"), F.col("gold_answer")))
    scored = joined.withColumns(chains.chain_score("p_", "g_"))
    return scored.withColumn("chain_correct", chains.chain_correct(F.col("is_correct"), F.col("final_score")))


def hit(flag: str, j: str, k: int) -> Column:
    return F.coalesce(F.max(F.when(F.col(j) < k, F.col(flag))), F.lit(False))


def per_problem(scored: DataFrame, keys: list[str], ks=K.K_LIST, j: str = "j", chain: bool = False) -> DataFrame:
    """Per problem: whether any of the first k candidates is right, for each k (and the same for chains, and the top one)."""
    out = [hit("is_correct", j, k).alias(f"pass_{k}") for k in ks]
    if chain:
        out += [hit("chain_correct", j, k).alias(f"chain_{k}") for k in ks]
        out.append(F.coalesce(F.max(F.when(F.col(j) == 0, F.col("chain_correct"))), F.lit(False)).alias("top1_chain"))
        out.append(F.coalesce(F.max(F.when(F.col(j) == 0, F.col("final_score"))), F.lit(0.0)).alias("top1_score"))
    return scored.groupBy(*keys).agg(*out)


def rate(flag: str) -> Column:
    return F.count_if(F.col(flag)).cast("double") / F.count("*")


def rates(problems: DataFrame, flags: list[str]) -> list[Column]:
    return [rate(f).alias(f) for f in flags] + [F.count("*").alias("num_samples")]


def by_level(problems: DataFrame, flags: list[str]) -> DataFrame:
    """scope (overall, bucket, op), target and the rates at all three levels in one aggregation; no row for a null op."""
    sets = problems.groupingSets([[], ["bucket"], ["op"]], "bucket", "op").agg(*rates(problems, flags), F.grouping("bucket").alias("_b"), F.grouping("op").alias("_o"))
    scope = F.when((F.col("_b") == 1) & (F.col("_o") == 1), "overall").when(F.col("_b") == 0, "bucket").otherwise("op")
    out = sets.withColumn("scope", scope).filter("scope <> 'op' or op is not null")
    target = F.when(F.col("scope") == "overall", "overall").when(F.col("scope") == "bucket", F.col("bucket")).otherwise(F.col("op").cast("string"))
    return out.select("scope", target.alias("target"), *flags, "num_samples")


def decay(problems: DataFrame, flag: str = "pass_1", keys: list[str] | None = None) -> DataFrame:
    """(easy - hard) / easy, not below 0; null without easy problems, with none of them right, or without hard ones."""
    easy = F.avg(F.when(F.col("bucket") == K.ANCHOR_BUCKET, F.col(flag).cast("double")))
    hard = F.avg(F.when(F.col("bucket").isin(*K.HARD_BUCKETS), F.col(flag).cast("double")))
    ratio = F.when(easy > 0, F.greatest(F.lit(0.0), (easy - hard) / easy))
    return problems.groupBy(*(keys or [])).agg(easy.alias("easy"), hard.alias("hard"), F.when(hard.isNotNull(), ratio).alias("decay"))
