"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and works on all rows its predecessor
kept; all but the last return those columns, and further columns pass through them, whatever their names. An empty table
gives an empty table. Null or empty texts go in the first stage, since no language can be told; a stage that is given
some treats them as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import decontaminate, jaccard, langid, linededup, packing
from stepforge.llm.common import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with enough confidence.

    Null texts and texts without letters go; repeated rows are judged each by itself, and a null doc_id or lang does no
    harm (such rows don't train).
    """
    Workspace(spark, "pipeline")
    return langid.identify(docs, langid.fit(docs)).filter("not rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; every document stays, and n_chars follows its text.

    A null text comes back empty. Rows of equal doc_id are one document and all keep the lines that it keeps; a row of
    null doc_id counts as no document and keeps no repeated line.
    """
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of documents linked by five-word shingles at a similarity of 0.8.

    Of rows with equal doc_id one stays for each text, the least in the other columns. Rows of null doc_id are documents
    of their own that come after all others: one stays for each text, and none that links with a document before it.
    """
    work = Workspace(spark, "near-duplicates")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def one_per_text(rows: DataFrame, key: str) -> DataFrame:
        first = F.min(F.struct(*others)).alias("_first") if others else F.count("*").alias("_first")
        return rows.groupBy(key, "text").agg(first).select(key, "text", *[F.col("_first")[c].alias(c) for c in others])

    top, nulls = docs.agg(F.max("doc_id").cast("long"), F.count_if(F.col("doc_id").isNull())).first()
    nodes = docs.withColumn("_node", F.col("doc_id").cast("long"))
    if nulls:
        unnamed = one_per_text(docs.filter("doc_id is null"), "doc_id").withColumn("_node", F.monotonically_increasing_id() + F.lit((top or 0) + 1))
        nodes = nodes.filter("doc_id is not null").unionByName(work.save(unnamed, "unnamed"))
    gone = jaccard.link(nodes.select(F.col("_node").alias("doc_id"), "text"), width=5, percent=80).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = nodes.join(gone, nodes["_node"] == gone["_gone"], "left_anti")
    repeated = work.save(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    several = one_per_text(kept.join(repeated, "doc_id"), "doc_id")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item.

    Null texts hold none and stay, and so does a row without doc_id; rows of equal doc_id go together.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row a piece, as packing.pack() gives them.

    A null text is one piece with the end id; rows of equal doc_id are documents of their own. Only the columns of pieces
    are returned.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't train the first stage's model or run the tokenizer of the last; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
