"""Readers and writers of records, logs, summaries and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBLEM = "id string, problem string, question string, solution string, op string, template string, mode string, length string, d string, answer string"
LEVEL = "map<string,double>"
SUMMARY = f"model_path string, metrics struct<overall:{LEVEL},by_bucket:map<string,{LEVEL}>,by_op:map<string,{LEVEL}>,generalization_decay_rate:double,num_test_samples:long>"


def read_records(spark: SparkSession, path: str, schema: str = PROBLEM) -> DataFrame:
    """.jsonl: one object a line; .json: an array of objects. A malformed record or another suffix is an error."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines of a JSON-lines log; a log that does not exist is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    # malformed lines are told by a parse of the text, since Spark refuses queries of the corrupt column alone
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("r._bad is null").select("r.*").drop("_bad"), parsed.filter("r._bad is not null").select(F.col("value").alias("line"))


def usable(records: DataFrame) -> DataFrame:
    """Records with a problem and a solution that are not blank."""
    from stepforge.functions.text import strip

    return records.filter((strip(F.col("problem")) != "") & (strip(F.col("solution")) != ""))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_type(pairs: DataFrame, folder: str, seed: int = 42) -> None:
    """by_type/error_type=.../ and mixed/ in seeded order."""
    from stepforge.functions.text import rank_hash

    pairs.write.mode("overwrite").partitionBy("error_type").json(f"{folder}/by_type")
    pairs.withColumn("_h", rank_hash(F.col("pair_id"), seed=seed)).sort("_h").drop("_h").write.mode("overwrite").json(f"{folder}/mixed")


def read_summaries(spark: SparkSession, root: str, name: str = "summary_by_op.json") -> DataFrame:
    """All files of that name below root with model_name from the model's path or the file's folder; unreadable ones are left out."""
    read = spark.read.schema(f"{SUMMARY}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    from_path = F.nullif(F.regexp_extract(F.coalesce("model_path", F.lit("")), r"([^/]+)/*$", 1), F.lit(""))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    good = read.select(F.coalesce(from_path, folder).alias("model_name"), "model_path", "metrics", F.col("_metadata.file_path").alias("file"), "_bad")
    return good.filter("_bad is null and metrics is not null").drop("_bad").select("model_name", "model_path", "metrics.overall", "metrics.by_bucket", "metrics.by_op", "metrics.generalization_decay_rate", "metrics.num_test_samples", "file")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header; for report tables, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """One small report file."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_file(spark: SparkSession, content: str, path: str) -> None:
    """One small file of exactly this name, in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()
