"""A stream of requests answered once: each micro-batch is joined with the log before the model is called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stepforge.operators import generation


def answer_stream(requests: DataFrame, log_path: str, checkpoint: str, model: Callable[[str], tuple[str, dict]], check=generation.reply_error) -> StreamingQuery:
    """Appends to a Parquet log the answers to streamed requests (id, error_type, prompt) that it does not hold yet.

    A batch that is replayed after a failure finds its finished items in the log and skips them.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(log_path)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        log = spark.read.schema(generation.LOG).parquet(log_path) if known else spark.createDataFrame([], generation.LOG)
        todo = generation.pending(rows.dropDuplicates(["id", "error_type"]), log)
        generation.generate(todo, model, check=check).write.mode("append").parquet(log_path)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
