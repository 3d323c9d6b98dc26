"""Incremental logs: read what is new, keep the best record of each id, refresh the summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.graph import shared_dir
from causeway.operators.ranking import keep_best
from causeway.rules import ladder


def quality(df: DataFrame) -> DataFrame:
    """Adds how good a record of an id is."""
    e = F.col("event_type")
    return df.withColumn("quality", ladder([(e == "purchase", 100), (e == "signup", 20), (e == "click", 15)], 10))


def split_path(spark: SparkSession, source: str) -> tuple[str, str]:
    """(folder, "") of a folder; (folder, name) of a file, as streams read folders only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return source, ""
    return source.rsplit("/", 1)[0], source.rsplit("/", 1)[1]


def ingest(spark: SparkSession, source: str, schema, target: str, state: str, files_per_batch: int = 16) -> None:
    """Appends what `source` has gained since the last call to `target`, exactly once.

    The stream's own checkpoint in `state` says what was read; a batch that is tried again overwrites its folder.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    folder, name = split_path(spark, source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)
    run = stream.writeStream.foreachBatch(land).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


def best(spark: SparkSession, target: str, schema, key: str) -> DataFrame:
    """The best landed record of each id; ids that come again may replace what was there."""
    rows = spark.read.schema(schema).parquet(target)
    return keep_best(quality(rows), [key], [F.desc("quality"), F.desc("value"), F.desc("event_id")])


def replay(spark: SparkSession, source: str, key: str = "user_id") -> DataFrame:
    """Reads a table as a stream into a new log, and a second time to see that nothing is read twice."""
    root = f"{shared_dir(spark)}/causeway-log-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        ingest(spark, source, schema, f"{root}/log", f"{root}/state")
    return best(spark, f"{root}/log", schema, key).select(key, "event_id", "quality")


def summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts by a column, for outputMode("complete") or a batch."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))
