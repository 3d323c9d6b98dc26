"""What the training-data operators share: shared scratch tables, session settings, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; with texts of a few KB this stays near 4 MB.
BATCH_ROWS = 1024


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run on one machine (tests)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="causeway-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/causeway-{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Recent:
    """What was worked out lately: of two halves, the older one goes when the younger is full; what is asked for stays."""

    def __init__(self, most: int):
        self.young, self.old, self.most = {}, {}, most // 2

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def missing(self, keys: set) -> list:
        """The keys that aren't known, in order; known ones are in young afterwards, until the next call."""
        self.turn()
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return sorted(out)


class Scratch:
    """Tables written once to the shared folder and read again, so that lineage ends there and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count, self.paths = spark, shared_path(spark, label), 0, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def discard(self, df: DataFrame) -> None:
        """Delete a table that no later result reads."""
        path, _ = self.paths.pop(id(df))
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: Column) -> Column:
    """Equal for equal texts: 256 bits, so that rows with one text share their work."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
