"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here. A written table survives the loss of any executor, is columnar and
compressed, and can be removed as soon as the next round no longer needs it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    java = spark.sparkContext._jsc.sc().getCheckpointDir()
    if java.isDefined():
        return java.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kgspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Numbered Parquet tables of one run of one operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kgspark-{uuid.uuid4().hex}"
        self.kept: list[str] = []

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as a scan of the written table."""
        path = f"{self.root}/{len(self.kept):04d}"
        schema = df.schema
        df.write.parquet(path)
        self.kept.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """Writes what an operator returns and deletes the tables it was made from."""
        out = self.save(df)
        self.forget()
        return out

    def forget(self, keep_last: int = 1) -> None:
        """Deletes all tables but the newest ones; their readers must be done."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for i, path in enumerate(self.kept[: len(self.kept) - keep_last]):
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
                self.kept[i] = ""
