"""Tables in the folder that driver and executors share, to cut lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a finished execution are removed at once, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and driver and executors are one process, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not hasattr(spark.sparkContext, "_tessera_dir"):
        spark.sparkContext._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
        _delete_at_exit(spark, spark.sparkContext._tessera_dir)
    return spark.sparkContext._tessera_dir


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The driver's JVM deletes the folder when it ends: results are lazy and may read it until then."""
    store, where = _place(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)


class Scratch:
    """Tables written to the shared folder: a lost executor costs a re-read, never a recomputation. What is left of them goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        _delete_at_exit(spark, self.root)

    def written(self, write) -> None:
        """Run `write`; what it shuffles is removed as soon as it is done."""
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            write()
        finally:
            self.spark.conf.set(CLEAN_UP, before)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:6]}"
        self.written(lambda: df.write.parquet(path))
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing yet to run reads."""
        for t in tables:
            if path := self.paths.pop(id(t), None):
                store, where = _place(self.spark, path)
                store.delete(where, True)
