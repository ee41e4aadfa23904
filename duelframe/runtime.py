"""Session factory and the few runtime helpers every operator shares."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "duelframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a given cluster setting is never overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts_for(spark: SparkSession, rows: int, most: int = 1_000_000, least: int = 10_000) -> int:
    """Partitions for so many rows: at most ``most`` rows each, and a task for each core where that leaves ``least`` rows."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, -(-rows // least)))


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; only a session in one JVM may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="duelframe-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the cluster's shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to stay until the driver collects its garbage: let it do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Written:
    """Tables in the shared checkpoint folder, for loops that join their own results.

    A checkpoint keeps the size estimate of its plan, which multiplies from join to join; a written table has the size of
    its files. ``keep`` writes a table and deletes the one written under the same name before, which nothing may read any
    longer. The last ones are deleted when the session's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
        self.now: dict[str, str] = {}
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._delete(self.now.pop(name, None))
        self.now[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            self._delete(self.folder)
        except Exception:  # the session is gone, and with it the way to the folder
            return

    def _delete(self, path: str | None) -> None:
        if path is not None:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
