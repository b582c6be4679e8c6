"""Session settings and shared scratch space.

Lineage is cut by writing a table into the folder named by ``spark.checkpoint.dir`` (shared by all
executors) and reading it back, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, wherever they run."""
    home = Path(__file__).parent
    if spark.sparkContext.applicationId in _SHIPPED or not home.is_dir():
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    staged = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"  # on the driver; Spark hands it out
    with zipfile.ZipFile(staged, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(staged))


def prepare(spark: SparkSession) -> SparkSession:
    """What results depend on: UTC timestamps, and this package in the workers."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what a stage is cut into before AQE coalesces it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remembered(f):
    """Builds an expression once per application: columns are by name, and building big ones call by call is slow."""
    known: dict = {}

    @functools.wraps(f)
    def once(*args):
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in known:
            known[key] = f(*args)
        return known[key]

    return once


class Scratch:
    """Named intermediate tables in the shared folder."""

    def __init__(self, spark: SparkSession, purpose: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table (short lineage, re-readable by any executor)."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As ``save``, with the number of rows, counted while they are written."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name)), seen.get["n"]

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))
