"""Sessions, table access and scratch tables.

Lineage is cut with tables written to the folder that the cluster names in ``spark.checkpoint.dir``: every
executor can read them again after another one is lost, and Parquet keeps them small. ``localCheckpoint`` is
never used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_base: str | None = None


def build_session(app: str = "lavra", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; given settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small file is one partition, and costly work on it would
    leave the other cores idle. Where there are enough partitions, nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables, shared by all executors.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder;
    on a cluster this is an error, since executors can't see the driver's disk.
    """
    global _local_base
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="lavra-")
        atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
        sc.setCheckpointDir(f"file://{_local_base}")
    return f"file://{_local_base}"


class Scratch:
    """Tables written once and read many times, in one folder below :func:`shared_dir`.

    The folder has to outlive lazy results that read it, so it goes when the driver's process ends, or with
    :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again; its lineage starts at the files."""
        to = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
            pass
