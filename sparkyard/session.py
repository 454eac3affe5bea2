"""Session factory and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "sparkyard", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the engine's settings; nothing is overridden that a running session already has."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **(conf or {})}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests, local mode) a temporary folder of this
    machine is made, and removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    own = getattr(shared_folder, "_own", None)
    if own is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = shared_folder._own = tempfile.mkdtemp(prefix="sparkyard-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


class Scratch:
    """Intermediate tables of one job, written to the shared folder.

    A written table cuts the lineage as ``checkpoint()`` does and outlives the executor that wrote it,
    but is compressed and columnar, and can be dropped as soon as its successor is written.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sparkyard/{job}-{uuid.uuid4().hex}"
        self._n = 0
        _register_cleanup(spark, self.root)

    def write(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
        """Write ``df`` and give the table that reads it back, with its path."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.write(df, name)[0]

    def drop(self, path: str | None) -> None:
        if path:
            delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _register_cleanup(spark: SparkSession, path: str) -> None:
    def clean() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the session may be gone; the folder is the cluster's to clean then
            pass

    atexit.register(clean)
