"""Session defaults and durable materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "routeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle sizing is left to AQE: start from a high partition count on a cluster and let it coalesce; the
    skew-join rule splits hot join keys.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession, root: str) -> None:
    """Give the workers the Python files below ``root``, once per context, where they would not find them by themselves.

    Not needed where the package is installed, on PYTHONPATH, or in the folder that the driver was started in.
    """
    sc = spark.sparkContext
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_routeloom_shipped", False) or os.path.abspath(root) in map(os.path.abspath, filter(None, reachable)):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="routeloom-"), "routeloom_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                rel = os.path.relpath(os.path.join(folder, name), root)
                if name.endswith(".py") and not rel.startswith(("tests", ".")):
                    z.write(os.path.join(folder, name), rel)
    sc.addPyFile(path)  # from here Spark's own file server brings it to every executor
    sc._routeloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; local sessions without one get a scratch folder."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="routeloom-ckpt-")
    sc.setCheckpointDir(shared)
    return shared


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it back from there.

    Needed wherever a value is only stable once computed (range-partition numbers), where one result feeds
    several consumers, or where a loop would grow its lineage. The copy is columnar, so readers prune it,
    and it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that comes in fewer splits than there are cores; a wide scan passes through.

    Worth a small shuffle before costly per-row work on a few unsplittable files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
