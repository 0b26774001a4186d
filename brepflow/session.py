"""Sessions, table access and stages in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the submitted configuration is used as it is."""
    settings = _DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName("brepflow").config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """This package, sent to the workers once for a session, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_brepflow_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="brepflow-package-")  # on the driver, from which executors fetch it
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{made}/brepflow", "zip", os.path.dirname(package), os.path.basename(package)))
    context._brepflow_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, idle: float = 0.5) -> DataFrame:
    """The rows over all cores, where few unsplittable files would leave more than the share ``idle`` of them without work; else ``df`` as it is.

    For operators that spend seconds on a megabyte, before which moving the rows costs little. A table of
    at least as many splits as cores, which any large one is, is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores * idle else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset.

    Only a local master gets a folder of our own; on a cluster a machine-local folder would
    not be seen by the other machines, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{tempfile.gettempdir()}/brepflow-{os.getuid()}"
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as Spark itself would take it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


_STAGES: dict[str, None] = {}


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _STAGES.pop(path, None)


def clear_stages(spark: SparkSession) -> None:
    """Delete what ``stage`` and ``scratch`` made in this process. Only for when no result that reads it is still to be computed."""
    for path in list(_STAGES):
        _delete(spark, path)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """A block after which what it staged is deleted; results that it leaves behind must have been written or collected."""
    before = set(_STAGES)
    try:
        yield
    finally:
        for path in [x for x in _STAGES if x not in before]:
            _delete(spark, path)


def _folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    _STAGES[path] = None
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A path for new files in the shared folder; ``clear_stages`` deletes them, and so does the end of the driver's JVM."""
    return f"{_folder(spark, label)}/data"


def stage(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    It cuts the lineage as a reliable checkpoint does (a lost executor costs nothing that was
    written), and being Parquet it still lets later plans read only the columns they need.
    ``instead_of`` is a stage that nothing but ``df`` needs: it is deleted once ``df`` is written.
    """
    spark = df.sparkSession
    folder = _folder(spark, label)
    df.write.parquet(f"{folder}/data")
    if instead_of is not None:
        _delete(spark, instead_of._brepflow_stage)
    out = spark.read.schema(df.schema).parquet(f"{folder}/data")
    out._brepflow_stage = folder
    return out
