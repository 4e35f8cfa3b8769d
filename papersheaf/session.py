"""Session helpers: the shared folder, checkpoints and a suggested builder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app_name: str = "papersheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting switched on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only when nothing is configured and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="papersheaf-")
    context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/papersheaf/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage and survives the loss of an executor, and unlike a checkpoint it computes the
    rows once and gives the next join their true size instead of an estimate grown round by round.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialized`` that nothing reads any more, such as those of a round that is over."""
    for table in tables:
        spark = table.sparkSession
        folders = {path.rsplit("/", 1)[0] for path in table.inputFiles()}
        for folder in folders:
            if "/papersheaf/" in folder and folder.rsplit("/", 1)[1].startswith("table-"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_rows(rows: DataFrame) -> DataFrame:
    """Give every core a share when the input has fewer partitions than there are cores.

    Inputs of many splits, as on a cluster, are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables written by ``materialized`` in this application, once no result needs them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Kernels run inside tasks refer to it; executors need no installation of their own.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="papersheaf-")) / "papersheaf.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # served to executors by the driver
    _shipped.add(context.applicationId)
