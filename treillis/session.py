"""Session settings, table access and lineage cuts shared by every operator."""
from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python are bounded in bytes as well as in rows, so that a batch of long
#: texts fits the small share of an executor's memory that its Python workers have.
ARROW_BATCH_ROWS = 2_000
ARROW_BATCH_BYTES = 4 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session; called by every operator that goes through Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that they need no installation."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # the package itself was imported from an archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="treillis-"), "treillis.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the data directory (one parquet file or folder per table)."""
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the checkpoint folder the cluster names; a temporary one only where none is set and all runs in one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="treillis-checkpoints-"))


def cut(frame: DataFrame) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and goes on from there.

    The files survive the loss of an executor; later plans don't repeat the work before."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def local_session(app: str = "treillis", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, benchmarks and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
