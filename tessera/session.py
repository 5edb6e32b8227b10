"""Session factory for local runs, and the folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The tables that ``materialize`` has written since ``settled`` began; None outside of it.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session on this machine; a cluster session comes from spark-submit instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, wherever it was started.
    Machines without that folder get the package by ``spark-submit --py-files``."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can reach.

    Only where the setting is missing (tests, one machine) it is a folder of our own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    return (path or f"file://{tempfile.gettempdir()}/tessera-{os.getuid()}").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later stages start from
    these files, so a lost executor costs its own tasks only. The files stay until ``release``, the
    ``settled`` around it or ``remove_materialized`` deletes them."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._materialized_at = path
    if (written := _written.get()) is not None:
        written.append(table)
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave, once nothing that is still to run reads
    them; other DataFrames, and tables that are gone, are passed over."""
    for table in tables:
        if path := getattr(table, "_materialized_at", None):
            _delete(table.sparkSession, path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` what ``build`` returns, then delete the tables that it wrote on the way. If it
    fails they stay until ``remove_materialized``."""
    token = _written.set([])
    try:
        df = build()
        passed = _written.get()
    finally:
        _written.reset(token)
    table = materialize(df, name)
    release(*passed)
    return table


def remove_materialized(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` has left in this application's folder; other jobs keep theirs."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
