"""Session helpers: a tuned local session, and shared materialisation."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of materialised tables that are deleted when the interpreter ends.
_written: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recolta")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a local session that names none (tests, a bench) gets a temporary one; on a cluster its executors would write to
    their own disks, so that raises ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="recolta-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, which leaves the folder to the cluster's own cleaning
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as parquet into the shared folder and read it back.

    Cuts the lineage so that it survives the loss of executors, and evaluates the plan once where several branches
    read it. Results are lazy and may be read at any later time, so all tables of an application lie in one folder, which is
    deleted when the application ends; release() deletes them before.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/recolta/{spark.sparkContext.applicationId}"
    if folder not in _written:
        _written.add(folder)
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what materialize() wrote in this application. Results that still read it fail."""
    _delete(spark, f"{shared_dir(spark)}/recolta/{spark.sparkContext.applicationId}")
