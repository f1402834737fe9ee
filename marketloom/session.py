"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = 8, shuffle_partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """Session for tests and benchmarks on one machine; ``folder`` holds the work tables."""
    builder = SparkSession.builder if folder is None else SparkSession.builder.config(
        "spark.checkpoint.dir", folder
    )
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("marketloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.marketloom.text.parts", str(cpus))  # the test tables are single files
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for work tables, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own: on a cluster
    executors do not share a machine's disk, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@lru_cache
def _own_folder(application: str) -> str:
    """One temporary folder per local application; it goes when the program ends."""
    folder = tempfile.mkdtemp(prefix="marketloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a work table; never reused, so a retried job cannot meet old files."""
    return f"{shared_dir(spark)}/marketloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    Used where several branches of a plan need the same costly rows, or where a value such as the
    partition number must not change between two evaluations. The result survives lost executors.
    Large rows need ``rows_per_file`` (0: as Spark writes), since Parquet takes 100 rows into a page
    before it looks at their bytes.
    """
    path = work_path(df.sparkSession, name)
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
