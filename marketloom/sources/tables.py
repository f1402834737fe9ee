"""Readers and writers: Parquet, CSV, JSON, text, binary; listing; ingestion; result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom import contracts
from marketloom.sources.bars import BAR_COLUMNS

# URI scheme per storage backend, and the file of a golden set.
SCHEMES = {"local": "", "s3": "s3a://", "gcs": "gs://", "azure": "abfss://"}
GOLDEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
    ]
)
BENCHMARK_COLUMNS = ["entry_id", "query", "generated_answer", "generation_error", "judge"]


def resolve(path: str, backend: str = "local", base: str = "") -> str:
    """URI of ``path`` under ``base`` on a storage backend; an unknown backend is an error."""
    if backend not in SCHEMES:
        raise ValueError(f"unsupported storage backend: {backend}")
    root = base.rstrip("/")
    if SCHEMES[backend] and "://" not in root:
        root = SCHEMES[backend] + root
    return f"{root}/{path.lstrip('/')}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, a folder or a match of a pattern exists; asks the file system only."""
    system, hadoop = _file_system(spark, path)
    found = system.globStatus(hadoop)
    return found is not None and len(found) > 0


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly in a folder; none if it does not exist."""
    system, hadoop = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(hadoop)] if system.exists(hadoop) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; nothing happens if it does not exist."""
    system, hadoop = _file_system(spark, path)
    system.delete(hadoop, True)


def local_name(spark: SparkSession, path: str) -> str | None:
    """The name by which a file is opened without Hadoop, behind mount points; None if there is none."""
    system, hadoop = _file_system(spark, path)
    uri = system.resolvePath(hadoop).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"no data at {path}")
    return path


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files in a folder and below; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(require(spark, path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path``; with partition columns rows are gathered per partition first.

    The rebalance hint lets Spark join small partitions and split large ones by their measured
    size, so that one large ticker is written by several tasks.
    """
    if partition_by:
        gathered = df.hint("rebalance", *partition_by)
        gathered.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Replace the table at ``path`` by files in global order: ranges of rows, each one sorted."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **options).csv(require(spark, path))


def write_csv(df: DataFrame, path: str, **options: str) -> None:
    df.write.mode("overwrite").options(header=True, **options).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool = False) -> DataFrame:
    """JSON lines, or with ``one_per_file`` a single, possibly indented, object per file."""
    return spark.read.schema(schema).option("multiLine", one_per_file).json(require(spark, path))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; characters outside ASCII stay as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """One row per file (``whole``) or per line, with the path of the file."""
    rows = spark.read.text(require(spark, path), wholetext=whole)
    return rows.select(F.input_file_name().alias("path"), "value")


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its content."""
    return spark.read.format("binaryFile").load(require(spark, path)).select("path", "length", "content")


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """Write one small file as it is, with the file system that the path names."""
    fs, target = _file_system(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a golden set in JSON lines; blank lines are skipped."""
    return read_json(spark, path, GOLDEN).filter("id IS NOT NULL")


def ingest(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, force: bool = False
) -> DataFrame:
    """The stored bars at ``path``, built, validated and written first if absent or ``force``."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        bars = build()
        write_parquet(contracts.validate(bars, contracts.RAW).select(*BAR_COLUMNS), path)
    return read_parquet(spark, path)


def write_benchmark(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Benchmark results as JSON: one object per entry, in a folder per variant, and the summaries.

    Entries of a variant are not packed into one object, which would have to pass through one task.
    """
    entries = results.select("variant_id", *[c for c in BENCHMARK_COLUMNS if c in results.columns])
    entries.write.mode("overwrite").partitionBy("variant_id").option("ignoreNullFields", False).json(
        f"{path}/entries"
    )
    write_json(summary, f"{path}/summary")
