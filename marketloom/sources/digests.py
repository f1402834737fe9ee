"""SHA-256 of whole files of any size; no task reads more than a bounded range of a file."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.tables import local_name, require

RANGE = 256 << 20  # bytes of a file that one task reads
READ = 4 << 20  # bytes of it in memory at a time
STATE = 112  # fixed value: bytes of a SHA256_CTX


class Sha256:
    """SHA-256 that can be stored between two parts of its input, unlike those of ``hashlib``.

    The state is OpenSSL's public SHA256_CTX; the functions are those of the library that
    ``hashlib`` itself uses.
    """

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.library = ctypes.CDLL(_hashlib.__file__)
        self.context = ctypes.create_string_buffer(state or bytes(STATE), STATE)
        if state is None:
            self.library.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), STATE)
        self.library.SHA256_Final(out, last)
        return out.raw.hex()


def _advanced(file: tuple[str, str, int, int, bytes | None], most: int) -> tuple:
    """(path, name, length, at, state) of a file after its next ``most`` bytes."""
    path, name, length, at, state = file
    digest, stop = Sha256(state), min(at + most, length)
    with open(name, "rb") as source:
        source.seek(at)
        while at < stop:
            data = source.read(min(READ, stop - at))
            if not data:
                raise OSError(f"{path} has become shorter than {length} bytes")
            digest.update(data)
            at += len(data)
    return path, name, length, at, digest.state()


def _in_rounds(spark: SparkSession, files: list[tuple], most: int) -> DataFrame:
    done = []
    while files:
        tasks = spark.sparkContext.parallelize(files, len(files))
        files = tasks.map(lambda file: _advanced(file, most)).collect()
        done += [(p, n, Sha256(state).hexdigest()) for p, _, n, at, state in files if at == n]
        files = [file for file in files if file[3] < file[2]]
    return spark.createDataFrame(done, "path string, length bigint, sha256 string")


def file_digests(spark: SparkSession, path: str, most: int = RANGE) -> DataFrame:
    """(path, length, sha256) per file; ``path`` may be a pattern; Spark skips empty files.

    Files of at most ``most`` bytes are read whole, by Spark. SHA-256 takes bytes in order, so a
    larger file is read in rounds: in each one, a task reads the next ``most`` bytes, in small
    blocks, and returns the state of the hash, some hundred bytes, for the next round. Large files
    advance side by side, and there are as many rounds as the largest one has ranges. They run
    when this is called.

    Ranges need files that executors can open by name (also behind a mount point of Hadoop's).
    Elsewhere Spark reads large files whole too, which ends at 2 GB.
    """
    files = spark.read.format("binaryFile").load(require(spark, path))
    large, whole = [], []
    for row in files.filter(F.col("length") > most).select("path", "length").toLocalIterator():
        name = local_name(spark, row.path)
        if name is None:
            whole.append(row.path)
        else:
            large.append((row.path, name, row.length, 0, None))
    digest = F.sha2("content", 256).alias("sha256")
    out = files.filter(F.col("length") <= most).select("path", "length", digest)
    if whole:
        rest = spark.read.format("binaryFile").load(whole)
        out = out.unionByName(rest.select("path", "length", digest))
    return out.unionByName(_in_rounds(spark, large, most)) if large else out
