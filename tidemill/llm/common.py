"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Every byte that is no word byte becomes a space, A-Z become a-z. Bytes from 0x80 on only occur in
#: UTF-8 sequences of non-ASCII characters, all of which are word characters.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_made: dict[str, str] = {}
try:
    _libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not every C library has it
    _libc = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run on one machine, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _made.get("own") or _made.setdefault("own", "file://" + tempfile.mkdtemp(prefix="tidemill-"))
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all of an application's scratch paths go when it ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/tidemill-{app}"
    if app not in _made:
        _made[app] = root
        atexit.register(_end, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _end(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # the session may have ended before: nothing is left to delete with
        pass


def write(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; the files of the shuffles that made it are removed with the end of the query, as what reads on reads the table."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """From now on Arrow batches have about that many bytes, so that a worker holds little of long texts at a time. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Returns what a task has freed to the system: workers outlive their tasks, and other tasks need the memory."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the last column of each has about `most` bytes; a single row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.column(batch.num_columns - 1).nbytes // batch.num_rows)
        step = max(1, most // mean)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    give_back()


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, lengthened until none of the columns has them (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
