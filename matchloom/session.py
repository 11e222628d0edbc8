"""Session defaults and the one way in which operators cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, one machine (a local master, as in tests) gets a
    temporary folder for as long as the process lives; a cluster gets an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="matchloom-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
    return _OWN[context.applicationId]


_SCRATCH: list[list[DataFrame]] = []
#: Rows of a file, where a writer knows about how many rows there will be.
FILE_ROWS = 8192


def materialize(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back.

    The files outlive lost executors, are columnar, and can be read by several
    later jobs; unlike a cache nothing is computed again. If about ``rows`` rows are to be
    expected, there are no more files than ``each`` rows a file need, however many
    partitions there are: small files cost a task and, on a local disk, processes each.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/matchloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once no later job reads it."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` written, without what was written on the way to it."""
    _SCRATCH.append([])
    try:
        out = materialize(make(), name)
    finally:
        written = _SCRATCH.pop()
    discard(*written[:-1])
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out
