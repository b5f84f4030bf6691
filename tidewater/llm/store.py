"""Where operators keep what must outlive a stage (tidewater.session names the folder), and how they meet Arrow."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import fresh_path

#: Rows and bytes of an Arrow batch: long texts stay far below a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20
#: Rows of a batch that goes back.
OUT_ROWS = 1 << 14


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there. See drop."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete what keep wrote: all that was made of it must have been written by now."""
    for df in kept:
        jvm, spark = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark.sessionState().newHadoopConf()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Let executors collect their heaps and return what is free to the system.

    A heap grows to its limit over many jobs and stays there, mostly free, while
    buffers outside it and Python workers come on top. A task a core is run, so each
    executor gets one; where explicit collections are disabled nothing happens.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in this session from now on; a caller's own lower bounds stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        said = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
        if said is None or not 0 < int(said[1]) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores in front until no column (in any case) is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, added: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns that are called like one of added called otherwise, and how to get df's columns back."""
    clash = {x.lower() for x in added}
    names = list(df.columns)
    for i, c in enumerate(df.columns):
        if c.lower() in clash:
            names[i] = unused([*names, *clash], c)[0]
    back = lambda out: out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, df.columns, strict=True)])
    return df.toDF(*names), back


def others(df: DataFrame, added: Iterable[str]) -> DataFrame:
    """df without columns that are called like one of added: these give way."""
    gone = {c.lower() for c in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    x = np.ascontiguousarray(x, np.uint64)
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(x) else bytes(8)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _release() -> None:
    """Give memory that a task has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What operators keep in a worker between tasks, by name: how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """run over a task's batches, with nothing kept from other operators' tasks; then no memory is held beyond the task."""

    def whole(batches):
        try:
            for name, forget in KEPT.items():
                if name != keeps:
                    forget()
            for out in run(batches):
                # the JVM holds what it is given outside its heap
                for lo in range(0, max(1, out.num_rows), OUT_ROWS):
                    yield out.slice(lo, OUT_ROWS)
        finally:
            _release()

    return whole
