"""Shared storage for intermediate tables, and Arrow helpers of the operators' Python parts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Most bytes of Arrow data that Spark hands to Python at once; texts may be long.
ARROW_BYTES = 4 << 20
#: Where the shared folder is on a local disk, Hadoop's checked file system starts two processes for each file written, to
#: set its rights; until it runs its command, such a process has all the memory of the executor. The plain one starts none.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without it, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: the cluster has to name a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadspark-"))
    return spark.sparkContext.getCheckpointDir()


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes.

    The table goes when the driver's JVM ends, or earlier by :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    fs, hadoop = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete what :func:`materialize` wrote for these tables, once no plan needs them."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            fs, hadoop = _fs(df.sparkSession, path)
            fs.delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of plans that are no longer referenced.

    The first collection lets go of plans that Python held, the next ones of the shuffles that the plans held; the
    cleaner works beside them.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, as a batch of 10,000 long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (all bytes, offsets); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("" if "string" in str(col.type) else b"", col.type))
    wide = str(col.type).startswith("large")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at.astype(np.int64)


def texts(col: pa.Array) -> Iterator[bytes]:
    """Each text of a column as bytes."""
    data, at = utf8(col)
    view = memoryview(data)  # no second copy of the whole batch
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(view[a:b])


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch of these columns, each cast to its type in ``schema``."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(made, schema=schema)



def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers live on after their stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class Kept(dict):
    """What a Python worker keeps from batch to batch; a worker serves many stages, and keeps one of these at a time."""

    _last: "Kept | None" = None

    def ready(self, most: int) -> "Kept":
        """To be called for each batch or text: lets go of what another operator kept, and of this beyond ``most``."""
        if Kept._last is not self:
            if Kept._last is not None:
                Kept._last.clear()
            Kept._last = self
            give_back()
        if len(self) > most:
            self.clear()
        return self
