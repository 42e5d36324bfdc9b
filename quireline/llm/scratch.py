"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_RECORDS = threading.local()  # jobs of several threads keep their tables apart
_AT_EXIT: set[str] = set()
#: Rows that an Arrow function handles together.
TOGETHER = 256


def _record_stack() -> list[list[str]]:
    return _RECORDS.__dict__.setdefault("stack", [])


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset and Spark runs inside one process (tests), a temporary folder is used;
    where it is unset on a cluster there is no shared folder to write to, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="quireline-")
    return _LOCAL[context.applicationId]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends at files that outlive any executor, and what is read back is the same rows each
    time, so ids made by ``monotonically_increasing_id`` before the cut are stable after it.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quireline/{spark.sparkContext.applicationId}"
    _delete_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if records := _record_stack():
        records[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the driver's file system delete an application's folder when the driver ends; until then results may read it."""
    if folder not in _AT_EXIT:
        _AT_EXIT.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        system.mkdirs(path)  # what does not exist yet cannot be marked
        system.deleteOnExit(path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of tables that are cut inside the block, but for those of a block within it."""
    records = _record_stack()
    records.append(made := [])
    try:
        yield made
    finally:
        records.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        file = jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(conf).delete(file, True)


def arrow_function(rows: Callable[[list], list], kind: str) -> Callable[..., Column]:
    """A column function of ``rows``, from lists of values (one or more) to a list of values.

    Arrow arrays are taken apart a few rows at a time, so a worker never holds a whole batch as
    Python objects, and gives the memory back when a batch is done.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_type(_parse_datatype_string(kind))

    def whole(*arrays: pa.Array) -> pa.Array:
        out = [
            pa.array(rows(*(a.slice(at, TOGETHER).to_pylist() for a in arrays)), type=made) for at in range(0, len(arrays[0]), TOGETHER)
        ]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out) if out else pa.array([], type=made)

    return F.arrow_udf(whole, kind)


#: Tables of up to so many bytes a core may be dealt anew.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer partitions than half the cores over all of them; any other as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES * cores:
        return df
    return df.repartition(cores)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, a table that is cheap to count, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
