"""Shared folders, sizing and small Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a folder is made and set in local mode (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^,]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusweave-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []  # folders of this process that nothing has deleted yet


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made_paths() -> list[str]:
    """The folders that shared_path has named and delete_paths has not deleted."""
    return list(_made)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate folders; nothing that reads them lazily may be left."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _made:
            _made.remove(path)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the input by the optimizer's statistics (file sizes for scans); where
    the plan gives none, its rows are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16))
        size = df.agg(F.sum(total)).first()[0] or 0
    return size


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not got, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(size: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(size / each))


BATCH = 16 << 20  # bytes of an Arrow batch that goes to Python


def _bytes(size: str | None) -> int:
    """A size setting in bytes; unset or not positive is without a limit."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", (size or "").lower())
    n = int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else 0
    return n if n > 0 else 1 << 62


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are held to BATCH bytes (long texts make the default of 64 MB
    batches heavy: a task holds several copies of one).  The setting is read when a plan runs, so it stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(name, None)) > BATCH:
        conf.set(name, str(BATCH))
    return df


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sorted_groups(
    batches: Iterator[pa.RecordBatch], key: list[str]
) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by key (integer columns without nulls).
    Memory: one batch and the group that is open."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table[k].to_numpy() for k in key]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in cols)
        new[0] = last is not None and first != last
        at = np.flatnonzero(new).tolist()
        begin = 0
        for stop in at:
            held.append(table.slice(begin, stop - begin))
            yield pa.concat_tables(held)
            held, begin = [], stop
        held.append(table.slice(begin))
        last = tuple(int(c[-1]) for c in cols)
    if held:
        yield pa.concat_tables(held)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers stay alive beside the next stage's."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_table(fn: Callable[[pa.Table], pa.Table]):
    """mapInArrow adapter that applies fn to slices of bounded bytes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                step = max(1, int(batch.num_rows * min(1.0, 16e6 / max(1, batch.nbytes))))
                for i in range(0, batch.num_rows, step):
                    out = fn(pa.Table.from_batches([batch.slice(i, step)]))
                    yield from out.combine_chunks().to_batches()
        give_back()

    return run
