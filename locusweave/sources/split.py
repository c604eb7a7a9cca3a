"""Python data sources that split one large file over tasks, and a writer of half-float Parquet with a commit.

Only shapes, row numbers and offsets are read where the partitions are planned; the rows are read in the tasks, so paths must be readable
there (a shared mount)."""

from __future__ import annotations

import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 100_000  # of a matrix or table in a partition
BYTES = 32 << 20  # of a document in a partition
BATCH = 10_000
VECTOR_NAMES, VECTOR_IDS = ("embeddings", "emb", "vectors", "X"), ("gene_ids", "protein_ids", "ids", "names")


@dataclass
class Span(InputPartition):
    """Rows or bytes from start up to stop."""

    start: int
    stop: int


def spans(n: int, each: int) -> list[Span]:
    """n rows in partitions of `each`; none are one empty partition."""
    return [Span(a, min(n, a + each)) for a in range(0, max(1, n), each)]


# --- matrices


class Matrix:
    """The matrix and the ids of an npy, npz or HDF5 file.  In an archive they are found by name or, failing that, the matrix by its shape."""

    def __init__(self, path: str):
        self.path = path
        self.matrix, self.ids = None, None
        if path.endswith(".npz"):
            shapes = self._members()
            self.matrix = next((k for k in VECTOR_NAMES if k in shapes), None) or next((k for k, s in shapes.items() if len(s) == 2), None)
            if self.matrix is None:
                raise ValueError(f"{path} holds no matrix")
            self.ids, self.rows = next((k for k in VECTOR_IDS if k in shapes), None), shapes[self.matrix][0]
        elif path.endswith((".h5", ".hdf5")):
            with self._h5() as f:
                self.matrix, self.ids, self.rows = "embeddings", "protein_ids", f["embeddings"].shape[0]
        else:
            import numpy as np

            self.rows = len(np.load(path, mmap_mode="r"))

    def _h5(self):
        try:
            import h5py
        except ImportError as e:
            raise RuntimeError("HDF5 sources need h5py") from e
        return h5py.File(self.path)

    def _members(self) -> dict[str, tuple]:
        """Shapes by name, from the headers alone."""
        from numpy.lib import format as npy

        found = {}
        with zipfile.ZipFile(self.path) as held:
            for name in held.namelist():
                with held.open(name) as f:
                    header = npy.read_array_header_1_0 if npy.read_magic(f) == (1, 0) else npy.read_array_header_2_0
                    found[name.removesuffix(".npy")] = header(f)[0]
        return found

    def read(self, start: int, stop: int):
        """(rows of the matrix as float32, their ids; rows without ids are numbered)"""
        import numpy as np

        text = lambda a: [v.decode() if isinstance(v, bytes) else str(v) for v in a]
        if self.path.endswith((".h5", ".hdf5")):
            with self._h5() as f:
                return f["embeddings"][start:stop].astype("float32"), text(f["protein_ids"][start:stop])
        held = np.load(self.path, mmap_mode="r")
        x = held[self.matrix] if self.matrix else held
        names = text(held[self.ids][start:stop]) if self.ids else [str(i) for i in range(start, stop)]
        return np.ascontiguousarray(x[start:stop], np.float32), names


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, rows: int, numbered: bool):
        self.path, self.rows, self.numbered = path, rows, numbered

    def partitions(self) -> list[Span]:
        return spans(Matrix(self.path).rows, self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        held = Matrix(self.path)
        held.ids = None if self.numbered else held.ids
        for a in range(partition.start, partition.stop, BATCH):
            x, names = held.read(a, min(a + BATCH, partition.stop))
            offsets = pa.array([i * x.shape[1] for i in range(len(x) + 1)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float32()))], ["gene_id", "emb"])


class MatrixSource(DataSource):
    """(gene_id, emb) of a matrix file, rows in partitions of the option rows."""

    @classmethod
    def name(cls) -> str:
        return "vector_matrix"

    def schema(self) -> str:
        return "gene_id string, emb array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("rows", ROWS)), self.options.get("numbered", "false").lower() == "true")


# --- tables of a DuckDB file


class DuckReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: str, schema, rows: int):
        self.path, self.table, self.columns, self.kinds, self.rows = path, table, columns, schema, rows

    def _open(self):
        import duckdb

        return duckdb.connect(self.path, read_only=True)

    def partitions(self) -> list[Span]:
        with self._open() as con:
            return spans(con.execute(f'SELECT coalesce(max(rowid) + 1, 0) FROM "{self.table}"').fetchone()[0], self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.kinds)
        with self._open() as con:
            found = con.sql(f'SELECT {self.columns} FROM "{self.table}" WHERE rowid >= {partition.start} AND rowid < {partition.stop}')
            for batch in found.to_arrow_reader(BATCH):
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()


class DuckSource(DataSource):
    """Columns (SQL expressions) of a table of a DuckDB file, in ranges of row numbers."""

    @classmethod
    def name(cls) -> str:
        return "duckdb_rows"

    def reader(self, schema) -> DuckReader:
        return DuckReader(self.options["path"], self.options["table"], self.options["columns"], schema, int(self.options.get("rows", ROWS)))


# --- objects of an array in a JSON document

_MARK = re.compile(rb'["{}\[\]:,]')
_STRING_END = re.compile(rb'["\\]')


def object_spans(path: str, keys: tuple[str, ...], each: int) -> list[Span]:
    """Byte ranges of about `each` bytes that hold whole objects of the array at keys, by one pass over the file; what is
    within strings does not count."""
    found: list[Span] = []
    stack: list[str | None] = []  # for each open object the key that is read; None: an array
    text: bytes | None = None  # the string that is open
    last, key_next, begin, first = "", False, 0, None
    with open(path, "rb") as f:
        at, rest = 0, b""
        while chunk := f.read(1 << 20):
            data, base, i = rest + chunk, at - len(rest), 0
            at += len(chunk)
            while i < len(data):
                if text is not None:
                    m = _STRING_END.search(data, i)
                    if m is None or m[0] == b"\\" and m.end() == len(data):  # an escape may be cut
                        cut = m.start() if m else len(data)
                        text, i = (text + data[i:cut])[:200], cut
                        break
                    text = (text + data[i : m.start()])[:200]
                    i = m.end() + (m[0] == b"\\")
                    if m[0] == b'"':
                        last, text = text.decode("utf-8", "replace"), None
                    continue
                m = _MARK.search(data, i)
                if m is None:
                    i = len(data)
                    break
                i, mark, place = m.end(), m[0], base + m.start()
                inside = tuple(k for k in stack if k is not None) == keys and len(stack) == len(keys) + 1 and stack[-1] is None
                if mark == b'"':
                    text = b""
                elif mark == b":":
                    stack[-1] = last
                elif mark in b"{[":
                    if inside and mark == b"{" and first is None:
                        first = place
                    stack.append("" if mark == b"{" else None)
                elif mark in b"}]":
                    stack.pop()
                    inside = tuple(k for k in stack if k is not None) == keys and len(stack) == len(keys) + 1 and stack[-1] is None
                    if inside and mark == b"}" and place + 1 - first >= each:
                        found.append(Span(first, place + 1))
                        first = None
                    elif inside and mark == b"}":
                        begin = place + 1
                    elif mark == b"]" and first is not None and len(stack) == len(keys):
                        found.append(Span(first, begin))
                        first = None
            rest = data[i:]
    return found


class ObjectReader(DataSourceReader):
    def __init__(self, path: str, keys: tuple[str, ...], each: int):
        self.path, self.keys, self.each = path, keys, each

    def partitions(self) -> list[Span]:
        return object_spans(self.path, self.keys, self.each) or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple[str]]:
        with open(self.path, "rb") as f:
            f.seek(partition.start)
            for one in json.loads(b"[" + f.read(partition.stop - partition.start) + b"]"):
                yield (json.dumps(one),)


class ObjectSource(DataSource):
    """(value) JSON text of each object of the array that the option keys names (dotted), in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "json_objects"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["path"], tuple(self.options["keys"].split(".")), int(self.options.get("bytes", BYTES)))


# --- half floats


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class HalfFloatWriter(DataSourceArrowWriter):
    """Tasks write files into _temporary; commit moves those of the tasks that ended well into the folder and marks it with _SUCCESS; abort, and
    commit for files of lost attempts, delete the rest."""

    def __init__(self, path: str):
        self.path, self.scratch = path, f"{path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        os.makedirs(self.scratch, exist_ok=True)
        name, out = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            for i, field in enumerate(table.schema):
                kind = field.type
                if pa.types.is_floating(kind):
                    table = table.set_column(i, field.name, table.column(i).cast(pa.float16()))
                elif pa.types.is_list(kind) and pa.types.is_floating(kind.value_type):
                    table = table.set_column(i, field.name, table.column(i).cast(pa.list_(pa.float16())))
            if out is None:
                out = pq.ParquetWriter(f"{self.scratch}/{name}", table.schema)
            out.write_table(table)
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        for m in messages:
            for name in m.names if m else []:
                os.rename(f"{self.scratch}/{name}", f"{self.path}/{name}")
        self._clear()
        with open(f"{self.path}/_SUCCESS", "w"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if os.path.isdir(self.scratch):
            for name in os.listdir(self.scratch):
                os.remove(f"{self.scratch}/{name}")
            os.rmdir(self.scratch)


class HalfFloatSink(DataSource):
    """Parquet whose float and double columns (or lists of them) are half floats."""

    @classmethod
    def name(cls) -> str:
        return "half_float_parquet"

    def writer(self, schema, overwrite: bool) -> HalfFloatWriter:
        return HalfFloatWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """spark, which knows these sources."""
    for source in (MatrixSource, DuckSource, ObjectSource, HalfFloatSink):
        spark.dataSource.register(source)
    return spark
