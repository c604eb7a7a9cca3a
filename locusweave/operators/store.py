"""Persisted gene store, stage checkpoints, artifact manifest and table sinks."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from locusweave.operators import nearest


def append_new(old: DataFrame, new: DataFrame, key: str = "gene_id") -> DataFrame:
    """old and the rows of new whose key is not there yet (repeated keys of new once)."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, for any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def digest_of(*parts: object) -> str:
    """A short content digest of settings or names."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


def input_digest(df: DataFrame) -> str:
    """Digest of what a table is made from: its columns, its plan, and the names, sizes and times of the files it reads."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    files = df.inputFiles()
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    told = []
    for f in sorted(files):
        p = jvm.org.apache.hadoop.fs.Path(f)
        at = p.getFileSystem(conf).getFileStatus(p)
        told.append((f, at.getLen(), at.getModificationTime()))
    return digest_of(df.dtypes, plan, told)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: list[str] = (), key: str = "") -> DataFrame:
    """A materialised stage: read if it was finished before under the same key (a digest of its input and settings), else built and
    written."""
    path = f"{path}-{key}" if key else path
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


class _Folder:
    """A path of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; False if it is there already."""
        try:
            stream = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


CELL_TIMES = 4  # a cell of more rows than this times the mean is split


class GeneStore:
    """A gene table that grows, with an index of its vectors: create, load, add, build_index, search, compact, vacuum.

    Folders have names that no other writer can take: part-* (rows), keys-* (their gene_id alone), cells/batch=* (vectors by cell) and
    centres-*.  What counts is named by the last file of commits/: a commit is one file, made by exactly one writer and never
    rewritten, so a reader sees all of an addition or nothing.  A writer that comes second reads the new commit and adds again, against its
    keys too.  An addition reads the keys of the store and, for the index, just cells that it makes overfull.  It may carry a name (a
    batch id): the same name is not added twice.

    Rows of a known or null gene_id are not added; of repeated new ones one is.  A column that only some parts have is null in the
    others; a new column of a known name takes the known type."""

    def __init__(self, spark: SparkSession, path: str, number: int = -1, state: dict | None = None):
        self.spark, self.path, self.number = spark, path.rstrip("/"), number
        self.state = state or {"parts": [], "keys": [], "batches": [], "schema": None, "index": None}

    @property
    def parts(self) -> list[str]:
        return self.state["parts"]

    @property
    def version(self) -> int:
        return self.number

    @classmethod
    def create(cls, genes: DataFrame, path: str) -> GeneStore:
        return cls(genes.sparkSession, path).add(genes)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GeneStore:
        """The store by its last whole commit; one without commits is empty."""
        commits = _Folder(spark, f"{path.rstrip('/')}/commits")
        numbers = [int(n.removesuffix(".json")) for n in commits.names() if n.endswith(".json")]
        for number in sorted(numbers, reverse=True):
            try:
                return cls(spark, path, number, json.loads(commits.read(f"{number:08d}.json")))
            except json.JSONDecodeError:  # its writer was lost; the number stays taken
                continue
        return cls(spark, path, max(numbers, default=-1))

    def _commit(self, state: dict) -> GeneStore | None:
        """The store with this state; None if another writer was first."""
        commits = _Folder(self.spark, f"{self.path}/commits")
        taken = [int(n.removesuffix(".json")) for n in commits.names() if n.endswith(".json")]
        number = max([self.number, *taken]) + 1
        if number != self.number + 1 and GeneStore.load(self.spark, self.path).number != self.number:
            return None
        return GeneStore(self.spark, self.path, number, state) if commits.create(f"{number:08d}.json", json.dumps(state)) else None

    def _new(self, kind: str, more: str = "") -> str:
        return f"{kind}-{uuid.uuid4().hex}{more}"

    def _read(self, names: list[str], schema: StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    @property
    def genes(self) -> DataFrame:
        """All rows."""
        return self._read(self.parts, StructType.fromJson(self.state["schema"]) if self.state["schema"] else StructType([StructField("gene_id", StringType())]))

    @property
    def keys(self) -> DataFrame:
        return self._read(self.state["keys"], StructType([StructField("gene_id", StringType())]))

    def _schema(self, new: DataFrame) -> StructType:
        known = StructType.fromJson(self.state["schema"]).fields if self.state["schema"] else []
        names = {f.name for f in known}
        return StructType([*known, *[StructField(f.name, f.dataType) for f in new.schema.fields if f.name not in names]])

    def add(self, new: DataFrame, batch: str | None = None) -> GeneStore:
        """The store with the rows of new whose gene_id is not there yet."""
        store = self
        while batch is None or batch not in store.state["batches"]:
            grown = store._added(new, batch)
            if grown is not None:
                return grown
            store = GeneStore.load(self.spark, self.path)
        return store

    def _added(self, new: DataFrame, batch: str | None) -> GeneStore | None:
        schema = self._schema(new)
        kinds = {f.name: f.dataType for f in schema.fields}
        rows = new.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in new.columns]).filter("gene_id IS NOT NULL").dropDuplicates(["gene_id"])
        if self.parts:
            rows = rows.join(self.keys, "gene_id", "left_anti")
        part, keys = self._new("part", f"-{batch}" if batch is not None else ""), self._new("keys")
        rows.write.parquet(f"{self.path}/{part}")
        written = self._read([part], schema)
        written.select("gene_id").write.parquet(f"{self.path}/{keys}")
        state = self.state | {"parts": [*self.parts, part], "keys": [*self.state["keys"], keys], "schema": schema.jsonValue()}
        state["batches"] = [*self.state["batches"], *([batch] if batch is not None else [])]
        if state["index"]:
            state["index"] = self._indexed(state["index"], written)
        return self._commit(state)

    # --- the index

    def _vectors(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.xxhash64("gene_id").alias("id"), F.col(column).cast("array<double>").alias("v"))

    def build_index(self, column: str = "emb") -> GeneStore:
        """The store with an index of its vectors: cells fitted on a bounded sample, their rows in files by cell."""
        store = self
        while True:
            vectors = store._vectors(store.genes, column)
            rows = vectors.count()
            centre = nearest.lloyd(nearest.sample(vectors), nearest.cell_count(rows), 8, True).astype(float) if rows else np.empty((0, 1))
            cells = nearest.Cells(centre, np.ones(len(centre)), np.zeros(len(centre), np.int64))
            index = {"column": column, "files": [], "centres": None}
            built = store._commit(store.state | {"index": store._placed(index, cells, vectors, np.ones(len(centre), bool))})
            if built is not None:
                return built
            store = GeneStore.load(self.spark, self.path)

    def cells(self, index: dict | None = None) -> nearest.Cells:
        """The cells of the index; a cell that was split has no rows."""
        index = index or self.state["index"]
        if index is None:
            raise ValueError("the store has no index: build_index makes one")
        told = self.spark.read.parquet(f"{self.path}/{index['centres']}").orderBy("cell").collect()  # a row for each cell
        if not told:
            return nearest.Cells(np.empty((0, 1)), np.empty(0), np.empty(0, np.int64))
        return nearest.Cells(np.array([r.centre for r in told]), np.array([r.least for r in told]), np.array([r.rows for r in told], np.int64))

    def _held(self, index: dict) -> DataFrame:
        schema = StructType.fromDDL("id bigint, v array<double>, cos double, batch string, cell int")
        if not index["files"]:
            return self.spark.createDataFrame([], schema).drop("batch")
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/cells")
        return read.parquet(*[f"{self.path}/{n}" for n in index["files"]]).drop("batch")

    def _write_cells(self, held: DataFrame) -> tuple[str, dict[int, tuple[float, int]]]:
        """(folder of held(id, v, cell, cos) by cell, {cell: least cosine and rows})"""
        name = f"cells/batch={uuid.uuid4().hex}"
        held.repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/{name}")
        told = self._held({"files": [name]}).groupBy("cell").agg(F.min("cos").alias("least"), F.count("*").alias("n")).collect()
        return name, {r.cell: (r.least, r.n) for r in told}

    def _placed(self, index: dict, cells: nearest.Cells, vectors: DataFrame, live: np.ndarray) -> dict:
        """The index with vectors in it; cells that grow beyond CELL_TIMES the mean are split, alone."""
        centre, least, rows, files = cells.centre, cells.least.astype(float), cells.rows.copy(), list(index["files"])
        empty = vectors.isEmpty()
        if not empty and not live.any():  # an index of nothing takes its first cells from the first rows
            centre = nearest.lloyd(nearest.sample(vectors), nearest.cell_count(vectors.count()), 8, True).astype(float)
            least, rows, live = np.ones(len(centre)), np.zeros(len(centre), np.int64), np.ones(len(centre), bool)
        if not empty:
            numbers = np.flatnonzero(live)
            held = nearest.in_cells(vectors, centre[numbers]).withColumn("cell", F.get(F.array(*[F.lit(int(n)) for n in numbers]), F.col("cell")))
            name, told = self._write_cells(held)
            files.append(name)
            for c, (a, n) in told.items():
                least[c], rows[c] = min(least[c], a), rows[c] + n
        limit = max(nearest.CELL_ROWS, CELL_TIMES * int(rows.sum()) // nearest.cell_count(int(rows.sum())))
        for c in np.flatnonzero(rows > limit).tolist():
            own = self._held({"files": files}).filter(F.col("cell") == c).select("id", "v")  # the files of one cell
            halves = nearest.lloyd(nearest.sample(own), math.ceil(2 * rows[c] / limit), 8, True).astype(float)
            first = len(centre)
            name, told = self._write_cells(nearest.in_cells(own, halves).withColumn("cell", (F.col("cell") + first).cast("int")))
            files.append(name)
            centre, least, rows = np.concatenate([centre, halves]), np.concatenate([least, np.ones(len(halves))]), np.concatenate([rows, np.zeros(len(halves), np.int64)])
            for n, (a, count) in told.items():
                least[n], rows[n] = a, count
            rows[c] = 0
        name = self._new("centres")
        told = [(c, [float(x) for x in v], float(a), int(n)) for c, (v, a, n) in enumerate(zip(centre, least, rows))]
        self.spark.createDataFrame(told, "cell int, centre array<double>, least double, rows bigint").coalesce(1).write.parquet(f"{self.path}/{name}")
        return index | {"files": files, "centres": name}

    def _indexed(self, index: dict, new: DataFrame) -> dict:
        cells = self.cells(index)
        return self._placed(index, cells, self._vectors(new, index["column"]), cells.rows > 0)

    def search(self, queries: DataFrame, k: int, told: list[dict] | None = None) -> DataFrame:
        """(i, gene_id, sim, rank): for each row of queries(id, v) its k nearest genes of the index, exactly; only the files of
        cells that may hold them are read.  Where bounds spare so little that each query would move to most cells, tiles are searched."""
        cells, index = self.cells(), self.state["index"]
        live = [int(c) for c in np.flatnonzero(cells.rows)]
        if not live:
            return self.spark.createDataFrame([], "i bigint, gene_id string, sim double, rank int")
        held = self._held(index).filter(F.col("cell").isin(live))
        found = nearest.search_held(queries.select("id", F.col("v").cast("array<double>").alias("v")), held, cells, k, held.select("id", "v"), told)
        return found.join(self.keys.select(F.xxhash64("gene_id").alias("j"), "gene_id"), "j").select("i", "gene_id", "sim", "rank")

    # --- upkeep

    def compact(self, files: int | None = None) -> GeneStore:
        """The store with its rows in one part and its keys in one folder, and the cells of the index in one folder."""
        store = self
        while True:
            part, keys = store._new("part"), store._new("keys")
            rows = store.genes.repartition(files) if files else store.genes
            rows.write.parquet(f"{store.path}/{part}")
            store.keys.write.parquet(f"{store.path}/{keys}")
            state = store.state | {"parts": [part], "keys": [keys]}
            if index := state["index"]:
                cells = store.cells()
                live = [int(c) for c in np.flatnonzero(cells.rows)]
                if live:
                    name, _ = store._write_cells(store._held(index).filter(F.col("cell").isin(live)))
                    state["index"] = index | {"files": [name]}
            done = store._commit(state)
            if done is not None:
                return done
            store = GeneStore.load(self.spark, self.path)

    def vacuum(self) -> list[str]:
        """Delete the folders that the last commit does not name; nothing may read or write the store meanwhile."""
        last = GeneStore.load(self.spark, self.path).state
        index = last["index"] or {"files": [], "centres": None}
        named = {*last["parts"], *last["keys"], *index["files"], index["centres"]}
        folder = _Folder(self.spark, self.path)
        there = [n for n in folder.names() if n.split("-")[0] in ("part", "keys", "centres")]
        there += [f"cells/{n}" for n in _Folder(self.spark, f"{self.path}/cells").names() if n.startswith("batch=")]
        gone = [n for n in there if n not in named]
        for n in gone:
            folder.delete(n)
        return gone


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_sqlite(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None, batch: int = 5000) -> None:
    """Tables in one SQLite file on the driver, streamed partition by partition; nested values become JSON.  keys: columns to
    index by table.  A table of that name is replaced."""
    import sqlite3

    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL"}
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
            flat = df.withColumns({c: F.to_json(c) for c in nested})
            columns = ", ".join(f'"{c}" {kinds.get(k, "TEXT" if c in nested else "INTEGER")}' for c, k in df.dtypes)
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" ({columns})')
            rows, put = [], f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})'
            for r in flat.toLocalIterator():
                rows.append(tuple(r))
                if len(rows) == batch:
                    db.executemany(put, rows)
                    rows = []
            db.executemany(put, rows)
            for c in (keys or {}).get(name, []):
                db.execute(f'CREATE INDEX "{name}_{c}" ON "{name}" ("{c}")')


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink; arrays and maps become JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


class Manifest:
    """Artifacts with a short content digest and the stages they complete (driver-side JSON)."""

    def __init__(self, entries: dict | None = None):
        self.entries: dict[str, dict] = entries or {}

    @staticmethod
    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()[:16]

    def register(self, name: str, stage_name: str, path: str, data: bytes) -> None:
        self.entries[name] = {"stage": stage_name, "path": path, "sha256": self.digest(data), "bytes": len(data)}

    def verify(self, name: str, data: bytes) -> bool:
        return self.entries.get(name, {}).get("sha256") == self.digest(data)

    def complete(self, stage_name: str, needed: list[str]) -> bool:
        return all(self.entries.get(n, {}).get("stage") == stage_name for n in needed)

    def dumps(self) -> str:
        return json.dumps(self.entries, indent=1, sort_keys=True)
