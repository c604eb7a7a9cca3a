"""Exact duplicates through an extendible-hash index on shared files.

Each scan task merges equal texts it sees (comparing bytes) and writes entries to
shared files: one member row per document and one row with the text per local group.  The
directory starts with one bucket; a bucket over its capacity is split, doubling the
directory whenever its depth is reached, with counts refined a few key bits at a time, from the narrow columns only.
Each bucket is a key range; owner tasks take buckets (dealt by a hash, so that neighbours spread), walk the entries of a key in
order, chain different texts that collide on it and compare their bytes.

A text that a third of all rows share reaches its owner as one entry per scan task (or per HELD bytes of texts of one), and a
very long text lies whole in its entry.  A bucket whose entries all have one key cannot split and stays an overflow chain.

Defined cases: null text counts as empty; of equal texts the row with the largest
doc_id stays (null last; of rows with that same doc_id one); extra columns are
ignored; an empty table gives no rows."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import as_bytes, estimated_bytes, parts, shared_path, small_batches

CAPACITY = 1 << 20  # bytes of entries in a bucket before it splits
MOST_BUCKETS = 1 << 20  # the driver's directory stays of some MB: beyond, capacity grows with the input
TASK = 16 << 20  # stored bytes of an owner task
HELD = 48 << 20  # bytes of texts a scan task holds before it writes its groups
STEP = 10  # key bits that one refinement of the counts adds
ENTRY = "uid bigint, rep bigint, doc_id bigint, text_sha256 string, key bigint, body binary, n bigint, best bigint, best_uid bigint, size bigint"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, seen = TaskContext.get().partitionId() << 40, 0
    groups: dict[bytes, list] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        items = list(groups.items())
        for i in range(0, len(items), 2000):
            some = items[i : i + 2000]
            n = len(some)
            yield pa.RecordBatch.from_pydict({
                "uid": pa.nulls(n, pa.int64()), "rep": pa.array([g[0] for _, g in some], pa.int64()), "doc_id": pa.nulls(n, pa.int64()),
                "text_sha256": pa.nulls(n, pa.string()),
                "key": pa.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big") >> 1 for t, _ in some], pa.int64()),
                "body": pa.array([t for t, _ in some], pa.binary()), "n": pa.array([g[1] for _, g in some], pa.int64()),
                "best": pa.array([g[2] for _, g in some], pa.int64()), "best_uid": pa.array([g[3] for _, g in some], pa.int64()),
                "size": pa.array([len(t) + 64 for t, _ in some], pa.int64()),
            })
        groups.clear()
        held = 0

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        for begin in range(0, len(texts), 2000):
            uids, reps, shas = [], [], []
            for d, t in zip(ids[begin : begin + 2000], texts[begin : begin + 2000]):
                uid = base + seen
                seen += 1
                g = groups.get(t)
                if g is None:
                    g = groups[t] = [uid, 0, None, uid, hashlib.sha256(t).hexdigest()]
                    held += len(t) + 200
                g[1] += 1
                if d is not None and (g[2] is None or d > g[2]):
                    g[2], g[3] = d, uid
                uids.append(uid)
                reps.append(g[0])
                shas.append(g[4])
            n = len(uids)
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(uids, pa.int64()), "rep": pa.array(reps, pa.int64()), "doc_id": pa.array(ids[begin : begin + 2000], pa.int64()),
                "text_sha256": pa.array(shas, pa.string()), "key": pa.nulls(n, pa.int64()), "body": pa.nulls(n, pa.binary()),
                "n": pa.nulls(n, pa.int64()), "best": pa.nulls(n, pa.int64()), "best_uid": pa.nulls(n, pa.int64()), "size": pa.nulls(n, pa.int64()),
            })
            if held > HELD:
                yield from flush()
    yield from flush()


class Directory:
    """Extendible-hash directory over 63-bit keys: buckets are key ranges of 2**-depth of all keys."""

    BITS = 63

    def __init__(self):
        self.depth = 0  # of the directory: it has 2**depth slots
        self.buckets: dict[tuple[int, int], int] = {(0, 0): 0}  # (depth, prefix) -> bytes

    def split(self, bucket: tuple[int, int], halves: tuple[int, int]) -> None:
        depth, prefix = bucket
        del self.buckets[bucket]
        self.depth = max(self.depth, depth + 1)  # doubling
        for bit in (0, 1):
            self.buckets[depth + 1, prefix << 1 | bit] = halves[bit]

    def grow(self, counts: dict[int, int], bits: int, capacity: int) -> None:
        """Split overfull buckets by counts of key prefixes of that many bits."""
        keys = sorted(counts)
        sums = [0]
        for k in keys:
            sums.append(sums[-1] + counts[k])

        def weight(depth: int, prefix: int) -> int:
            low, high = prefix << (bits - depth), (prefix + 1) << (bits - depth)
            return sums[bisect.bisect_left(keys, high)] - sums[bisect.bisect_left(keys, low)]

        todo = [b for b, size in self.buckets.items() if b[0] < bits and (size > capacity or b == (0, 0))]
        while todo:
            depth, prefix = todo.pop()
            size = weight(depth, prefix)
            self.buckets[depth, prefix] = size
            if size > capacity and depth < bits:
                self.split((depth, prefix), (weight(depth + 1, prefix << 1), weight(depth + 1, prefix << 1 | 1)))
                todo += [(depth + 1, prefix << 1), (depth + 1, prefix << 1 | 1)]

    def overfull(self, capacity: int) -> list[tuple[int, int]]:
        return [b for b, size in self.buckets.items() if size > capacity and b[0] < self.BITS]

    def lows(self) -> list[int]:
        """Least key of each bucket, in key order."""
        return sorted(p << (self.BITS - d) for d, p in self.buckets)


def build_directory(entries: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Counts come to the driver by key prefix: at most 2**STEP for each bucket that is too full."""
    found, bits = Directory(), 0
    spark, weighed = entries.sparkSession, entries.select("key", "size")
    while bits < Directory.BITS:
        full, known = [p for _, p in found.overfull(capacity)], bits  # all as deep as the counts known
        bits = min(Directory.BITS, bits + STEP)
        counted = weighed.select(F.shiftright("key", Directory.BITS - bits).alias("p"), F.shiftright("key", Directory.BITS - known).alias("b"), "size")
        if known:
            counted = counted.join(spark.createDataFrame([(p,) for p in full], "b bigint"), "b", "left_semi")
        found.grow({r[0]: r[1] for r in counted.groupBy("p").agg(F.sum("size")).toLocalIterator()}, bits, capacity)
        if not found.overfull(capacity):
            break
    return found


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key -> for each entry its class; a key's chain is held, not its bucket."""
    chain: list[list] = []
    open_key = None

    def close() -> Iterator[pa.RecordBatch]:
        for _, reps, n, best, best_uid in chain:
            size = len(reps)
            yield pa.RecordBatch.from_pydict({
                "rep": pa.array(reps, pa.int64()), "keep_id": pa.array([best] * size, pa.int64()),
                "keep_uid": pa.array([best_uid] * size, pa.int64()), "group_size": pa.array([n] * size, pa.int64()),
            })

    out: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for key, body, rep, n, best, best_uid in zip(*columns):
            if key != open_key:
                out += close()
                chain, open_key = [], key
            for link in chain:
                if link[0] == body:
                    break
            else:
                link = [body, [], 0, None, best_uid]
                chain.append(link)
            link[1].append(rep)
            link[2] += n
            better = best is not None and (link[3] is None or (best, best_uid) > (link[3], link[4]))
            if better or best is None and link[3] is None and best_uid > link[4]:
                link[3], link[4] = best, best_uid
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    yield from close()


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    path = shared_path(spark, "exact-index")
    source = small_batches(docs).select(F.col(id_col).cast("bigint"), F.col(text_col))
    source.mapInArrow(_entries, ENTRY).withColumn("kind", F.when(F.col("uid").isNull(), "entry").otherwise("member")).write.option(
        "compression", "zstd"
    ).partitionBy("kind").parquet(path)
    every = spark.read.schema(ENTRY + ", kind string").parquet(path)
    entries = every.filter("kind = 'entry'")
    directory = build_directory(entries, capacity or max(CAPACITY, 4 * estimated_bytes(docs) // MOST_BUCKETS))
    lows = np.array(directory.lows(), np.int64)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = np.searchsorted(lows, b.column(0).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket.astype(np.int64))], [*b.schema.names, "bucket"])

    kinds = "key bigint, body binary, rep bigint, n bigint, best bigint, best_uid bigint"
    dealt = entries.select("key", "body", "rep", "n", "best", "best_uid").mapInArrow(owned, kinds + ", bucket bigint")
    size = max(parts(estimated_bytes(docs), TASK), min(len(lows), 4))
    classes = (
        dealt.repartition(size, "bucket")
        .drop("bucket")
        .sortWithinPartitions("key")
        .mapInArrow(_owners, "rep bigint, keep_id bigint, keep_uid bigint, group_size bigint")
    )
    members = every.filter("kind = 'member'").select("uid", "rep", "doc_id", "text_sha256")
    return members.join(classes, "rep").select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"
    )
