"""Token-id output: Parquet list columns with controlled encoding, row groups and page index.

Documents are range-partitioned by doc_id (nulls first) and sorted, encoded with a public
vocabulary file and written as one Parquet row per document: part, local_start, n_tokens and
the id list.  Ids are dictionary-encoded (their codes are bit-packed runs), positions are
delta-encoded; row groups and pages are small enough that a reader of the metadata
columns or of a doc_id range touches few pages.  Start positions of whole documents
come from the sums of the parts, which are read from the narrow columns only.

A null text counts as empty (its row holds the end id alone).  Rows with the same
doc_id follow each other in order of their text; they lie in one part, as their ids must follow each other, and so do all rows
without one.  A very long text is encoded whole and is one row.  Extra columns are ignored; an empty table gives no
rows.  The starts of the parts are summed in one task: one row for each written file."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.llm.common import estimated_bytes, give_back, parts, shared_path, small_batches
from locusweave.llm.words import word_spans

PARQUET = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
}
_loaded: dict[str, Encoder] = {}
_MARKS = frozenset(".,;:!?")  # one of them after letters at the end of a piece is tokenized on its own
_CONTROL = "\x1c\x1d\x1e\x1f"  # white space by some counts, not for the tokenizer
_LATIN_SPACE = np.zeros(256, bool)
_LATIN_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = True


def _byte_level() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian uint32, through a bounded cache of space-separated pieces.

    Valid for tokenizers whose normalizer and pre-tokenizer act on each piece alone; the file's
    normalizer must lower-case.  Latin-1 texts are lower-cased as a whole and cut into pieces by their
    bytes; the pieces of a chunk are looked up by hash in sorted arrays (about 40 bytes a piece) and must agree in a second
    hash: pieces of up to seven bytes are their own hash, longer ones have 128 bits of XXH3.  A chunk with a piece that agrees
    in the first one only goes through the whole tokenizer, as do texts beyond Latin-1.  New pieces of letters go straight
    to the file's BPE model, other pieces through the whole tokenizer."""

    LIMIT = 500_000  # pieces kept
    CHUNK = 500_000  # characters encoded at a time

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = _byte_level()
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS}
        self.clock = 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.check, self.used = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that are not known yet."""
        alphabet, model = self.alphabet, self.tokenizer.model.tokenize
        out: list = [None] * len(pieces)
        slow = []
        for i, p in enumerate(pieces):
            core, tail = (p[:-1], self.marks[p[-1]]) if p[-1] in _MARKS else (p, [])
            if core.isalpha() and core.islower():
                raw = core if core.isascii() else core.encode().decode("latin-1").translate(alphabet)
                out[i] = [t.id for t in model(raw)] + tail
            else:
                slow.append(i)
        for begin in range(0, len(slow), 5000):
            some = slow[begin : begin + 5000]
            for i, ids in zip(some, self._slow([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _shrink(self) -> None:
        """Keep the half of the pieces that was used last."""
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        at, size = self.at[keep], self.size[keep].astype(np.int64)
        begin = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(at - begin, size) + np.arange(int(size.sum()))]
        self.keys, self.check, self.used, self.at, self.size = self.keys[keep], self.check[keep], self.used[keep], begin, self.size[keep]

    def _learn(self, joined: bytes, start: np.ndarray, stop: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Put sorted new keys, whose pieces lie at start..stop, into the cache."""
        pieces = [joined[a:b].decode("latin-1") for a, b in zip(start.tolist(), stop.tolist())]
        ids = self._new(pieces)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        at = np.cumsum(size, dtype=np.int64) - size + len(self.flat)
        place = np.searchsorted(self.keys, key)
        self.keys, self.check, self.at = np.insert(self.keys, place, key), np.insert(self.check, place, check), np.insert(self.at, place, at)
        self.size, self.used = np.insert(self.size, place, size), np.insert(self.used, place, self.clock)
        self.flat = np.concatenate([self.flat, flat])

    def _known(self, docs: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts."""
        joined, start, stop, h, g, count = word_spans(docs, _LATIN_SPACE)
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        self.clock += 1
        if len(self.keys) > self.LIMIT:
            self._shrink()
        place = np.searchsorted(self.keys, key)
        new = place == len(self.keys)
        new[~new] = self.keys[place[~new]] != key[~new]
        if new.any():
            self._learn(joined, start[first[new]], stop[first[new]], key[new], g[first[new]])
            place = np.searchsorted(self.keys, key)
        if not np.array_equal(self.check[place][back], g):
            return [np.array(ids, "<u4").tobytes() for ids in self._slow([d.decode("latin-1") for d in docs])]
        self.used[place] = self.clock
        at, size = self.at[place][back], self.size[place][back].astype(np.int64)
        begin = np.cumsum(size) - size
        total = int(size.sum())
        raw = self.flat[np.repeat(at - begin, size) + np.arange(total)].astype("<u4", copy=False).tobytes()
        edge = np.concatenate((begin, [total]))[np.concatenate(([0], np.cumsum(count)))] * 4
        return [raw[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist())]

    @staticmethod
    def _plain(text: str) -> bytes | None:
        """Lower-cased Latin-1 bytes, or None for a text that is encoded as a whole."""
        if "<" in text or any(c in text for c in _CONTROL):
            return None
        try:
            return text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            stop, size = begin, 0
            while stop < len(texts) and size < self.CHUNK:
                size += len(texts[stop]) + 1
                stop += 1
            plain = [self._plain(t) for t in texts[begin:stop]]
            known = iter(self._known([p for p in plain if p is not None]))
            odd = iter(self._slow([t for t, p in zip(texts[begin:stop], plain) if p is None]))
            out += [next(known) if p is not None else np.array(next(odd), "<u4").tobytes() for p in plain]
            begin = stop
        return out


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 1,
    id_col: str = "doc_id", text_col: str = "text", options: dict[str, str] = PARQUET,
) -> None:
    """Write (part, doc_id, local_start, n_tokens, token_ids) in ascending id_col order under path."""
    n = parts(estimated_bytes(docs), 6 << 20)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    dealt = small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    dealt = dealt.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            step = max(1, int(whole.num_rows * min(1.0, 4e6 / max(1, whole.nbytes))))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                blobs = [b + end for b in coder.encode(texts)]
                size = np.array([len(b) >> 2 for b in blobs], np.int64)
                ids = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                starts = at + np.cumsum(size) - size
                at += int(size.sum())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(blobs), part, np.int32)), "doc_id": batch.column(0), "local_start": pa.array(starts),
                    "n_tokens": pa.array(size), "token_ids": pa.ListArray.from_arrays(offsets, ids),
                })
        give_back()

    dealt.mapInArrow(
        run, "part int, doc_id bigint, local_start bigint, n_tokens bigint, token_ids array<int>"
    ).write.options(**options).parquet(path)


SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, token_ids array<int>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, start) without touching the id lists."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("part", "doc_id", "local_start", "n_tokens")
    return _placed(rows, rows)


def _placed(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """rows with start; the parts (one row for each written file) are summed in order."""
    sums = narrow.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "part").withColumn("start", F.col("_before") + F.col("local_start"))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the written files."""
    rows = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at = lists.offsets.to_numpy().tolist()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_pydict({
                "part": batch.column(0), "doc_id": batch.column(1), "local_start": batch.column(2),
                "n_tokens": batch.column(3), "ids_crc32": pa.array(crc, pa.int64()),
            })

    digests = rows.mapInArrow(run, "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return _placed(digests, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, vocabulary: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of docs to the shared folder and read each document's digest back."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_tokens(docs, vocabulary, path, end_id, id_col, text_col)
    return read_digest(docs.sparkSession, path)
