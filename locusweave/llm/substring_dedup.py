"""Repeated-passage removal by level-wise doubling.

Levels are runs of a quarter of the window, of half of it and of the whole.  A level below the window looks up one run
for each window that is left, its minimizer (the run with the least hash), so equal windows always look up the same
run, and a run that occurs once in the corpus rules out every window it stands for.  What is repeated at that length
alone is extended to twice that length and looked up again; whole windows are looked up each, by 128 hash bits, with
their earliest start.  Longer repeats are followed by doubling on (`longest_repeats`), until no candidate survives.

Documents are dealt into blocks of some MB by a hash of doc_id.  A block sends each
distinct run or window once, with its first place, so a passage that a third of all
rows share arrives as one row per block.

Defined cases: null or empty text has no words; equal windows inside one document
count, the earlier start stays; rows with the same doc_id count as documents in order
of their text; a null doc_id comes after all others; extra columns are ignored; a very long text makes
its block as large as itself (about 60 bytes of memory a word); an empty table gives no rows."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import as_bytes, estimated_bytes, materialize, parts, small_batches
from locusweave.llm.words import chunks, inside, minimizers, window_hashes, word_hashes

BLOCK = 6 << 20  # stored bytes of a block
WHOLE = "g1 bigint, g2 bigint, block int, doc bigint, twice boolean"


def _ordered(table: pa.Table) -> tuple[list, list[bytes]]:
    """doc_ids and texts of a block in document order."""
    ids = table["_id"].to_pylist()
    docs = as_bytes(table["_text"])
    order = sorted(range(len(docs)), key=lambda i: (ids[i] is None, ids[i] or 0, docs[i]))
    return [ids[i] for i in order], [docs[i] for i in order]


def _scan(docs: list[bytes], k: int):
    """Per chunk: (first doc, both word hashes, words per doc, window starts inside documents)."""
    for first, some in chunks(docs):
        h, g, count = word_hashes(some)
        yield first, h, g, count, inside(count, k)


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of x in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    n = parts(estimated_bytes(docs), BLOCK, 2)
    place = F.coalesce(F.xxhash64(id_col), F.lit(0)) if id_col else F.lit(0)
    place = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(place)
    return small_batches(docs).select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"),
        F.pmod(place, F.lit(4 * n)).cast("int").alias("block"),
    ).repartition(n, "block")


def _alive(h: np.ndarray, ok: np.ndarray, window: int, run: int, known: np.ndarray | None) -> np.ndarray:
    """ok without the windows whose minimizer of run words is not known."""
    if known is None:
        return ok
    return ok & _isin(window_hashes(h, run), known)[minimizers(window_hashes(h, run), window - run + 1)]


def _sampled(table: pa.Table, window: int, run: int, below: int, known: np.ndarray | None) -> pa.Table:
    """(h, block, twice): the runs that stand for a block's windows left by the level below; twice where the block
    itself repeats one."""
    found = []
    for _, h, _, _, ok in _scan(_ordered(table)[1], window):
        if len(ok) and (left := _alive(h, ok, window, below, known)).any():
            runs = window_hashes(h, run)
            found.append(runs[np.unique(minimizers(runs, window - run + 1)[left])])
    h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
    block = table["block"][0].as_py() if table.num_rows else 0
    return pa.table({"h": h.view(np.int64), "block": pa.array([block] * len(h), pa.int32()), "twice": n > 1})


def _whole(table: pa.Table, window: int, below: int, known: np.ndarray | None) -> pa.Table:
    """(g1, g2, block, doc, twice): the windows left by the level below, each distinct one once, with the first document
    it starts in here."""
    ids, docs = _ordered(table) if table.num_rows else ([], [])
    rows = []
    for first, h, g, count, ok in _scan(docs, window):
        starts = np.flatnonzero(_alive(h, ok, window, below, known)) if len(ok) else ok
        if len(starts):
            doc = np.searchsorted(np.cumsum(count), starts, "right")
            rows.append((window_hashes(h, window, 1)[starts], window_hashes(g, window, 2)[starts], doc + first))
    g1, g2, doc = map(np.concatenate, zip(*rows)) if rows else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)]
    _, at, n = np.unique(g1, return_index=True, return_counts=True)  # the first place of each
    block = table["block"][0].as_py() if table.num_rows else 0
    return pa.table({
        "g1": g1[at].view(np.int64), "g2": g2[at].view(np.int64), "block": pa.array([block] * len(at), pa.int32()),
        "doc": pa.array([ids[i] for i in doc[at]], pa.int64()), "twice": n > 1,
    })


def _candidates(blocks: DataFrame, window: int) -> DataFrame:
    """(g1, g2, block, doc, twice) of the windows whose runs of every level are repeated.  g1 (64 bits) tells windows of
    one block apart, g1 and g2 (128 bits) those of the corpus."""
    known, below = None, 0
    for run in [r for r in (window // 4, window // 2) if r]:
        sampled = _of_blocks(blocks, known, _sampled, "h bigint, block int, twice boolean", window, run, below)
        known = sampled.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1 or twice").select("block", "h")
        below = run
    return _of_blocks(blocks, known, _whole, WHOLE, window, below)


def _of_blocks(blocks: DataFrame, known: DataFrame | None, fn, kind: str, *sizes: int) -> DataFrame:
    """fn(block, *sizes, hashes known in it or None) of every block."""

    def alone(table: pa.Table) -> pa.Table:
        return fn(table, *sizes, None)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left if right.num_rows else left.slice(0, 0), *sizes, np.sort(right["h"].to_numpy().view(np.uint64)))

    if known is None:
        return blocks.groupBy("block").applyInArrow(alone, kind)
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(met, kind)


def later_windows(blocks: DataFrame, window: int) -> DataFrame:
    """(block, g1): windows of the block of which an earlier one starts in another block.  A window
    arrives once per block, and equal doc_ids lie in one block, so document order decides."""
    first = Window.partitionBy("g1", "g2").orderBy(F.col("doc").asc_nulls_last(), "block")
    places = _candidates(blocks, window).drop("twice")
    return places.withColumn("n", F.row_number().over(first)).filter("n > 1").select("block", "g1")


def repeated_windows(blocks: DataFrame, window: int, sift: bool = True) -> DataFrame:
    """(block, g1): windows of the block that start anywhere else too.  sift: whether runs are looked up before windows."""
    again = F.count("*").over(Window.partitionBy("g1", "g2"))
    places = _candidates(blocks, window) if sift else _of_blocks(blocks, None, _whole, WHOLE, window, 0)
    return places.withColumn("n", again).filter("n > 1 or twice").select("block", "g1")


def remove_repeats(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256, kept_text (the words
    outside repeated windows, joined by one space)."""
    blocks = _blocks(docs, id_col, text_col)
    later = later_windows(blocks, window)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _ordered(left) if left.num_rows else ([], [])
        key = np.sort(right["g1"].to_numpy().view(np.uint64))
        keys, held = [], []
        for first, h, _, count, ok in _scan(texts, window):
            held.append((first, count, np.flatnonzero(ok)))
            keys.append(window_hashes(h, window, 1)[held[-1][2]])
        every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        gone = np.zeros(len(every), bool)
        same = np.flatnonzero(every[order][1:] == every[order][:-1]) + 1
        gone[order[same]] = True
        gone |= _isin(every, key)
        n_words, n_removed, sha, kept_text = [], [], [], []
        at = 0
        for first, count, starts in held:
            hit = starts[gone[at : at + len(starts)]]
            at += len(starts)
            cover = np.zeros(int(count.sum()) + window + 1, np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            keep = np.cumsum(cover)[: int(count.sum())] == 0
            ends = np.cumsum(count)
            for i, n in enumerate(count.tolist()):
                mine = keep[ends[i] - n : ends[i]]
                words = texts[first + i].split()
                left_over = int(mine.sum())
                line = b" ".join(words if left_over == n else compress(words, mine.tolist()))
                n_words.append(n)
                n_removed.append(n - left_over)
                sha.append(hashlib.sha256(line).hexdigest())
                kept_text.append(line)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept_text, pa.binary()).cast(pa.string()),
        })

    out = blocks.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    )
    return out.withColumnRenamed("doc_id", id_col)


def longest_repeats(
    docs: DataFrame, start: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, level, first_word, n_words): passages that windows of `level` words repeated somewhere
    cover, for level start, 2*start, ... until no candidate survives.

    Only passages in which two adjoining windows of a level are repeated go on to the next
    level, as texts of their own, so each level reads what the last one left.  There shorter runs are repeated nearly all: they
    are looked up at the first level alone."""
    left = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.lit(0).cast("bigint").alias("_at"), F.col(text_col).alias("_text"))
    told, level = [], start
    while True:
        found = materialize(_level(left, level, level == start), "repeats")
        told.append(found.filter("not going").select(F.col("_id").alias(id_col), F.lit(level).alias("level"), F.col("_at").alias("first_word"), F.col("n").alias("n_words")))
        left = found.filter("going").select("_id", "_at", "_text")
        if left.isEmpty():
            break
        level *= 2
    out = told[0]
    for one in told[1:]:
        out = out.unionByName(one)
    return out


def _level(texts: DataFrame, window: int, first: bool) -> DataFrame:
    """Passages of texts(_id, _at, _text) covered by repeated windows (going false, no text), and those that can
    hold a repeated window of twice the length (going true)."""
    # what repeats is packed tightly, so its stored size says little of the work that is left
    n = parts(estimated_bytes(texts), BLOCK, 2 if first else max(2, texts.sparkSession.sparkContext.defaultParallelism))
    blocks = texts.select("_id", "_at", "_text", F.pmod(F.xxhash64("_id", "_at"), F.lit(4 * n)).cast("int").alias("block")).repartition(n, "block")
    again = repeated_windows(blocks, window, first)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, ats, docs = left["_id"].to_pylist(), left["_at"].to_pylist(), as_bytes(left["_text"])
        key = np.sort(right["g1"].to_numpy().view(np.uint64))
        rows = []
        for first, h, _, count, ok in _scan(docs, window) if len(key) else ():
            hit = np.zeros(len(h) + window, bool)
            hit[: len(ok)] = ok & _isin(window_hashes(h, window, 1), key)
            ends = np.cumsum(count)
            for i, (e, m) in enumerate(zip(ends.tolist(), count.tolist())):
                mine = hit[e - m : e]
                words = None
                for going, starts, size in ((False, mine, window), (True, mine[:-window] & mine[window:] if m > window else mine[:0], 2 * window)):
                    at = np.flatnonzero(starts)
                    if not len(at):
                        continue
                    cuts = np.flatnonzero(np.diff(at) > size) + 1
                    for run_ in np.split(at, cuts):
                        a, b = int(run_[0]), int(run_[-1]) + size
                        words = words or docs[first + i].split()
                        text = b" ".join(words[a:b]).decode() if going else None
                        rows.append((ids[first + i], ats[first + i] + a, b - a, going, text))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_id", "_at", "n", "going", "_text"])

    return blocks.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(
        run, "_id bigint, _at bigint, n bigint, going boolean, _text string"
    )
