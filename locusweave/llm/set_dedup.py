"""Groups of texts by SimHash and exact similarity of their shingle sets (Jaccard, 0.8 or more).

Candidates share one of BANDS MinHash bands of ROWS minima each: a pair at 0.8 shares none with a chance below 1e-6,
more similar ones with less.  (SimHash bits alone are no index here: at 0.8 ten of 64 bits differ on average.)  A band ties each
text to the least one of it, never all pairs; what hangs together that way comes to one task, or is dealt into tiles where it is
large.  In a tile the 64-bit SimHashes of the sets stand as bit planes and are compared by carry-save counters (`close_pairs`);
texts within RADIUS bits are verified by the exact similarity of their sets over an inverted index.  Only pairs that pass link, and pairs
that others connect already are not looked at.

Large groups take rounds: each tile leaves one leader for each of its groups, and the leaders meet in tiles of their own, until they
fit one.  Then only texts outside the largest group of their candidates are left to compare with the other tiles.  So a group
of copies, however large, moves its sets a few times and never meets itself in pairs of tiles.  Candidates that are dissimilar in the
large would be compared tile by tile: that work is a square, as it must be to lose no link.

Words are split at ASCII space, A-Z count as lower case; a text with fewer words than a shingle is one shingle of
them all.  Texts with equal sets are one node; null and wordless texts are one too, linked to no other.  A very long text is one
set of its shingles (8 bytes each); an empty table gives no rows; rows with a null id and repeated rows are rows like any other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import as_bytes, estimated_bytes, give_back, materialize, parts, per_table, small_batches, sorted_groups
from locusweave.llm.simhash_dedup import _majority, close_pairs
from locusweave.llm.words import mix
from locusweave.operators.graph import connected_components

BANDS, ROWS = 36, 5
RADIUS = 24  # bits: five standard deviations over the distance that similarity 0.8 gives on average
TILE = 4096  # texts that one comparison holds on a side
TILE_SHINGLES = 1 << 20  # and their shingles
SHRINKS = 0.8  # a round of leaders that leaves more of them is the last
_SALTS = (mix(np.arange(BANDS * ROWS, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(words), min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    begin = (stop - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], 42) for a, b in zip(begin, stop[k - 1 :].tolist())], np.uint64, len(begin)))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys; sets hold at least one hash."""
    least = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for row, s in zip(least, sets):
        h = (mix(s, 3) >> np.uint64(32)).astype(np.uint32)
        step = max(1, (1 << 18) // len(h))
        for i in range(0, len(_SALTS), step):
            row[i : i + step] = (h[None, :] * _SALTS[i : i + step, None]).min(axis=1)
    least = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ least[:, :, r], r)
    return key


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def _signed(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(np.asarray(values, np.uint64)).view(np.int64))


def _shared(slot: np.ndarray, first: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """How many of the shingles slot each of n sets holds, over the inverted index (first, held)."""
    count = first[slot + 1] - first[slot]
    at = np.repeat(first[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.bincount(held[at], minlength=n)


def similar_labels(
    sets: list[np.ndarray], fps: np.ndarray, asked: np.ndarray, label: np.ndarray, similarity: float, radius: int = RADIUS
) -> np.ndarray:
    """label (the index of a set of the same group) after the sets of asked have been compared with all others.

    Sets come as 64 queries at a time, whose bit-sliced distances are counted only while some of them has another group to meet."""
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    slot = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = owner[np.argsort(slot, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(slot))))
    label = label.copy()
    for begin in range(0, len(asked), 64):
        some = asked[begin : begin + 64]
        if (label == label[some[0]]).all():
            continue
        near = np.zeros((len(some), len(sets)), bool)
        for i, j in close_pairs(fps[some], fps, radius):
            near[i, j] = True
        for row, i in zip(near, some.tolist()):
            row &= label != label[i]
            if row.any():
                shared = _shared(slot[ends[i] - size[i] : ends[i]], first, held, len(sets))
                alike = row & (shared >= similarity * (size[i] + size - shared) - 1e-9)
                if alike.any():
                    met = np.isin(label, np.unique(label[alike]))
                    met |= label == label[i]
                    label[met] = label[met].min()
    return label


def _verified(table: pa.Table, similarity: float) -> pa.Table:
    """One tile of (root, t, tile, part, node, fp, sh, known, side) -> each node of side 0 once, with the least node of its group
    (the least label known before, where it has one)."""
    order = np.lexsort((table["side"].to_numpy(), table["node"].to_numpy()))  # a text of both sides counts as one that asks
    node, at = np.unique(table["node"].to_numpy()[order], return_index=True)
    table = table.take(pa.array(order[at]))
    known = table["known"].to_numpy()
    label = np.unique(known, return_inverse=True)[1]
    label = np.unique(label, return_index=True)[1][label]
    asked = np.flatnonzero(table["side"].to_numpy() == 0)
    if len(node) > 1:
        sets = [np.frombuffer(x, np.uint64) for x in table["sh"].to_pylist()]
        fps = np.ascontiguousarray(table["fp"].to_numpy()).view(np.uint64)
        label = similar_labels(sets, fps, asked, label, similarity)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, known)
    return table.append_column("label", pa.array(least[label]))


_TILED = "root bigint, t int, node bigint, fp bigint, sh binary, label bigint"


def _tiles(dealt: DataFrame, size: int, similarity: float) -> DataFrame:
    """dealt(root, t, tile, part, node, fp, sh, known, side), one task for each (root, tile, part) -> _TILED and known; sets stay with
    large candidates only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "tile", "part"]):
            done = _verified(group, similarity)
            large = done["t"][0].as_py() > 1
            sh = done["sh"] if large else pa.nulls(done.num_rows, pa.binary())
            out = pa.table([done["root"], done["t"], done["node"], done["fp"], sh, done["label"], done["known"]], names=["root", "t", "node", "fp", "sh", "label", "known"])
            yield from out.combine_chunks().to_batches(max_chunksize=1024)
        give_back()

    dealt = dealt.select("root", "t", "tile", "part", "node", "fp", "sh", "known", "side")
    dealt = dealt.repartition(size, "root", "tile", "part").sortWithinPartitions("root", "tile", "part")
    return dealt.mapInArrow(run, _TILED + ", known bigint")


def _alone(rows: DataFrame, salt: int = 0) -> DataFrame:
    """rows(root, t, node, fp, sh) dealt over the tiles of their root, each with itself as its label."""
    tile = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("t")).cast("int")
    return rows.select("root", "t", tile.alias("tile"), F.lit(0).alias("part"), "node", "fp", "sh", F.col("node").alias("known"), F.lit(0).alias("side"))


def _counted(rows: DataFrame, shingles) -> DataFrame:
    """(root, t): tiles that the rows of each root need."""
    sums = rows.groupBy("root").agg(F.count("*").alias("c"), F.sum(shingles).alias("s"))
    return sums.filter("c > 1").select("root", F.ceil(F.greatest(F.col("c") / TILE, F.col("s") / TILE_SHINGLES)).cast("int").alias("t"))


def _grouped(cand: DataFrame, texts: DataFrame, width: int, similarity: float, size: int) -> DataFrame:
    """(node, group) of cand(node, root, th, n, fp): the least node that similar pairs lead to."""
    asked = cand.join(_counted(cand, F.col("n")), "root").select("th", "root", "t", "node", "fp")
    met = texts.join(asked, "th").select("_text", "root", "t", "node", "fp")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text
        for batch in batches:
            new = []
            for i, node in enumerate(batch.column(3).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            if new:
                batch = batch.take(pa.array(new))
                sh = pa.array([shingle_set(x, width).tobytes() for x in as_bytes(batch.column(0))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], sh], ["root", "t", "node", "fp", "sh"])

    rows = met.mapInArrow(sets, "root bigint, t int, node bigint, fp bigint, sh binary")
    first = materialize(_tiles(_alone(rows), size, similarity), "near-tiles")
    small = first.filter("t = 1").select("node", F.col("label").alias("group"))
    large = first.filter("t > 1")
    if large.isEmpty():
        return small
    now, salt, links = large.filter("node = label").select("root", "node", "fp", "sh"), 0, None
    while True:
        salt += 1
        met = now.join(_counted(now, F.length("sh") / 8), "root")
        level = materialize(_tiles(_alone(met, salt), size, similarity), "near-leaders")
        found = level.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        links = found if links is None else links.unionByName(found)
        left = level.filter("t > 1 and node = label").select("root", "node", "fp", "sh")
        before, after = level.filter("t > 1").count(), left.count()
        if not after or after > SHRINKS * before:
            break
        now = left
    led = connected_components(links).withColumnsRenamed({"node": "label", "root": "known"})
    named = large.drop("known").join(led, "label", "left").select("root", "t", "node", "fp", "sh", F.coalesce("known", "label").alias("known"))
    named = materialize(named, "near-named")
    across = materialize(_across(named, size, similarity).filter("known <> label").select(F.col("known").alias("u"), F.col("label").alias("v")).distinct(), "near-across")
    joined = connected_components(across).withColumnsRenamed({"node": "known", "root": "group"})
    return small.unionByName(named.join(joined, "known", "left").select("node", F.coalesce("group", "known").alias("group")))


def _across(named: DataFrame, size: int, similarity: float) -> DataFrame:
    """Texts of named(root, t, node, fp, sh, known) outside their root's largest group, compared with all tiles of the root."""
    most = named.groupBy("root", "known").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("known", F.struct("c", "known")).alias("most"))
    strays = named.join(most, "root").filter("known <> most").drop("most")
    parts_of = strays.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("sh")) / 8 / TILE_SHINGLES)).cast("int").alias("q"))
    tile, part = F.pmod(F.xxhash64("node"), F.col("t")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("q")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    name = ["root", "t", "tile", "part", "node", "fp", "sh", "known", "side"]
    asked = strays.join(parts_of, "root").withColumns({"tile": every("t"), "part": part, "side": F.lit(0)}).select(*name)
    there = named.join(parts_of, "root").withColumns({"tile": tile, "part": every("q"), "side": F.lit(1)}).select(*name)
    return _tiles(asked.unionByName(there), size, similarity)


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, text_hash (xxhash64 of the text), and component_id and component_hash, both of
    its group's representative: the least id_col (none comes last), then the least text_hash."""
    kind = dict(docs.dtypes)[id_col]
    texts = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("th"))

    def run(table: pa.Table) -> pa.Table:
        found = [shingle_set(t, width) for t in as_bytes(table["_text"])]
        real = [s for s in found if len(s)]
        keys = iter(band_keys(real).view(np.int64) if real else [])
        bands = pa.array([next(keys) if len(s) else [] for s in found], pa.list_(pa.int64()))
        size = pa.array([len(s) for s in found], pa.int64())
        fp = _signed([_majority(s) if len(s) else 0 for s in found])
        return pa.table({"_id": table["_id"], "th": table["th"], "node": _signed([_node(s) for s in found]), "n": size, "fp": fp, "bands": bands})

    held = texts.mapInArrow(per_table(run), f"_id {kind}, th bigint, node bigint, n bigint, fp bigint, bands array<bigint>")
    held = materialize(held, "near-sets")
    rep = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "th"))
    nodes = held.groupBy("node").agg(rep.alias("rep"), F.min("th").alias("th"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    nodes = materialize(nodes, "near-nodes")
    keyed = held.select("node", F.explode("bands").alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("c")).filter("c > 1")
    met = keyed.join(least.select("key", "v"), "key")
    # Each node goes to the least one it meets; the least ones that share a band are tied, a few even where a group is large.
    low = materialize(met.groupBy("node").agg(F.min("v").alias("low"), F.collect_set("key").alias("keys")), "near-bands")
    left = low.select("low", F.explode("keys").alias("key")).distinct()
    top = left.groupBy("key").agg(F.min("low").alias("top"), F.count("*").alias("c")).filter("c > 1").select("key", "top")
    tied = left.join(top, "key").filter("low <> top").select(F.col("low").alias("u"), F.col("top").alias("v")).distinct()
    roots = connected_components(tied).withColumnRenamed("node", "low")
    placed = low.select("node", "low").join(roots, "low", "left").select("node", F.coalesce("root", "low").alias("root"))
    cand = materialize(nodes.select("node", "th", "n", "fp").join(placed, "node"), "near-candidates")
    size = parts(estimated_bytes(docs), 16 << 20, 4)
    linked = nodes.select("node", "rep").join(_grouped(cand, texts.select("_text", "th"), width, similarity, size), "node")
    best = linked.join(linked.groupBy("group").agg(F.min("rep").alias("best")), "group").select("node", "best")
    label = nodes.join(best, "node", "left").select("node", F.coalesce("best", "rep").alias("best"))
    return held.join(label, "node").select(
        F.col("_id").alias(id_col), F.col("th").alias("text_hash"), F.col("best._id").alias("component_id"), F.col("best.th").alias("component_hash")
    )
