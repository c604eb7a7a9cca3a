"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64-bit majority votes over XXH64 word-shingle hashes.  Distinct
fingerprints meet in buckets that share chosen bit blocks: with radius r and r+e
blocks, any pair within r bits agrees on at least e whole blocks, so the C(r+e, e)
block sets lose no pair.  In a bucket the bits stand as vertical planes; a block of
queries is compared with 64 fingerprints per machine word, distances grow in
carry-save counters, and words of which all lanes exceed the radius are abandoned.
Each bucket reports a star per local component, never all pairs of a group.

Null and empty texts have fingerprint zero and are linked like any other.  Repeated
rows share a fingerprint.  Rows with a null doc_id link others and get the component
of their fingerprint.  Ties do not arise: the least doc_id names a component.  A very long text is one list of its shingles'
hashes (8 bytes a word, the words as Python strings beside).  Extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import as_bytes, estimated_bytes, materialize, parts, per_table, small_batches, sorted_groups
from locusweave.llm.words import mix
from locusweave.operators.graph import connected_components

TILE = 2048  # fingerprints that one comparison holds on a side
BUCKET = 2048  # fingerprints aimed at in a bucket


def _majority(h: np.ndarray) -> int:
    """Bits that more than half of the hashes set."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int, copies: int = 1) -> list[int]:
    """64-bit SimHashes of one text: A-Z lower-cased, shingles of width words, repeats count.
    The first is over the XXH64 hashes themselves, the others over remixed ones."""
    words = text.lower().split()
    if not words:
        return [0] * copies
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    k = min(width, len(words))
    begin = (stop - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        [digest(line[a:b], 42) for a, b in zip(begin, stop[k - 1 :].tolist())], np.uint64, len(begin)
    )
    return [_majority(mix(h, c) if c else h) for c in range(copies)]


def _names(copies: int) -> list[str]:
    return ["fp", *(f"fp{c}" for c in range(1, copies))]


def fingerprints(
    docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", copies: int = 1
) -> DataFrame:
    """(id_col, fp bigint, and fp1, fp2, ... for further copies) of every row."""
    names = _names(copies)

    def run(table: pa.Table) -> pa.Table:
        found = np.array([fingerprint(t, width, copies) for t in as_bytes(table["_text"])], np.uint64).reshape(-1, copies)
        return pa.table({id_col: table[id_col]} | {n: np.ascontiguousarray(found[:, c]).view(np.int64) for c, n in enumerate(names)})

    kind = dict(docs.dtypes)[id_col]
    return small_batches(docs).select(id_col, F.col(text_col).alias("_text")).mapInArrow(
        per_table(run), ", ".join([f"`{id_col}` {kind}", *(f"{n} bigint" for n in names)])
    )


def block_sets(radius: int, n: int) -> tuple[int, list[tuple[int, ...]], int]:
    """(number of blocks, the block sets that are keys, bits of a key that are used)."""
    for equal in range(1, 5):
        m = radius + equal
        bits = (64 // m) * equal
        if n <= BUCKET << bits or equal == 4:
            break
    used = min(bits, max(0, math.ceil(math.log2(max(1, n / BUCKET)))))
    return m, list(combinations(range(m), equal)), used


def _keys(nodes: DataFrame, radius: int, n: int, copies: int) -> DataFrame:
    """(key, node, fp, fp1, ...): fp is the copy that the key was cut from, the others follow."""
    m, sets, used = block_sets(radius, n)
    edges = [64 * i // m for i in range(m + 1)]
    names, out = _names(copies), []
    for copy in range(copies):
        turned = [F.col(names[(copy + i) % copies]).alias(names[i]) for i in range(copies)]
        for number, chosen in enumerate(sets):
            each, rest = divmod(used, len(chosen))
            key = F.lit(copy << 12 | number).cast("bigint")
            for place, b in enumerate(chosen):
                take = each + (place < rest)
                if take:
                    part = F.shiftrightunsigned(names[copy], edges[b]).bitwiseAND(F.lit((1 << take) - 1))
                    key = F.shiftleft(key, take).bitwiseOR(part)
            out.append(F.struct(key.alias("key"), "node", *turned))
    return nodes.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def _planes(fp: np.ndarray) -> np.ndarray:
    """Vertical planes: row b holds bit b of all fingerprints, 64 of them per word."""
    lanes = -(-len(fp) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) within radius bits, by carry-save bit-sliced counters."""
    planes = _planes(b)
    width = max(3, (radius + 1).bit_length())
    tail = (_ALL >> np.uint64(-len(b) % 64)) if len(b) % 64 else _ALL
    asked = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)

    def save(x, y, z):
        """Three words of equal weight as (carry, sum)."""
        half = x ^ y
        return (x & y) | (half & z), half ^ z

    def add(count, over, x):
        """Eight planes into the counters: a tree of carry-save adders up to the eights, which then ripple on."""
        ones, twos, fours = count[:3]
        pair, ones = save(ones, x[0], x[1])
        pair_, ones = save(ones, x[2], x[3])
        four, twos = save(twos, pair, pair_)
        pair, ones = save(ones, x[4], x[5])
        pair_, ones = save(ones, x[6], x[7])
        four_, twos = save(twos, pair, pair_)
        carry, fours = save(fours, four, four_)
        count[:3] = ones, twos, fours
        for level in range(3, width):
            carry, count[level] = carry & count[level], carry ^ count[level]
        over |= carry

    def exceeds(count, over):
        """Lanes whose counter is more than radius, compared bit by bit from the top."""
        more, same = over.copy(), ~over
        for level in range(width - 1, -1, -1):
            if radius >> level & 1:
                same &= count[level]
            else:
                more |= same & count[level]
                same &= ~count[level]
        return more

    step = max(1, (1 << 15) // planes.shape[1])
    for q in range(0, len(a), step):
        flip = np.where(asked[q : q + step], _ALL, np.uint64(0))
        shape = (flip.shape[0], planes.shape[1])
        count = [np.zeros(shape, np.uint64) for _ in range(width)]
        over = np.zeros(shape, np.uint64)
        rows = cols = None
        for b0 in range(0, 64, 8):
            x = [planes[bit][None, :] ^ flip[:, bit][:, None] if rows is None else planes[bit][cols] ^ flip[rows, bit] for bit in range(b0, b0 + 8)]
            add(count, over, x)
            if b0 < 8 and radius >= 8:
                continue  # no lane can exceed it yet
            gone = exceeds(count, over)
            if rows is None:
                alive = gone != _ALL
                if b0 >= 56 or alive.mean() < 0.5:
                    rows, cols = np.nonzero(alive)
                    count = [c[rows, cols] for c in count]
                    over = over[rows, cols]
            else:
                alive = np.flatnonzero(gone != _ALL)
                rows, cols, over = rows[alive], cols[alive], over[alive]
                count = [c[alive] for c in count]
            if rows is not None and not len(rows):
                break
        if rows is None or not len(rows):
            continue
        near = ~exceeds(count, over)
        near[cols == planes.shape[1] - 1] &= tail
        hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(hit)
        if len(at):
            yield rows[at] + q, cols[at] * 64 + lane


def _spanning(
    node: np.ndarray, fps: list[np.ndarray], side: np.ndarray, radius: int, total: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its local component) for the rows of one bucket that link.  side: of two tiles, which
    are compared with each other; equal throughout in a single one."""
    order = np.argsort(node, kind="stable")
    node, side, fps = node[order], side[order], [f[order] for f in fps]
    if side[0] == side.min() == side.max():
        one = two = np.arange(len(node))
    else:
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    label = np.arange(len(node))
    for i, j in close_pairs(fps[0][one], fps[0][two], radius):
        i, j = one[i], two[j]
        if total is not None:
            far = sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int32) for f in fps)
            i, j = i[far <= total], j[far <= total]
        while len(i):
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return node[linked], node[label[linked]]


def links(nodes: DataFrame, radius: int, n: int, size: int, copies: int = 1, total: int | None = None) -> DataFrame:
    """Edges (u, v) between nodes(node, fp, fp1, ...), at least one spanning tree of each component.

    Two nodes link if some copy of their fingerprints is within radius and (if given) all copies together
    are within total.  n: number of nodes; size: partitions."""
    names = _names(copies)
    keyed = _keys(nodes, radius, n, copies)
    hot = keyed.groupBy("key").count().filter(F.col("count") > TILE)
    tiles = F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)).cast("int")
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("t", tiles)
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select(
            "key", F.least("tile", "o").alias("lo"), F.greatest("tile", "o").alias("hi"),
            (F.col("tile") > F.col("o")).cast("int").alias("side"), "node", *names,
        )
        .repartition(size, "key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "lo", "hi"]):
            if group.num_rows > 1:
                fps = [group[f].to_numpy().view(np.uint64) for f in names]
                a, b = _spanning(group["node"].to_numpy(), fps, group["side"].to_numpy(), radius, total)
                if len(a):
                    yield pa.record_batch({"u": a, "v": b})

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", copies: int = 1, total: int | None = None
) -> DataFrame:
    """One row per document: id_col, fp (bigint), component_id: the least id_col reachable over links.

    With one copy a link is a pair of fingerprints within radius bits.  Further copies (fingerprints over
    remixed shingle hashes) lower the chance to miss a similar pair, and `total` bounds the distance over all of
    them, which lowers the chance to link a dissimilar one; nodes are then named by a 64-bit hash of their copies."""
    names = _names(copies)
    held = fingerprints(docs, width, id_col, text_col, copies)
    held = materialize(held.withColumn("_node", F.col("fp") if copies == 1 else F.xxhash64(*names)), "simhash-fp")
    nodes = held.groupBy(F.col("_node").alias("node")).agg(F.min(id_col).alias("_rep"), *[F.min(f).alias(f) for f in names])
    nodes = materialize(nodes, "simhash-nodes")
    n = nodes.count()
    size = parts(estimated_bytes(docs), 16 << 20, 4)
    roots = connected_components(links(nodes.drop("_rep"), radius, n, size, copies, total))
    linked = nodes.select("node", "_rep").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("_rep").alias("_least"))
    named = linked.join(least, "root").select("node", "_least")
    label = nodes.join(named, "node", "left").select(F.col("node").alias("_node"), F.coalesce("_least", "_rep").alias("component_id"))
    return held.join(label, "_node").select(id_col, "fp", "component_id")
