"""Collinear chains and blocks.

Deduplication, strand streams and size pruning are window expressions; only the dynamic
program and the greedy selection of one contig pair run in Python, over int and
double columns of that pair."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.anchors import PAIR
from locusweave.operators.graph import cut
from locusweave.operators.numbering import running_total

BLOCK = (
    "query_genome string, target_genome string, query_contig string, target_contig string, rank int, "
    "query_start int, query_end int, target_start int, target_end int, n_anchors int, chain_score double, orientation int, "
    "anchor_query_ids array<int>, anchor_target_ids array<int>, anchor_query_gene_ids array<string>, anchor_target_gene_ids array<string>"
)


def prepared(anchors: DataFrame, min_size: int = 2, pair: list[str] = PAIR) -> DataFrame:
    """Anchors with column rev: pairs of at least min_size anchors, the best anchor of each (query,
    target) place, forward and reverse streams (pairs without strands are in both), then the best of each query place."""
    group = Window.partitionBy(*pair)
    best = [F.col("similarity").desc(), "query_gene_id", "target_gene_id"]
    out = anchors.withColumn("_n", F.count("*").over(group)).filter(F.col("_n") >= min_size)
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*pair, "query_idx", "target_idx").orderBy(*best))).filter("_r = 1")
    out = out.withColumn("_strand", F.max((F.col("orientation") != 0).cast("int")).over(group))
    streams = F.when(F.col("_strand") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("orientation") < 0))
    out = out.withColumn("rev", F.explode(streams))
    stream = [*pair, "rev"]
    place = Window.partitionBy(*stream, "query_idx").orderBy(F.col("similarity").desc(), "target_idx", "query_gene_id", "target_gene_id")
    out = out.withColumn("_r", F.row_number().over(place)).filter("_r = 1")
    out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*stream))).filter(F.col("_n") >= min_size)
    return out.drop("_n", "_r", "_strand")


def _steps(q: np.ndarray, t: np.ndarray, max_gap: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, cost) of all pairs that may follow each other in a chain, by later, then the nearest earlier first.

    q rises, so a predecessor stands at most max_gap + 1 places before; each distance is one array operation."""
    later, earlier, cost = [], [], []
    for d in range(1, min(max_gap + 1, len(q) - 1) + 1):
        gap_q, gap_t = q[d:] - q[:-d] - 1, t[d:] - t[:-d] - 1
        at = np.flatnonzero((gap_q <= max_gap) & (gap_t >= 0) & (gap_t <= max_gap))
        later.append(at + d)
        earlier.append(at)
        cost.append(scale * np.log2(np.maximum(gap_q[at], gap_t[at]) + 1) if scale > 0 else np.zeros(len(at)))
    if not later:
        return (np.empty(0, int),) * 2 + (np.empty(0),)
    later, earlier, cost = map(np.concatenate, (later, earlier, cost))
    order = np.lexsort((-earlier, later))
    return later[order], earlier[order], cost[order]


def _longest(q: np.ndarray, t: np.ndarray, sim: np.ndarray, max_gap: int | None, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, score, predecessor or -1) of the best chain that ends in each anchor: the longest, of equal lengths the one with the
    larger score, of equal scores the nearest predecessor."""
    n = len(q)
    length, score, before = np.ones(n, int), sim.astype(float), np.full(n, -1)
    if max_gap is None:  # every earlier anchor may precede
        for i in range(1, n):
            gap_t = t[i] - t[:i] - 1
            fits = np.flatnonzero(gap_t >= 0)
            if len(fits):
                fits = fits[length[fits] == length[fits].max()]
                cost = scale * np.log2(np.maximum(q[i] - q[fits] - 1, gap_t[fits]) + 1) if scale > 0 else 0.0
                reach = score[fits] + sim[i] - cost
                best = fits[np.flatnonzero(reach == reach.max())[-1]]
                length[i], score[i], before[i] = length[best] + 1, reach.max(), best
        return length, score, before
    later, earlier, cost = _steps(q, t, max_gap, scale)
    edge = np.searchsorted(later, np.arange(n + 1)).tolist()
    for i in np.unique(later).tolist():
        some = earlier[edge[i] : edge[i + 1]]
        reach = score[some] + sim[i] - cost[edge[i] : edge[i + 1]]
        best = np.lexsort((-some, -reach, -length[some]))[0]
        length[i], score[i], before[i] = length[some[best]] + 1, reach[best], some[best]
    return length, score, before


def chain_program(q: np.ndarray, t: np.ndarray, sim: np.ndarray, rev: bool, max_gap: int | None, min_size: int, scale: float) -> list[list[int]]:
    """Chains (lists of indices) of anchors sorted by q, which has no repeats.

    Chains are read off longest first (then by score, then by place); a chain that is cut short by taken anchors takes its own
    even if it is too small to keep."""
    n = len(q)
    length, score, before = _longest(q, -t if rev else t, sim, max_gap, scale)
    taken, chains, back = [False] * n, [], before.tolist()
    for end in np.lexsort((np.arange(n), -score, -length)).tolist():
        at, chain = end, []
        while at >= 0 and not taken[at]:
            taken[at] = True
            chain.append(at)
            at = back[at]
        if len(chain) >= min_size:
            chains.append(chain[::-1])
    return chains


def _free(held: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether an interval meets none of held, which are disjoint and sorted."""
    at = bisect_right(held, (start, end))
    return (at == 0 or held[at - 1][1] < start) and (at == len(held) or held[at][0] > end)


def select_chains(chains: list[tuple[float, int, int, int, int]]) -> list[int]:
    """Indices accepted greedily by score: a chain whose query or target interval meets an accepted one goes."""
    kept: list[int] = []
    queries: list[tuple[int, int]] = []
    targets: list[tuple[int, int]] = []
    for i in sorted(range(len(chains)), key=lambda i: -chains[i][0]):
        _, a, b, c, d = chains[i]
        if _free(queries, a, b) and _free(targets, c, d):
            kept.append(i)
            insort(queries, (a, b))
            insort(targets, (c, d))
    return kept


def pair_blocks(pdf: pd.DataFrame, pair: list[str], max_gap: int | None, min_size: int, scale: float, select: bool = True) -> pd.DataFrame:
    """Blocks of one contig pair."""
    columns = ("query_idx", "target_idx", "similarity", "query_gene_id", "target_gene_id")
    data = [pdf[c].to_numpy() for c in columns]
    reverse = pdf["rev"].to_numpy()
    found = []
    for rev in (False, True):
        at = np.flatnonzero(reverse == rev)
        if len(at) < min_size:
            continue
        at = at[np.argsort(data[0][at], kind="stable")]
        q, t, sim, qg, tg = (c[at] for c in data)
        for chain in chain_program(q, t, sim, rev, max_gap, min_size, scale):
            cq, ct = q[chain], t[chain]
            found.append((float(np.cumsum(sim[chain])[-1]), int(cq.min()), int(cq.max()), int(ct.min()), int(ct.max()), -1 if rev else 1, cq, ct, qg[chain], tg[chain]))
    kept = select_chains([f[:5] for f in found]) if select else range(len(found))
    key = [pdf[c].iat[0] for c in pair]
    rows = []
    for rank, i in enumerate(kept):
        score, a, b, c, d, turn, *members = found[i]
        rows.append([*key, rank, a, b, c, d, len(members[0]), score, turn, *(sorted(m.tolist()) for m in members)])
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in BLOCK.split(", ")])


def blocks(anchors: DataFrame, max_gap: int | None = 2, min_size: int = 2, gap_penalty: float = 0.0, select: bool = True, first_id: int = 0) -> DataFrame:
    """Non-overlapping collinear blocks; block_id follows contig pair, then acceptance."""
    ready = prepared(anchors, min_size).select(*PAIR, "rev", "query_idx", "target_idx", "query_gene_id", "target_gene_id", "similarity")
    found = ready.groupBy(*PAIR).applyInPandas(lambda pdf: pair_blocks(pdf, PAIR, max_gap, min_size, gap_penalty, select), BLOCK)
    return number_blocks(cut(found), first_id)


def number_blocks(found: DataFrame, first_id: int = 0) -> DataFrame:
    """Sequential block_id: contig pairs are numbered by a running sum of their counts, blocks within by rank."""
    counts = found.groupBy(*PAIR).agg(F.count("*").alias("_n"))
    starts = running_total(counts, PAIR, "_n", "_before").drop("_n")
    return found.join(starts, PAIR).withColumn("block_id", F.col("_before") + F.col("rank") + F.lit(first_id)).drop("_before", "rank")


def gt_chain_program(q: np.ndarray, t: np.ndarray, max_gap: int, min_size: int) -> list[list[int]]:
    """Ground-truth variant: longest runs only, both directions, read off from the end without
    stopping at anchors that an earlier chain holds.  Query places may repeat."""
    out = []
    for sign in (1, -1):
        order = np.lexsort((sign * t, q))
        qs, ts = q[order], sign * t[order]
        n = len(qs)
        length, before = np.ones(n, int), np.full(n, -1)
        low, high = np.searchsorted(qs, qs - max_gap - 1, "left"), np.searchsorted(qs, qs, "left")
        for i in range(n):
            gap = ts[i] - ts[low[i] : high[i]] - 1
            fits = low[i] + np.flatnonzero((gap >= 0) & (gap <= max_gap))
            if len(fits):
                best = fits[np.flatnonzero(length[fits] == length[fits].max())[-1]]
                length[i], before[i] = length[best] + 1, best
        used: set[int] = set()
        for end in sorted(range(n), key=lambda i: -length[i]):
            if end in used or length[end] < min_size:
                continue
            at, chain = end, []
            while at >= 0:
                chain.append(at)
                at = before[at]
            used.update(chain)
            out.append([int(order[i]) for i in chain[::-1]])
    return out
