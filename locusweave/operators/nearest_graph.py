"""Approximate nearest neighbours by navigable graphs, one in each piece of a k-means cell.

A piece's graph links each vector to its nearest ones, but not to two that are closer to each other than to it, and back; what
cannot be reached from the entries is linked to its closest vector that can, so a walk may end anywhere.  The graph is written as
neighbour lists in Parquet (links: places of a piece's rows in order of id).  A search walks with a beam: the best vector not yet
expanded is expanded next, until all of the beam are.  All queries of a batch walk in step, as arrays.  A cell above PIECE_ROWS is
cut into pieces; a query of that cell walks in each of them.  Where a search measures that walks would have to meet much of
the base, as without structure, the cells are compared whole by tiles instead: a vector met on a walk costs hundreds of times what it costs there."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.graph import checkpoint_folder, cut
from locusweave.operators.nearest import DIGITS, PROBED, RECALL, Cells, _probed, asked_of, in_cells, lloyd, measured_probes, meet_cells, nearest_exact, sample, top, unit, unit_rows, visits

PIECE_ROWS = 8192  # vectors of a graph; a cell above it is cut
DEGREE = 8  # links that a vector chooses; at most twice as many with those back
BEAM = 16  # vectors kept during a walk, for k of 10; measured searches widen it
WALKED = 0.1  # share of the base that a query of a measured search may meet on its walks
ENTRIES = 8
TOGETHER = 256  # queries that walk in step
VISIT = "i bigint, j bigint, sim double, met bigint"


def build_links(x: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """The neighbour places of each row of unit vectors x; all rows are reachable from entries(len(x))."""
    n = len(x)
    take = min(4 * degree, n - 1)
    chosen: list[np.ndarray] = []
    for a in range(0, n, 512):
        sim = x[a : a + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -np.inf
        near = np.argpartition(-sim, take - 1, axis=1)[:, :take] if take else np.empty((len(sim), 0), np.int64)
        s = np.take_along_axis(sim, near, 1)
        order = np.lexsort((near, -s), axis=1)
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        between = np.einsum("nkd,nld->nkl", x[near], x[near])
        keep = np.zeros(near.shape, bool)
        for p in range(take):
            crowded = ((between[:, p, :] >= s[:, p : p + 1]) & keep).any(axis=1)
            keep[:, p] = ~crowded & (keep.sum(axis=1) < degree)
        r, c = np.nonzero(keep)
        chosen.append(np.stack([r + a, near[r, c]], axis=1))
    pairs = np.concatenate(chosen) if chosen else np.empty((0, 2), np.int64)
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    sim = np.einsum("nd,nd->n", x[pairs[:, 0]], x[pairs[:, 1]])
    order = np.lexsort((pairs[:, 1], -sim, pairs[:, 0]))
    pairs = pairs[order]
    rank = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0], "left")
    pairs = pairs[rank < 2 * degree]
    links = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n))) if n else []
    return _reachable(x, links)


def entries(n: int) -> np.ndarray:
    """Places at which walks begin: some, evenly spread."""
    return np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64)) if n else np.empty(0, np.int64)


def _reachable(x: np.ndarray, links: list[np.ndarray]) -> list[np.ndarray]:
    seen = np.zeros(len(x), bool)

    def walk(start: np.ndarray) -> None:
        edge = start[~seen[start]]
        while len(edge):
            seen[edge] = True
            onward = np.unique(np.concatenate([links[i] for i in edge]))
            edge = onward[~seen[onward]]

    walk(entries(len(x)))
    while not seen.all():
        lost, held = int(np.flatnonzero(~seen)[0]), np.flatnonzero(seen)
        door = int(held[(x[held] @ x[lost]).argmax()])
        links[door], links[lost] = np.append(links[door], lost), np.append(links[lost], door)
        walk(np.array([lost]))
    return links


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, similarities, vectors met) of the k best that each row of q finds; links is padded by len(x).
    Places of len(x) stand for nothing found."""
    n, beam = len(x), max(beam, k)
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    start = entries(n)
    seen[:, start] = True
    places, sims, fresh = np.full((len(q), beam), n), np.full((len(q), beam), -np.inf), np.zeros((len(q), beam), bool)
    first = q @ x[start].T
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    places[:, : order.shape[1]], sims[:, : order.shape[1]], fresh[:, : order.shape[1]] = start[order], np.take_along_axis(first, order, 1), True
    met = np.full(len(q), len(start))
    at_once = max(1, beam // BEAM)  # vectors expanded in a step
    while len(rows := np.flatnonzero(fresh.any(axis=1))):
        left = np.where(fresh[rows], sims[rows], -np.inf)
        if at_once == 1:
            near = links[places[rows, best := left.argmax(axis=1)]]
            fresh[rows, best] = False
            new = ~seen[rows[:, None], near]
        else:
            best = np.argpartition(-left, at_once - 1, axis=1)[:, :at_once]
            some = np.take_along_axis(left, best, 1) > -np.inf
            near = links[np.where(some, np.take_along_axis(places[rows], best, 1), n)].reshape(len(rows), -1)
            fresh[rows[:, None], best] = False
            near.sort(axis=1)
            new = ~seen[rows[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]  # two of them may link to the same one
        seen[rows[:, None], near] = True
        met[rows] += new.sum(axis=1)
        s = np.where(new, np.einsum("rd,rwd->rw", q[rows], padded[near]), -np.inf)
        all_s = np.concatenate([sims[rows], s], axis=1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[rows] = np.take_along_axis(all_s, keep, 1)
        places[rows] = np.take_along_axis(np.concatenate([places[rows], near], axis=1), keep, 1)
        fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], new], axis=1), keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, np.take_along_axis(places, order, 1), n), sims, met


def with_links(held: DataFrame, rows: np.ndarray, degree: int = DEGREE) -> DataFrame:
    """held(cell, id, v) as (cell, piece, id, v, links): the graph of each piece, rows in order of id."""
    pieces = F.get(F.array(*[F.lit(max(1, math.ceil(int(n) / PIECE_ROWS))) for n in rows]), F.col("cell"))
    cut_up = held.select("cell", F.pmod(F.xxhash64("id", F.lit(2)), pieces).cast("int").alias("piece"), "id", "v")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        return pdf.assign(links=[a.astype("int32") for a in build_links(unit(pdf["v"]).astype(np.float32), degree)])

    return cut_up.groupBy("cell", "piece").applyInPandas(linked, f"cell int, piece int, id bigint, v {dict(held.dtypes)['v']}, links array<int>")


def graph_piece(k: int, beam: int) -> Callable:
    def make(piece: pd.DataFrame) -> Callable[[pd.DataFrame], pd.DataFrame]:
        piece = piece.sort_values("id", kind="stable")
        ids, y = piece["id"].to_numpy(), unit(piece["v"])
        x, n = y.astype(np.float32), len(ids)
        links = np.full((n + 1, max(1, max(map(len, piece["links"]), default=1))), n)
        for r, a in enumerate(piece["links"]):
            links[r, : len(a)] = a

        def search(part: pd.DataFrame) -> pd.DataFrame:
            q, asked, out = unit(part["v"]), part["id"].to_numpy(), []
            for a in range(0, len(q), TOGETHER):
                some = q[a : a + TOGETHER]
                places, _, met = walk(x, links, some.astype(np.float32), k, beam)
                r, c = np.nonzero(places < n)
                at = places[r, c]
                out.append(pd.DataFrame({"i": asked[a : a + TOGETHER][r], "j": ids[at], "sim": np.round((some[r] * y[at]).sum(axis=1), DIGITS), "met": met[r]}))
            return pd.concat(out)

        return search

    return make


class GraphIndex:
    """Graphs of all cells, at a path: graph/ (Parquet by cell) and centres/ (cell, centre, least, rows)."""

    def __init__(self, cells: Cells, graph: DataFrame):
        self.cells, self.graph = cells, graph

    @classmethod
    def build(cls, base: DataFrame, path: str, rows: int | None = None, degree: int = DEGREE) -> GraphIndex:
        """The index of base(id, v), which has rows, written to path."""
        spark = base.sparkSession
        rows = base.count() if rows is None else rows
        centre = lloyd(sample(base), min(4096, max(1, math.ceil(rows / PIECE_ROWS))), 8, True)
        held = cut(in_cells(base, centre))
        cells = Cells.measured(centre, held)
        with_links(held, cells.rows, degree).write.partitionBy("cell").parquet(f"{path}/graph")
        told = [(c, [float(v) for v in x], float(a), int(n)) for c, (x, a, n) in enumerate(zip(cells.centre, cells.least, cells.rows))]
        spark.createDataFrame(told, "cell int, centre array<double>, least double, rows bigint").coalesce(1).write.parquet(f"{path}/centres")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> GraphIndex:
        told = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # 4,096 rows at most
        cells = Cells(np.array([r.centre for r in told]), np.array([r.least for r in told]), np.array([r.rows for r in told]))
        return cls(cells, spark.read.parquet(f"{path}/graph"))

    def visited(self, queries: DataFrame, k: int, beam: int = BEAM, nprobe: int | None = None) -> DataFrame:
        """Raw hits (i, j, sim, met) of every piece walked; met: vectors that the query was compared with there."""
        cells = self.cells
        probes = nprobe or measured_probes(queries, self.graph, cells, k)
        asked = cut(asked_of(queries.select("id", "v"), lambda pdf: list(cells.order(unit(pdf["v"]))[0][:, :probes])))
        return meet_cells(asked, self.graph, cells.rows, visits(asked), graph_piece(k, beam), VISIT, PIECE_ROWS, TOGETHER)

    def search(self, queries: DataFrame, k: int, beam: int | None = None, nprobe: int | None = None) -> DataFrame:
        """Approximate (i, j, sim, rank).  nprobe None: as many cells, and then as wide a beam, as RECALL needs on a sample with room to
        spare; with cells given and no beam, BEAM.  If such walks meet more than WALKED of the base, those cells are compared whole."""
        if nprobe is None:
            nprobe = measured_probes(queries, self.graph, self.cells, k, 1 - (1 - RECALL) / 5)
            beam = beam or self.measured_beam(queries, k, nprobe)
            if beam is None:
                return top(_probed(queries.select("id", "v"), self.graph.select("cell", "id", "v"), self.cells, k, nprobe, unit_rows), k)
        return top(self.visited(queries, k, beam or BEAM, nprobe).drop("met"), k)

    def measured_beam(self, queries: DataFrame, k: int, nprobe: int, recall: float = 1 - (1 - RECALL) / 2) -> int | None:
        """The least of BEAM, twice BEAM, ... that finds that share of the k nearest of PROBED queries chosen by hash; None if they meet more
        than WALKED of the base with it, or with a narrower one."""
        some = cut(queries.select("id", "v", F.xxhash64("id", F.lit(6)).alias("h")).orderBy("h").limit(PROBED).select("id", "v"))
        truth = cut(nearest_exact(some, self.graph.select("id", "v"), k, PROBED).select("i", "j"))
        beam, total, most = BEAM, truth.count(), WALKED * int(self.cells.rows.sum()) * some.count()
        while True:
            hits = cut(self.visited(some, k, beam, nprobe))
            if (hits.agg(F.sum("met")).first()[0] or 0) / k > most:  # a piece names its walk k times
                return None
            if truth.join(top(hits.drop("met"), k).select("i", "j"), ["i", "j"], "left_semi").count() >= recall * total or beam >= PIECE_ROWS:
                return beam
            beam *= 2


def nearest_graph(queries: DataFrame, base: DataFrame, k: int, beam: int | None = None, nprobe: int | None = None, rows: int | None = None) -> DataFrame:
    """Approximate (i, j, sim, rank) by an index made for this search in the session's shared folder; an empty base is searched exactly."""
    spark = queries.sparkSession
    rows = base.count() if rows is None else rows
    if not rows:
        return nearest_exact(queries, base, k, 0)
    return GraphIndex.build(base, f"{checkpoint_folder(spark)}/graph-{uuid.uuid4().hex}", rows).search(queries, k, beam, nprobe)
