"""Nearest neighbours by cosine: exact by tiles, exact by pruned cells, and approximate on request.

Tiles: the queries are dealt into tiles of some MB; each tile meets one copy of the base as a stream and keeps the best k of its rows, so the
base moves once for each tile.  A few queries go to the base instead, which stays where it is.

Cells: k-means on the sphere, fitted on a bounded sample; each cell keeps its reach, the widest angle of a member to the centre.  The angle of a query
to the centre less the reach bounds what the cell can hold.  A query looks into its closest cells first; a second round fetches
only the cells whose bound is not below its k-th similarity, so nothing is lost.  Where that would move more vectors than tiles
do (data without structure), tiles are taken instead.  Similarities are rounded to 12 decimals before they are ranked and ties go to the smaller
id, so all exact ways give the same rows.

Approximate searches look into the nprobe closest cells alone; without a number, nprobe is the least that has the wanted recall on a
sample of the queries.  The base may travel as 8-bit or product codes, whose shortlist is then ranked by the stored vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.operators.graph import cut

TILE_BYTES = 32 << 20  # of the vectors of a query tile
SLICE = 4 << 20  # similarities to centres counted at a time
BLOCK, STREAM = 512, 2048  # queries and base rows compared at a time
WAITING, TIES = 0.25, 8  # times k: rows that wait for a query, and rows kept of one with ties
SPREAD = 512  # queries that a tile has at least, if that makes fewer tiles than there are cores
TILED_ROWS = 50_000  # base rows up to which "auto" takes tiles at once; beyond, pruned cells (the result is the same)
CELL_ROWS = 8192  # rows of a cell that one task searches
CELL_QUERIES = 65_536  # queries of a cell that one task answers
SAMPLE_BYTES = 64 << 20  # of the vectors that cells and codes are fitted on
PROBED = 256  # queries that nprobe is measured on
RECALL = 0.95
INDEXES = ("auto", "exact", "cells", "ivf_flat", "ivf_sq", "ivf_pq", "graph")
SHORTLIST = {"sq": 2, "pq": 12}  # times k: what codes propose for the exact ranking
DIGITS = 12
_NEAR = 1e-11  # two similarities closer than this may be equal once rounded
_SLACK = 1e-6  # of the bound of a cell, for rounding
HIT = "i bigint, j bigint, sim double"
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def unit(v: pd.Series) -> np.ndarray:
    """Rows of unit length (a zero vector stays zero)."""
    m = np.vstack(v.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def true_places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask with few true values: words of eight are looked at first, of large masks words of words."""
    flat = mask.ravel()
    whole = flat.size & ~7
    filled = flat[:whole].view(np.uint64) != 0
    words = true_places(filled) if len(filled) > 4096 else np.flatnonzero(filled)
    word, place = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate((8 * words[word] + place, whole + np.flatnonzero(flat[whole:])))


class _Block:
    """The best k of a stream of base rows for a block of queries, of at least their floor; ties go to the smaller id.

    Single precision proposes, within the error it can have; what may belong to the best is counted in double precision.  The rows
    found wait until they are WAITING times as many as those kept; then those below the k-th of their query go.  Only
    hits() sorts, or a query with so many ties that they would pile up."""

    def __init__(self, x: np.ndarray, k: int, floor: np.ndarray | None):
        self.x, self.thin, self.k = x, x.astype(np.float32), k
        self.least = np.full(len(x), -np.inf) if floor is None else floor.astype(np.float64)  # of the k kept, once there are k
        self.found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        self.waiting = 0

    def meet(self, ids: np.ndarray, y: np.ndarray, thin: np.ndarray, slack: float, rows: np.ndarray | None = None) -> None:
        x, least = (self.thin, self.least) if rows is None else (self.thin[rows], self.least[rows])
        sim = x @ thin.T
        bar = least - slack
        open_ = least < -1.5  # no k-th row yet: the k-th of this part will do
        if len(ids) > self.k and open_.any():
            bar[open_] = np.maximum(bar[open_], np.partition(sim[open_], -self.k, axis=1)[:, -self.k] - 2 * slack)
        r, c = np.divmod(true_places(sim >= bar.astype(np.float32)[:, None]), sim.shape[1])
        if not len(r):
            return
        r = r if rows is None else rows[r]
        s = np.round(np.einsum("nd,nd->n", self.x[r], y[c]), DIGITS)
        keep = s >= self.least[r] - _NEAR
        self.found.append((r[keep], s[keep], ids[c[keep]]))
        self.waiting += int(keep.sum())
        if self.waiting > WAITING * self.k * len(self.x):
            self.trim()

    def trim(self) -> None:
        row, s, j = (np.concatenate(p) for p in zip(*self.found))
        count = np.bincount(row, minlength=len(self.x))
        wide = int(count.max())
        if wide > TIES * self.k:
            return self.settle()
        order = np.argsort(row.astype(np.int16), kind="stable")
        row, s, j = row[order], s[order], j[order]
        if wide >= self.k:
            grid = np.full((len(self.x), wide), -np.inf)
            grid[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = s
            last = np.partition(grid, wide - self.k, axis=1)[:, wide - self.k]
            full = count >= self.k
            self.least[full] = last[full]
            keep = s >= last[row]
            row, s, j = row[keep], s[keep], j[keep]
        self.found, self.waiting = [(row, s, j)], 0

    def settle(self) -> None:
        row, s, j = (np.concatenate(p) for p in zip(*self.found))
        order = np.lexsort((j, -s, row))
        row, s, j = row[order], s[order], j[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = rank < self.k
        self.found, self.waiting = [(row[keep], s[keep], j[keep])], 0
        last = rank == self.k - 1
        self.least[row[last]] = s[last]


class _Tile:
    """The best k of a stream of base rows for each query of a tile, block by block, of at least its floor."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.dim = ids, x.shape[1]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.blocks = [_Block(x[a : a + BLOCK], k, None if floor is None else floor[a : a + BLOCK]) for a in self.starts]

    def meet(self, ids: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> None:
        """rows: places of the queries that these base rows are for, ascending; None: all."""
        whole = np.isfinite(y).all(axis=1)
        ids, y = (ids, y) if whole.all() else (ids[whole], y[whole])
        if not len(ids):
            return
        slack = 2.4e-7 * (self.dim + 8) * max(1.0, float(np.sqrt((y * y).sum(axis=1).max())))  # of products of single precision
        cuts = None if rows is None else np.searchsorted(rows, np.append(self.starts, len(self.ids)))
        for i in range(0, len(ids), STREAM):
            some, part = ids[i : i + STREAM], y[i : i + STREAM]
            thin = part.astype(np.float32)
            for b, block in enumerate(self.blocks):
                asked = None if cuts is None else rows[cuts[b] : cuts[b + 1]] - self.starts[b]
                if asked is None or len(asked):
                    block.meet(some, part, thin, slack, asked)

    def hits(self) -> pd.DataFrame:
        out = []
        for a, block in zip(self.starts, self.blocks):
            block.settle()
            row, s, j = block.found[0]
            out.append(pd.DataFrame({"i": self.ids[a + row], "j": j, "sim": s}))
        return pd.concat(out) if out else pd.DataFrame({"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "sim": np.empty(0)})


def top(hits: DataFrame, k: int) -> DataFrame:
    """The best k of hits(i, j, sim) for each i, with their rank."""
    order = Window.partitionBy("i").orderBy(F.col("sim").desc(), "j")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def width(vectors: DataFrame) -> int:
    """Dimensions of vectors(id, v); 1 for an empty table."""
    first = vectors.select(F.size("v").alias("n")).first()
    return max(1, first["n"]) if first else 1


def _tiles(queries: DataFrame, rows: int) -> int:
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(rows * width(queries) * 8 / TILE_BYTES), min(cores, math.ceil(rows / SPREAD)))


def nearest_exact(queries: DataFrame, base: DataFrame, k: int, query_rows: int | None = None) -> DataFrame:
    """(i, j, sim, rank): for each row of queries(id, v) its k nearest of base(id, v), itself included."""
    rows = queries.count() if query_rows is None else query_rows
    tiles = _tiles(queries, rows)
    if tiles == 1 and rows <= SPREAD:
        return _nearest_of_few(queries, base, k)
    return top(_past_tiles(queries.select("id", "v"), base.select("id", "v"), tiles, lambda asked: _Whole(asked, k)), k)


class _Whole:
    """A tile of queries(id, v) that meets every row of base(id, v)."""

    def __init__(self, asked: pd.DataFrame, k: int):
        self.tile = _Tile(asked["id"].to_numpy(), unit(asked["v"]), k)
        self.hits = self.tile.hits

    def meet(self, part: pd.DataFrame) -> None:
        self.tile.meet(part["id"].to_numpy(), unit(part["v"]))


def _past_tiles(queries: DataFrame, base: DataFrame, tiles: int, make: Callable, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Hits of queries(id, v), dealt into tiles, that one copy of base(id, ...) streams past for each tile, in that order.

    make(queries of a tile): an object with meet(part of the base) and hits().  A tile has a partition of its own."""
    left = queries.withColumns({"q": F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"), "side": F.lit(0)})
    right = base.withColumns({"q": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))), "side": F.lit(1)})
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(tiles, "q").sortWithinPartitions("q", "side", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, tile = None, [], None
        for batch in batches:
            for (q, side), part in batch.groupby(["q", "side"], sort=True):
                if q != now:
                    if tile is not None:
                        yield tile.hits()
                    now, held, tile = q, [], None
                if side == 0:
                    held.append(part)
                    continue
                if tile is None and held:
                    tile, held = make(pd.concat(held)), []
                if tile is not None:
                    tile.meet(part)
        if tile is not None:
            yield tile.hits()

    return dealt.mapInPandas(run, HIT)


def _nearest_of_few(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """nearest_exact of at most SPREAD queries in one tile: they go to the base, which does not move."""
    asked = queries.select("id", "v").toPandas()
    if asked.empty:
        return top(queries.sparkSession.createDataFrame([], HIT), k)
    ids, x = asked["id"].to_numpy(), unit(asked["v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile = _Tile(ids, x, k)
        for pdf in batches:
            if len(pdf):
                tile.meet(pdf["id"].to_numpy(), unit(pdf["v"]))
        yield tile.hits()

    return top(base.select("id", "v").mapInPandas(run, HIT), k)


def sample(base: DataFrame, seed: int = 7) -> np.ndarray:
    """Unit vectors of a bounded, hash-ordered sample of base(id, v)."""
    n = max(1000, SAMPLE_BYTES // (4 * width(base)))
    rows = base.select("v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(n).select("v").toPandas()
    return unit(rows["v"]).astype(np.float32)


def lloyd(x: np.ndarray, n: int, rounds: int, on_sphere: bool) -> np.ndarray:
    """n centres of x by k-means; on the sphere they are scaled to norm 1 and the largest product is the closest."""
    centre = x[: min(n, len(x))].copy()
    for _ in range(rounds):
        own = closest(x, centre, on_sphere)
        count = np.bincount(own, minlength=len(centre))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(count)
        total = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(count[full])[:-1])), axis=0)
        centre[full] = total / count[full, None]
        if on_sphere:
            centre[full] /= np.maximum(np.linalg.norm(centre[full], axis=1, keepdims=True), 1e-9)
    return centre


def closest(x: np.ndarray, centre: np.ndarray, on_sphere: bool) -> np.ndarray:
    shift = 0 if on_sphere else (centre**2).sum(axis=1) / 2
    step = max(1, SLICE // len(centre))
    return np.concatenate([(x[i : i + step] @ centre.T - shift).argmax(axis=1) for i in range(0, len(x), step)])


class ScalarCode:
    """8-bit codes per dimension between the extremes of a sample."""

    def __init__(self, x: np.ndarray):
        self.low = x.min(axis=0)
        self.step = np.maximum(x.max(axis=0) - self.low, 1e-9) / 255

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, 255).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return code * self.step + self.low

    def scores(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Products of x with the vectors of the codes."""
        return x @ self.decode(code).T


class ProductCode:
    """One byte for each `span` dimensions (the last part may be wider): the closest of 256 centres of a sample."""

    def __init__(self, x: np.ndarray, rounds: int = 8, span: int = 4):
        dim = x.shape[1]
        parts = max(1, dim // span)
        self.edge = [span * i for i in range(parts)] + [dim]
        self.centres = [lloyd(x[:, a:b], 256, rounds, False) for a, b in zip(self.edge, self.edge[1:])]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([closest(x[:, a:b], c, False) for c, a, b in zip(self.centres, self.edge, self.edge[1:])], axis=1).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([c[code[:, i]] for i, c in enumerate(self.centres)], axis=1)

    def scores(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Products of x with the vectors of the codes, from a table of products for each query: no code is decoded."""
        out = np.zeros((len(x), len(code)))
        for i, (c, a, b) in enumerate(zip(self.centres, self.edge, self.edge[1:])):
            out += (x[:, a:b] @ c.T)[:, code[:, i]]
        return out


def cell_count(n: int) -> int:
    return max(16, min(math.isqrt(n), 4096))


class Cells:
    """Centres on the sphere (at most 4,096), their rows and the least cosine of a member to its centre."""

    def __init__(self, centre: np.ndarray, least: np.ndarray, rows: np.ndarray):
        self.centre, self.least, self.rows = centre.astype(np.float64), least, rows

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells of each query, the closest centre first; cosines to all centres)"""
        cos = x @ self.centre.T
        return np.argsort(-cos, axis=1, kind="stable"), cos

    def bound(self, cos: np.ndarray) -> np.ndarray:
        """The greatest similarity that a member of each cell can have, by the cosine of query and centre."""
        angle = np.arccos(np.clip(cos, -1, 1)) - np.arccos(np.clip(self.least, -1, 1))
        return np.where(self.rows > 0, np.cos(np.maximum(angle, 0)) + _SLACK, -2.0)

    def first(self, order: np.ndarray, rows: int) -> np.ndarray:
        """How many of its closest cells each query needs to meet that many rows."""
        met = np.cumsum(self.rows[order], axis=1)
        return np.minimum((met < rows).sum(axis=1) + 1, order.shape[1])

    @classmethod
    def measured(cls, centre: np.ndarray, held: DataFrame) -> Cells:
        """The cells of held(cell, cos)."""
        told = held.groupBy("cell").agg(F.min("cos").alias("least"), F.count("*").alias("n")).collect()  # a row for each cell
        least, rows = np.ones(len(centre)), np.zeros(len(centre), np.int64)
        for r in told:
            least[r.cell], rows[r.cell] = r.least, r.n
        return cls(centre, least, rows)


def in_cells(base: DataFrame, centre: np.ndarray) -> DataFrame:
    """base(id, v) with the cell of each vector and its cosine to the centre."""
    centre = centre.astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = unit(pdf["v"])
            cell = closest(y, centre, True)
            yield pdf.assign(cell=cell.astype("int32"), cos=np.minimum((y * centre[cell]).sum(axis=1), 1.0))

    return base.select("id", "v").mapInPandas(run, f"id bigint, v {dict(base.dtypes)['v']}, cell int, cos double")


def asked_of(queries: DataFrame, choose: Callable[[pd.DataFrame], list[np.ndarray]]) -> DataFrame:
    """queries(id, v, floor or not) with the cells that choose names for them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cells=[c.astype("int32") for c in choose(pdf)])

    kinds = ", ".join(f"{c} {t}" for c, t in queries.dtypes)
    return queries.mapInPandas(run, f"{kinds}, cells array<int>")


def visits(asked: DataFrame) -> dict[int, int]:
    """The number of queries that look into each cell."""
    return {r.cell: r["count"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}


def meet_cells(asked: DataFrame, held: DataFrame, rows: np.ndarray, asks: dict[int, int], make: Callable, hit: str = HIT, piece_rows: int | None = None, spread: int | None = None) -> DataFrame:
    """Hits of asked(id, v, cells, ...) in held(cell, id, ...).

    A cell of many rows is cut into pieces, and one that many queries ask for is sent to several tasks; in a task a piece
    comes first and the queries stream past it.  make(piece) gives the search of a piece: a function of a batch of queries.  spread: queries
    that are worth a task of their own; then a cell goes to more tasks where there would be fewer than cores."""
    spark: SparkSession = asked.sparkSession
    piece_rows = piece_rows or CELL_ROWS
    split = [(int(c), max(1, math.ceil(int(rows[c]) / piece_rows)), max(1, math.ceil(n / CELL_QUERIES))) for c, n in asks.items()]  # of 4,096 cells at most
    if spread:
        wanted = 3 * spark.sparkContext.defaultParallelism / max(1, sum(p for _, p, _ in split))
        split = [(c, p, max(n, min(math.ceil(asks[c] / spread), math.ceil(wanted)))) for c, p, n in split]
    parts = F.broadcast(spark.createDataFrame(split, "cell int, pieces int, copies int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    left = asked.withColumn("cell", F.explode("cells")).drop("cells").join(parts, "cell").withColumns({"side": F.lit(1), "copy": deal("copies", 1)}).withColumn("piece", each("pieces"))
    held = held.filter(F.col("cell").isin([c for c, _, _ in split]))  # of files by cell, just these are read
    own = F.col("piece") if "piece" in held.columns else deal("pieces", 2)
    right = held.join(parts, "cell").withColumn("piece", own).withColumns({"side": F.lit(0), "copy": each("copies")})
    both = left.drop("pieces", "copies").unionByName(right.drop("pieces", "copies", "cos"), allowMissingColumns=True)
    number = [max(1, min(2000, 2 * sum(p * n for _, p, n in split)))] if spread else []  # small tables of much work are not drawn together
    dealt = both.repartition(*number, "cell", "piece", "copy").sortWithinPartitions("cell", "piece", "copy", "side", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept, search = None, [], None
        for batch in batches:
            for (cell, piece, copy, side), part in batch.groupby(["cell", "piece", "copy", "side"], sort=True):
                if (cell, piece, copy) != now:
                    now, kept, search = (cell, piece, copy), [], None
                if side == 0:
                    kept.append(part)
                    continue
                if search is None and kept:
                    search, kept = make(pd.concat(kept)), []
                if search is not None:
                    yield search(part)

    return dealt.mapInPandas(run, hit)


def flat_piece(k: int) -> Callable:
    """A piece of stored vectors, compared one and all."""
    return _piece(k, unit_rows)


def search_cells(queries: DataFrame, held: DataFrame, cells: Cells, k: int, base: DataFrame | None = None, told: list[dict] | None = None) -> DataFrame:
    """Exact (i, j, sim, rank) over held(cell, id, v) by pruned cells.

    base: the same rows as (id, v), for tiles where the cells that are left would move more vectors; None: never.  told: gets a dict
    of the vectors moved and of the visits made and spared."""

    def first(pdf: pd.DataFrame) -> list[np.ndarray]:
        order, _ = cells.order(unit(pdf["v"]))
        return [o[:n] for o, n in zip(order, cells.first(order, 2 * k))]

    asked = cut(asked_of(queries.select("id", "v"), first))
    asks = visits(asked)
    near = cut(top(meet_cells(asked, held, cells.rows, asks, flat_piece(k)), k))
    floor = near.filter(F.col("rank") == k).select(F.col("i").alias("id"), F.col("sim").alias("floor"))
    known = asked.select("id", "v").join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))

    def left(pdf: pd.DataFrame) -> list[np.ndarray]:
        order, cos = cells.order(unit(pdf["v"]))
        done = cells.first(order, 2 * k)
        can = cells.bound(cos) >= pdf["floor"].to_numpy()[:, None] - _NEAR
        return [o[n:][can[r, o[n:]]] for r, (o, n) in enumerate(zip(order, done))]

    again = cut(asked_of(known, left))
    more = visits(again)
    moved = sum(n * math.ceil(cells.rows[c] / CELL_ROWS) + int(cells.rows[c]) * math.ceil(n / CELL_QUERIES) for c, n in more.items())
    rows = again.count()
    tiled = _tiles(queries, rows) * int(cells.rows.sum()) + rows
    if told is not None:
        told.append({"visits": sum(asks.values()) + sum(more.values()), "spared": rows * int((cells.rows > 0).sum()) - sum(asks.values()) - sum(more.values()), "moved": moved, "tiled": tiled})
    if base is not None and moved > tiled:
        return nearest_exact(queries, base, k, rows)
    if not more:
        return near
    return top(near.select("i", "j", "sim").unionByName(meet_cells(again.filter(F.size("cells") > 0), held, cells.rows, more, flat_piece(k))), k)


def fitted(base: DataFrame, cells: int) -> tuple[np.ndarray, DataFrame]:
    """(centres fitted on a sample, base(id, v, cell, cos) cut off from its lineage)"""
    centre = lloyd(sample(base), cells, 8, True)
    return centre, cut(in_cells(base, centre))


def nearest_cells(queries: DataFrame, base: DataFrame, k: int, rows: int | None = None, told: list[dict] | None = None) -> DataFrame:
    """Exact (i, j, sim, rank), equal to nearest_exact, by pruned cells."""
    rows = base.count() if rows is None else rows
    cells = cell_count(rows)
    if rows < cells:
        return nearest_exact(queries, base, k)
    centre, held = fitted(base, cells)
    return search_held(queries, held, Cells.measured(centre, held), k, base, told)


def search_held(queries: DataFrame, held: DataFrame, cells: Cells, k: int, base: DataFrame, told: list[dict] | None = None) -> DataFrame:
    """search_cells, or tiles at once where PROBED of the queries say that cells of a large base(id, v) spare nothing."""
    if told is None and int(cells.rows.sum()) > TILED_ROWS and _unstructured(queries, held, cells, k):
        return nearest_exact(queries, base, k)
    return search_cells(queries, held, cells, k, base, told)


def _unstructured(queries: DataFrame, held: DataFrame, cells: Cells, k: int) -> bool:
    """Whether bounds leave so many cells to PROBED of the queries, chosen by hash, that tiles move fewer vectors: then no list of
    cells is made for every query."""
    some = queries.select("id", "v", F.xxhash64("id", F.lit(5)).alias("h")).orderBy("h").limit(PROBED).select("id", "v")
    last = nearest_exact(some, held.select("id", "v"), k, PROBED).filter(F.col("rank") == k).select("i", "sim").toPandas()
    asked = some.toPandas()
    if asked.empty:
        return False
    floor = dict(zip(last["i"], last["sim"]))
    _, cos = cells.order(unit(asked["v"]))
    share = (cells.bound(cos) >= np.array([floor.get(i, -2.0) for i in asked["id"]])[:, None] - _NEAR).mean(axis=0)
    n = queries.count()
    moved = sum(q * math.ceil(r / CELL_ROWS) + r * math.ceil(q / CELL_QUERIES) for q, r in zip(share * n, cells.rows))
    return moved > _tiles(queries, n) * int(cells.rows.sum()) + n


def measured_probes(queries: DataFrame, held: DataFrame, cells: Cells, k: int, recall: float = RECALL) -> int:
    """The least number of cells, the closest first, that hold that share of the k nearest of PROBED queries chosen by hash (exact)."""
    some = queries.select("id", "v", F.xxhash64("id", F.lit(5)).alias("h")).orderBy("h").limit(PROBED).select("id", "v")
    found = nearest_exact(some, held.select("id", "v"), k, PROBED).select("i", F.col("j").alias("id"))
    where = found.join(held.select("id", "cell"), "id").select("i", "cell").toPandas()  # PROBED times k rows
    asked = some.toPandas()
    if asked.empty or where.empty:
        return 1
    order, _ = cells.order(unit(asked["v"]))
    place = {i: np.argsort(o) for i, o in zip(asked["id"], order)}
    ranks = np.sort([place[i][c] for i, c in zip(where["i"], where["cell"])])
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def nearest_ivf(queries: DataFrame, base: DataFrame, k: int, nprobe: int | None = None, rows: int | None = None, code: str = "flat", recall: float = RECALL) -> DataFrame:
    """Approximate (i, j, sim, rank): each query looks into its nprobe closest cells; None: as many as the recall needs on a
    sample.  code: flat, sq or pq: the latter two propose SHORTLIST times k by codes (pq: of what is left of a vector without
    its centre), which the stored vectors rank.  A table smaller than its number of cells is searched exactly."""
    rows = base.count() if rows is None else rows
    count = cell_count(rows)
    if rows < count:
        return nearest_exact(queries, base, k)
    centre, held = fitted(base, count)
    cells = Cells.measured(centre, held)
    probes = nprobe or measured_probes(queries, held, cells, k, 1 - (1 - recall) / 2 if code != "flat" else recall)
    if code == "flat":
        return top(_probed(queries, held, cells, k, probes, unit_rows), k)
    x = sample(base)
    own = closest(x, cells.centre.astype(np.float32), True)
    coder = ScalarCode(x) if code == "sq" else ProductCode(x - cells.centre[own].astype(np.float32))
    most = SHORTLIST[code] * k

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, cell = unit(pdf["v"]), pdf["cell"].to_numpy()
            raw = coder.encode(y if code == "sq" else y - cells.centre[cell])
            yield pd.DataFrame({"id": pdf["id"], "cell": cell, "code": [r.tobytes() for r in raw]})

    def told(part: pd.DataFrame) -> np.ndarray:
        raw = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
        return coder.decode(raw).astype(np.float64) + (cells.centre[part["cell"].to_numpy()] if code == "pq" else 0)

    codes = held.mapInPandas(coded, "id bigint, cell int, code binary")
    return ranked(top(_probed(queries, codes, cells, most, probes, told), most), queries, base, k)


def unit_rows(part: pd.DataFrame) -> np.ndarray:
    return unit(part["v"])


class _Probing:
    """A tile of queries(id, v) that meets the rows of its closest cells alone; vectors(part): the rows of a part of the base."""

    def __init__(self, asked: pd.DataFrame, cells: Cells, k: int, probes: int, vectors: Callable):
        x = unit(asked["v"])
        self.tile, self.vectors = _Tile(asked["id"].to_numpy(), x, k), vectors
        self.hits = self.tile.hits
        self.asks = np.zeros((len(cells.rows), len(x)), bool)
        for a in range(0, len(x), BLOCK):
            near = cells.order(x[a : a + BLOCK])[0][:, :probes]
            self.asks[near.ravel(), a + np.repeat(np.arange(len(near)), near.shape[1])] = True

    def meet(self, part: pd.DataFrame) -> None:
        part = part.astype({"cell": "int32"})  # beside queries, which have none, it came as a float
        ids, y = part["id"].to_numpy(), self.vectors(part)
        for cell, at in part.groupby("cell").indices.items():
            rows = np.flatnonzero(self.asks[cell])
            if len(rows):
                self.tile.meet(ids[at], y[at], rows)


def _probed(queries: DataFrame, held: DataFrame, cells: Cells, k: int, probes: int, vectors: Callable) -> DataFrame:
    """Hits of the queries in their `probes` closest cells of held(cell, id, v or code).

    By cell a query sends k rows from each cell it looks into; where that is more than tiles move, the base streams past tiles of
    queries instead, each of which keeps its best k throughout."""
    n = queries.count()
    tiles = _tiles(queries, n)
    if n * probes > tiles * int(cells.rows.sum()):
        keep = [c for c in ("id", "cell", "v", "code") if c in held.columns and not (c == "v" and "code" in held.columns)]
        return _past_tiles(queries.select("id", "v"), held.select(*keep), tiles, lambda asked: _Probing(asked, cells, k, probes, vectors), ("cell", "id"))
    asked = cut(asked_of(queries.select("id", "v"), lambda pdf: list(cells.order(unit(pdf["v"]))[0][:, :probes])))
    return meet_cells(asked, held, cells.rows, visits(asked), _piece(k, vectors))


def _piece(k: int, vectors: Callable) -> Callable:
    def make(piece: pd.DataFrame) -> Callable[[pd.DataFrame], pd.DataFrame]:
        ids, y = piece["id"].to_numpy(), vectors(piece)

        def search(part: pd.DataFrame) -> pd.DataFrame:
            floor = part["floor"].to_numpy(np.float64) if "floor" in part else None
            tile = _Tile(part["id"].to_numpy(), unit(part["v"]), k, floor)
            tile.meet(ids, y)
            return tile.hits()

        return search

    return make


def ranked(listed: DataFrame, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The best k of the pairs listed(i, j), by the vectors themselves."""
    both = listed.select("i", "j").join(base.select(F.col("id").alias("j"), F.col("v").alias("y")), "j").join(queries.select(F.col("id").alias("i"), F.col("v").alias("x")), "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "sim": np.round((unit(pdf["x"]) * unit(pdf["y"])).sum(axis=1), DIGITS)})

    return top(both.select("i", "j", "x", "y").mapInPandas(run, HIT), k)


def index_search(index: str = "auto", nprobe: int | None = None, recall: float = RECALL) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """The search function of an index name.

    auto, exact and cells give the same rows: exact by tiles, cells by pruned cells, auto by tiles for small tables and by pruned
    cells for others.  ivf_flat, ivf_sq, ivf_pq and graph are approximate; nprobe None: measured for that recall."""
    if index not in INDEXES:
        raise ValueError(f"index {index!r} is none of {', '.join(INDEXES)}")

    def search(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
        if index == "exact":
            return nearest_exact(queries, base, k)
        rows = base.count()
        if index == "auto" and (rows <= TILED_ROWS or queries.limit(SPREAD + 1).count() <= SPREAD):
            return nearest_exact(queries, base, k)
        if index in ("auto", "cells"):
            return nearest_cells(queries, base, k, rows)
        if index == "graph":
            from locusweave.operators.nearest_graph import nearest_graph

            return nearest_graph(queries, base, k, nprobe=nprobe, rows=rows)
        return nearest_ivf(queries, base, k, nprobe, rows, index.removeprefix("ivf_"), recall)

    return search
