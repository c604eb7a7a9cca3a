"""Window tokens and block shingles: sign projections, weighted sampling, optimal transport, attachment."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SETS = 4096  # vector sets of a tile
SPREAD = 64  # sets that a tile has at least, if that makes fewer pairs of tiles than there are cores
MOVED = 1024  # pairs of which the transport is found at a time


def windows(genes: DataFrame, key: list[str], order: list[str], k: int, stride: int = 1, vector: str = "emb") -> DataFrame:
    """(key, window, ids, vectors): runs of k genes at every stride-th start."""
    w = Window.partitionBy(*key).orderBy(*order)
    here = w.rowsBetween(0, k - 1)
    rows = genes.withColumn("window", F.row_number().over(w) - 1).withColumn("vectors", F.collect_list(vector).over(here)).withColumn("ids", F.collect_list("gene_id").over(here))
    return rows.filter((F.size("ids") == k) & (F.col("window") % stride == 0)).select(*key, F.expr(f"window div {stride}").alias("window"), "ids", "vectors")


def projection_tokens(dim: int, bands: int, bits: int, seed: int = 42):
    """Function from an (n, dim) matrix to (n, bands) signed 64-bit tokens of banded sign projections."""
    planes = np.random.default_rng(seed).standard_normal((dim, bands * bits))

    def tokens(x: np.ndarray) -> np.ndarray:
        signs = np.packbits((x @ planes >= 0).reshape(len(x), bands, bits), axis=2)
        out = np.empty((len(x), bands), np.int64)
        for i in range(len(x)):
            for b in range(bands):
                out[i, b] = int.from_bytes(hashlib.blake2b(bytes([b & 255]) + signs[i, b].tobytes(), digest_size=8).digest(), "little", signed=True)
        return out

    return tokens


def token_windows(genes: DataFrame, dim: int, bands: int = 8, bits: int = 8, seed: int = 42, vector: str = "emb") -> DataFrame:
    """genes with column tokens (array of bigint), batch by batch."""
    make = projection_tokens(dim, bands, bits, seed)

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns=["_v"]).assign(tokens=list(make(np.vstack(pdf["_v"].to_numpy()).astype(float))))

    kept = [f for f in genes.schema.fields if f.name != vector]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "tokens array<bigint>"])
    return genes.select(*[f.name for f in kept], F.col(vector).alias("_v")).mapInPandas(run, schema)


def _combine(items: tuple[int, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(np.array(items, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)


def block_shingles(rows: list[list[int]], k: int = 3, mode: str = "xor", skip: int = 0, seed: int = 42, strand_canonical: bool = True) -> set[int]:
    """Shingles of one block's ordered window tokens.

    mode: xor (all bands folded), subset (one band by window content), bandset (a shingle per band), icws (one
    weighted sample of the bands).  skip > 0 adds skip-grams; canonical shingles equal those of the reversed block."""
    if mode == "bandset":
        streams = [list(s) for s in zip(*rows)] if rows else []
    elif mode == "subset":
        streams = [[r[abs(r[0]) % len(r)] for r in rows]]
    elif mode == "fixed_subset":
        streams = [[r[seed % len(r)] for r in rows]]
    elif mode == "icws":
        streams = [[weighted_sample(dict.fromkeys(r, 1.0), seed) for r in rows]]
    else:
        streams = [[int(np.bitwise_xor.reduce(np.array(r, np.int64))) for r in rows]]
    out: set[int] = set()
    for s in streams:
        for i in range(len(s) - k + 1):
            tails = combinations(range(i + 1, min(len(s), i + k + skip)), k - 1)
            for t in tails:
                gram = (s[i], *(s[j] for j in t))
                out.add(_combine(min(gram, gram[::-1]) if strand_canonical else gram))
    return out


def weighted_sample(weights: dict[int, float], seed: int) -> int:
    """Improved consistent weighted sampling: equal weighted sets give equal samples, and two sets agree
    with a chance equal to their weighted Jaccard similarity."""
    best, least = 0, np.inf
    for key, w in sorted(weights.items()):
        rng = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF])
        r, c, beta = rng.gamma(2, 1), rng.gamma(2, 1), rng.uniform()
        t = np.floor(np.log(w) / r + beta)
        a = c / (np.exp(r * (t - beta)) * np.exp(r))
        if a < least:
            best, least = key, a
    return best


def shingle_blocks(tokened: DataFrame, block: str, order: str, **how) -> DataFrame:
    """(block, shingle) rows of tokened(block, order, tokens)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [list(map(int, r)) for r in pdf.sort_values(order)["tokens"]]
        found = sorted(block_shingles(rows, **how))
        return pd.DataFrame({block: [pdf[block].iloc[0]] * len(found), "shingle": np.array(found, np.int64)})

    kind = dict(tokened.dtypes)[block]
    return tokened.select(block, order, "tokens").groupBy(block).applyInPandas(run, f"`{block}` {kind}, shingle bigint")


def sinkhorn(a: np.ndarray, b: np.ndarray, eps: float = 0.1, rounds: int = 50, top_k: int | None = None) -> float:
    """Entropic transport cost between two sets of unit vectors under 1 - cosine; with top_k only each row's
    closest columns may carry mass."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    cost = 1 - unit(a) @ unit(b).T
    kernel = np.exp(-cost / eps)
    if top_k is not None and top_k < cost.shape[1]:
        far = np.argsort(cost, axis=1, kind="stable")[:, top_k:]
        np.put_along_axis(kernel, far, 0.0, axis=1)
    u, v = np.ones(len(a)), np.ones(len(b))
    for _ in range(rounds):
        u = (1 / len(a)) / np.maximum(kernel @ v, 1e-300)
        v = (1 / len(b)) / np.maximum(kernel.T @ u, 1e-300)
    plan = u[:, None] * kernel * v[None, :]
    return float((plan * cost).sum() / max(plan.sum(), 1e-300))


def rerank(pairs: DataFrame, vectors: DataFrame, eps: float = 0.1, rounds: int = 50, top_k: int | None = None) -> DataFrame:
    """pairs(a, b) with the transport cost of their vector sets; vectors(id, vs array<array<float>>)."""
    met = pairs.join(vectors.withColumnsRenamed({"id": "a", "vs": "va"}), "a").join(vectors.withColumnsRenamed({"id": "b", "vs": "vb"}), "b")

    def run(batches):
        for pdf in batches:
            cost = [sinkhorn(np.vstack(x).astype(float), np.vstack(y).astype(float), eps, rounds, top_k) for x, y in zip(pdf["va"], pdf["vb"])]
            yield pdf[["a", "b"]].assign(cost=cost)

    kinds = dict(pairs.dtypes)
    return met.select("a", "b", "va", "vb").mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}, cost double")


def sinkhorn_many(a: np.ndarray, b: np.ndarray, eps: float = 0.1, rounds: int = 50, top_k: int | None = None) -> np.ndarray:
    """sinkhorn of each pair of sets a (pairs, n, dim) and b (pairs, m, dim); the pairs are the last axis, so each step is one array operation.
    Equally close columns (to 12 places) are taken from the left."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=2, keepdims=True), 1e-9)
    cost = 1 - np.moveaxis(unit(a) @ unit(b).transpose(0, 2, 1), 0, 2)
    cost = np.ascontiguousarray(cost)
    kernel = np.exp(-cost / eps)
    if top_k is not None and top_k < cost.shape[1]:
        np.put_along_axis(kernel, np.argsort(np.round(cost, 12), axis=1, kind="stable")[:, top_k:], 0.0, axis=1)
    n, m, size = cost.shape
    u, v = np.ones((n, size)), np.ones((m, size))
    for _ in range(rounds):
        u = (1 / n) / np.maximum((kernel * v).sum(axis=1), 1e-300)
        v = (1 / m) / np.maximum((kernel * u[:, None]).sum(axis=0), 1e-300)
    plan = u[:, None] * kernel * v
    return (plan * cost).sum(axis=(0, 1)) / np.maximum(plan.sum(axis=(0, 1)), 1e-300)


def _sharing(x: list[np.ndarray], y: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in x, places in y) of the token sets with `least` tokens in common, counted for some of x at a time."""
    owner = np.repeat(np.arange(len(y)), [len(t) for t in y])
    every, place = np.unique(np.concatenate(y), return_inverse=True)
    owner = owner[np.argsort(place, kind="stable")]
    size = np.bincount(place, minlength=len(every))
    start = np.cumsum(size) - size
    for i, tokens in enumerate(x):
        at = np.minimum(np.searchsorted(every, tokens), len(every) - 1)
        at = at[every[at] == tokens]
        if len(at):
            met = np.concatenate([owner[start[t] : start[t] + size[t]] for t in at])
            near = np.flatnonzero(np.bincount(met, minlength=len(y)) >= least)
            yield np.full(len(near), i), near


def rerank_sharing(sets: DataFrame, least: int = 2, eps: float = 0.1, rounds: int = 50, top_k: int | None = None) -> DataFrame:
    """(a < b, cost): rerank of all pairs of sets(id, tokens, vs) with `least` distinct tokens in common.

    Sets are dealt into tiles, and each two tiles meet in one task, where common tokens are counted and costs found: vectors move
    once for each tile, not for each pair, and no pair moves."""
    cores, n = sets.sparkSession.sparkContext.defaultParallelism, sets.count()
    tiles = max(1, math.ceil(n / SETS), min(math.ceil(math.sqrt(4 * cores)), math.ceil(n / SPREAD)))
    own = sets.select("id", F.array_distinct("tokens").alias("tokens"), "vs", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("mine"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.withColumn("meeting", F.least("mine", "other") * tiles + F.greatest("mine", "other")).drop("other")

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        first = pdf["mine"].min()
        x, y = pdf[pdf["mine"] == first], pdf[pdf["mine"] == pdf["mine"].max()]
        if x["mine"].iloc[0] * tiles + y["mine"].iloc[0] != pdf["meeting"].iloc[0]:
            return  # one of the tiles is empty
        x, y = ({"id": p["id"].to_numpy(), "tokens": p["tokens"].to_list(), "vs": [np.vstack(v).astype(float) for v in p["vs"]]} for p in (x, y))
        same = len(pdf["mine"].unique()) == 1
        held, waiting = [], 0

        def costs() -> pd.DataFrame:
            i, j = (np.concatenate(p) for p in zip(*held))
            keep = i < j if same else np.full(len(i), True)
            i, j = i[keep], j[keep]
            swap = x["id"][i] > y["id"][j]
            a, b = np.where(swap, y["id"][j], x["id"][i]), np.where(swap, x["id"][i], y["id"][j])
            va = [y["vs"][q] if s else x["vs"][p] for p, q, s in zip(i, j, swap)]
            vb = [x["vs"][p] if s else y["vs"][q] for p, q, s in zip(i, j, swap)]
            shape = np.array([(len(p), len(q)) for p, q in zip(va, vb)]).reshape(-1, 2)
            cost = np.zeros(len(i))
            for some in np.unique(shape, axis=0):
                where = np.flatnonzero((shape == some).all(axis=1))
                for c in range(0, len(where), MOVED):
                    part = where[c : c + MOVED]
                    cost[part] = sinkhorn_many(np.stack([va[p] for p in part]), np.stack([vb[p] for p in part]), eps, rounds, top_k)
            return pd.DataFrame({"a": a, "b": b, "cost": cost})

        for i, j in _sharing(x["tokens"], y["tokens"], least):
            held.append((i, j))
            waiting += len(i)
            if waiting >= 16 * MOVED:
                yield costs()
                held, waiting = [], 0
        if waiting:
            yield costs()

    kind = dict(sets.dtypes)["id"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for batch in batches:
            for meeting, part in batch.groupby("meeting", sort=True):
                if meeting != now and kept:
                    yield from run(pd.concat(kept))
                    kept = []
                now = meeting
                kept.append(part)
        if kept:
            yield from run(pd.concat(kept))

    spread = dealt.repartition(tiles * (tiles + 1) // 2, "meeting").sortWithinPartitions("meeting")
    return spread.mapInPandas(each, f"a {kind}, b {kind}, cost double")


def hybrid_weight(cosine: str, cost: str, lam: float = 0.5, tau: float = 0.1):
    return lam * F.col(cosine) + (1 - lam) * F.exp(-F.col(cost) / tau)


def attach_sinks(sink: DataFrame, members: DataFrame, containment: float = 0.5, margin: float = 0.1, least: int = 2) -> DataFrame:
    """(block_id, cluster_id): unclustered blocks joined to the cluster whose union of shingles holds most of
    theirs; the best must reach containment, share `least` shingles and lead the next by margin.

    sink(block_id, shingle), members(cluster_id, shingle)."""
    sig = members.select("cluster_id", "shingle").distinct()
    own = sink.select("block_id", "shingle").distinct()
    n = own.groupBy("block_id").agg(F.count("*").alias("n"))
    met = own.join(sig, "shingle").groupBy("block_id", "cluster_id").agg(F.count("*").alias("shared")).join(n, "block_id")
    met = met.withColumn("held", F.col("shared") / F.col("n"))
    order = Window.partitionBy("block_id").orderBy(F.col("held").desc(), "cluster_id")
    ranked = met.withColumn("r", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("held").over(order), F.lit(0.0))).filter("r = 1")
    return ranked.filter((F.col("held") >= containment) & (F.col("shared") >= least) & (F.col("held") - F.col("next") >= margin)).select("block_id", "cluster_id", "held")


def covariance(vectors: DataFrame, vector: str = "emb") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) from distributed sums of x and x x^T."""

    def partial(batches):
        total, outer, n = 0.0, 0.0, 0
        for pdf in batches:
            x = np.vstack(pdf["_v"].to_numpy()).astype(float)
            total, outer, n = total + x.sum(axis=0), outer + x.T @ x, n + len(x)
        if n:
            flat = np.concatenate([[n], np.atleast_1d(total), np.atleast_1d(outer).ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    rows = vectors.select(F.col(vector).alias("_v")).mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    n = rows[0] if len(rows) else 0
    d = int(round((-1 + np.sqrt(1 + 4 * max(0, len(rows) - 1))) / 2))
    mean = rows[1 : d + 1] / max(n, 1)
    return int(n), mean, rows[d + 1 :].reshape(d, d) / max(n, 1) - np.outer(mean, mean)


def ledoit_wolf(vectors: DataFrame, vector: str = "emb") -> float:
    """Shrinkage of the covariance towards a multiple of the identity that minimises the expected squared error (Ledoit and Wolf):
    one pass for the covariance, one for the fourth powers of the centred norms."""
    n, mean, cov = covariance(vectors, vector)
    if not n:
        return 0.0
    d = len(mean)

    def fourth(batches):
        for pdf in batches:
            x = np.vstack(pdf["_v"].to_numpy()).astype(float) - mean
            yield pd.DataFrame({"s": [float(((x**2).sum(axis=1) ** 2).sum())]})

    total = vectors.select(F.col(vector).alias("_v")).mapInPandas(fourth, "s double").agg(F.sum("s")).first()[0]
    spread = (cov**2).sum()
    noise = (total / n - spread) / (d * n)
    gap = (spread - np.trace(cov) ** 2 / d) / d
    return float(min(noise, gap) / gap) if gap > 0 else 0.0


def pca(vectors: DataFrame, dim: int, vector: str = "emb", whiten: bool = False, shrink: float | str = 0.0):
    """(mean, components, explained share); shrink: a share or "auto" for the Ledoit-Wolf estimate."""
    _, mean, cov = covariance(vectors, vector)
    d = len(mean)
    share = ledoit_wolf(vectors, vector) if shrink == "auto" else float(shrink)
    cov = (1 - share) * cov + share * np.eye(d) * np.trace(cov) / max(d, 1)
    value, vec = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:dim]
    comp = vec[:, order].T
    comp = comp * np.where(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)] < 0, -1, 1)[:, None]
    if whiten:
        comp = comp / np.sqrt(np.maximum(value[order], 1e-12))[:, None]
    return mean, comp, value[order] / value.sum()


def optimised_rotation(vectors: DataFrame, rounds: int = 6, vector: str = "emb") -> np.ndarray:
    """Rotation that lowers the error of product quantisation (OPQ): on a bounded sample, codes of the rotated vectors and the
    orthogonal matrix that brings the vectors closest to their decoded codes take turns.  Rotate with `project`, mean 0."""
    from locusweave.operators.nearest import ProductCode, sample

    x = sample(vectors.select(F.monotonically_increasing_id().alias("id"), F.col(vector).alias("v"))).astype(float)
    turn = np.eye(x.shape[1])
    for _ in range(rounds):
        code = ProductCode(x @ turn.T, 4)
        u, _, vt = np.linalg.svd(code.decode(code.encode(x @ turn.T)).T @ x)
        turn = u @ vt
    return turn


def project(vectors: DataFrame, mean: np.ndarray, comp: np.ndarray, vector: str = "emb") -> DataFrame:
    """vectors with the vector column projected, centred and of unit norm."""

    def run(batches):
        for pdf in batches:
            y = (np.vstack(pdf[vector].to_numpy()).astype(float) - mean) @ comp.T
            yield pdf.assign(**{vector: list((y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-8)).astype(np.float32))})

    schema = ", ".join(f"`{f.name}` {'array<float>' if f.name == vector else f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInPandas(run, schema)


def drop_top_components(vectors: DataFrame, n: int, vector: str = "emb") -> DataFrame:
    """All-but-the-top: the mean and the n leading components removed, unit norm."""
    mean, comp, _ = pca(vectors, n, vector)
    keep = np.eye(comp.shape[1]) - comp.T @ comp
    return project(vectors, mean, keep, vector)


def standardised(vectors: DataFrame, vector: str = "emb") -> DataFrame:
    """Each dimension centred and divided by its deviation (from distributed sums), unit norm."""
    _, mean, cov = covariance(vectors, vector)
    return project(vectors, mean, np.diag(1 / np.sqrt(np.maximum(np.diag(cov), 1e-12))), vector)
