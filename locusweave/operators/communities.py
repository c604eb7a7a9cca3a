"""Block communities from token sets, and reciprocal neighbour graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators import graph, tokens
from locusweave.operators.numbering import numbered_rows


def robust_blocks(anchors: DataFrame, block: str, q: str, t: str, spread: float = 3.0, least: int = 3) -> DataFrame:
    """Blocks whose anchors keep to a diagonal: enough of them, and a small median absolute deviation."""
    return tokens.coherence(anchors, block, q, t).filter((F.col("n") >= least) & (F.col("mad") < spread)).select(block)


def token_clusters(
    rows: DataFrame, tau: float = 0.3, k: int = 5, ban: float | None = 0.99, min_shared: int = 1, triangles: int = 0, communities: bool = False,
    cap: int | None = None, either: bool = False, lengths: DataFrame | None = None, small: int = 6,
) -> DataFrame:
    """(doc, cluster_id) of token sets rows(doc: bigint, token or tokens).

    Tokens at or above the document-frequency percentile `ban` are left out; pairs with an IDF-weighted
    Jaccard of tau or more and min_shared tokens that are among each other's k best are edges; a cap leaves each document that many, by
    the greedy walk from the heaviest edge on or (either) the best of each end; edges with too few triangles go (with lengths(doc, n): only those
    with an end of fewer than small); clusters are components (or modularity communities), numbered by size, then least member;
    documents without an edge get 0."""
    listed = tokens.token_lists(rows)
    sets, n, entries = tokens.token_sets(listed, ban)
    edges = graph.written(graph.mutual_best(tokens.most_alike(sets, n, entries, k, tau, min_shared), k))  # read several times
    if cap:
        edges = graph.written(graph.either_cap(edges, cap)) if either else graph.greedy_cap(edges, cap)
    if triangles:
        told = graph.triangle_support(edges)
        enough = F.col("triangles") >= triangles
        if lengths is not None:
            side = lambda s: lengths.select(F.col("doc").alias(s), F.col("n").alias(f"n{s}"))
            told = told.join(side("u"), "u", "left").join(side("v"), "v", "left")
            enough = enough | ((F.coalesce("nu", F.lit(small)) >= small) & (F.coalesce("nv", F.lit(small)) >= small))
        edges = told.filter(enough).select("u", "v", "w")
        edges = graph.written(edges)
    named = graph.modularity_communities(edges).withColumnRenamed("community", "root") if communities else graph.connected_components(edges)
    sizes = named.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    ids = numbered_rows(sizes, [-F.col("n"), "first"], "cluster_id", 1).select("root", F.col("cluster_id").cast("int").alias("cluster_id"))
    every = listed.select("doc")
    return every.join(named.join(ids, "root").select(F.col("node").alias("doc"), "cluster_id"), "doc", "left").select("doc", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def block_communities(
    anchors: DataFrame, rows: DataFrame, tau: float = 0.3, k: int = 5, ban: float | None = 0.99, min_shared: int = 2, cap: int = 10, triangles: int = 1, small: int = 6,
    spread: float = 3.0, least: int = 3,
) -> DataFrame:
    """(doc, cluster_id) of blocks: anchors(doc, q, t) say which keep to a diagonal (the others get 0) and how long they are; rows(doc, token)
    which are alike.  Gate, ban of frequent tokens, weighted similarity, mutual best, cap, triangles of small blocks, modularity communities, numbers by size."""
    held = graph.written(robust_blocks(anchors, "doc", "q", "t", spread, least))
    lengths = anchors.groupBy("doc").agg(F.count("*").alias("n"))
    found = token_clusters(rows.join(held, "doc", "left_semi"), tau, k, ban, min_shared, triangles, True, cap, True, lengths, small)
    every = anchors.select("doc").unionByName(rows.select("doc")).distinct()
    return every.join(found, "doc", "left").select("doc", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def reciprocal_graph(neighbours: DataFrame, k: int, least: float = 0.0, costs: DataFrame | None = None, lam: float = 0.5, tau: float = 0.1) -> DataFrame:
    """Edges (u < v, w) between rows that are among each other's k nearest of neighbours(i, j, sim, rank).

    With costs(a, b, cost) the weight mixes the cosine with exp(-cost / tau)."""
    near = neighbours.filter((F.col("i") != F.col("j")) & (F.col("rank") <= k + 1))
    pair = near.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "sim").groupBy("u", "v").agg(F.count("*").alias("n"), F.max("sim").alias("w")).filter("n = 2").select("u", "v", "w")
    if costs is not None:
        met = pair.join(costs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "cost"), ["u", "v"])
        pair = met.select("u", "v", (lam * F.col("w") + (1 - lam) * F.exp(-F.col("cost") / tau)).alias("w"))
    return pair.filter(F.col("w") >= least)
