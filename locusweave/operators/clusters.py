"""Clusters of blocks: shared intervals, mutual edges, components, containment merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators import graph
from locusweave.operators.intervals import block_sides, jaccard_edges
from locusweave.operators.numbering import numbered_rows


def cluster_blocks(blocks: DataFrame, tau: float = 0.3, mutual_k: int = 5, support: int = 2, width: int = 16) -> DataFrame:
    """(block_id, cluster_id): components of mutual top-k Jaccard edges; components over fewer than
    `support` genomes are cluster 0, the others count from 1 by their least block."""
    sides = block_sides(blocks)
    edges = jaccard_edges(sides.withColumnRenamed("block_id", "id"), ["genome", "contig"], tau, width)
    roots = graph.components_of(blocks.select(F.col("block_id").alias("node")), graph.mutual_top_k(edges, mutual_k))
    named = roots.select(F.col("node").alias("block_id"), "root")
    wide = sides.join(named, "block_id").groupBy("root").agg(F.countDistinct("genome").alias("genomes")).filter(F.col("genomes") >= support)
    ids = numbered_rows(wide.select("root"), ["root"], "cluster_id", 1).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    return named.join(ids, "root", "left").select("block_id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def cluster_summary(blocks: DataFrame) -> DataFrame:
    """blocks(cluster_id, ...) -> cluster_id, size, genome_support, mean_chain_length, genes (map of
    genome to sorted contig:position strings); cluster 0 is left out."""
    members = blocks.filter("cluster_id > 0")
    stats = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.bround(F.avg("n_anchors"), 2).alias("mean_chain_length"))
    sides = block_sides(members).join(members.select("block_id", "cluster_id"), "block_id")
    per = sides.withColumn("p", F.explode(F.sequence("start", "end"))).groupBy("cluster_id", "genome").agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "contig", "p"))).alias("genes")
    )
    held = per.groupBy("cluster_id").agg(F.count("*").alias("genome_support"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("genome", "genes")))).alias("genes"))
    return stats.join(held, "cluster_id").select("cluster_id", "size", "genome_support", "mean_chain_length", "genes")


def run_summary(blocks: DataFrame, clusters: DataFrame, genes: DataFrame) -> DataFrame:
    big = clusters.filter("size >= 2").agg(
        F.count("*").alias("num_clusters"), F.percentile("genome_support", F.lit(0.5)).cast("int").alias("median_support"), F.avg("size").alias("mean_size")
    )
    anchors = blocks.agg(F.count("*").alias("num_blocks"), F.sum("n_anchors").alias("num_anchors"), F.count_if(F.col("cluster_id") == 0).alias("num_singletons"))
    return genes.agg(F.count("*").alias("num_genes")).crossJoin(anchors).crossJoin(big)  # three single rows


def containment_candidates(foot: DataFrame, genome: str = "genome", place: tuple[str, ...] = ("genome", "contig", "pos"), threshold: float = 0.8, reciprocal: float = 0.5) -> DataFrame:
    """(small, large, overlap, small_shared, large_shared) of cluster pairs that share places.

    foot: distinct (cluster, *place).  Shared sizes count only genomes that the other cluster
    reaches too; the smaller total footprint is small, of equal ones the smaller id."""
    a, b = foot.select(F.col("cluster").alias("a"), *place), foot.select(F.col("cluster").alias("b"), *place)
    overlap = a.join(b, list(place)).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    per = foot.groupBy("cluster", genome).agg(F.count("*").alias("n"))
    total = per.groupBy("cluster").agg(F.sum("n").alias("total"))

    def shared(x: str, y: str) -> DataFrame:
        mine, other = per.select(F.col("cluster").alias(x), genome, "n"), per.select(F.col("cluster").alias(y), genome)
        return overlap.select("a", "b").join(mine, x).join(other, [y, genome]).groupBy("a", "b").agg(F.sum("n").alias(f"shared_{x}"))

    ta, tb = total.withColumnsRenamed({"cluster": "a", "total": "ta"}), total.withColumnsRenamed({"cluster": "b", "total": "tb"})
    both = overlap.join(shared("a", "b"), ["a", "b"]).join(shared("b", "a"), ["a", "b"]).join(ta, "a").join(tb, "b")
    first = F.col("ta") <= F.col("tb")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    out = both.select(pick("a", "b", "small"), pick("b", "a", "large"), "overlap", pick("shared_a", "shared_b", "small_shared"), pick("shared_b", "shared_a", "large_shared"))
    return out.filter((F.col("overlap") / F.col("small_shared") >= threshold) & (F.col("overlap") / F.col("large_shared") >= reciprocal))


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """(child, parent) of one component of the chosen containments(small, large, small_size, large_size), applied one by one
    in their order between the clusters that the two have become; the original sizes decide which of those stays."""
    became: dict[int, int] = {}
    size: dict[int, int] = {}

    def now(c: int) -> int:
        while c in became:
            c = became[c]
        return c

    for r in pdf.sort_values("place").itertuples():
        size[r.small], size[r.large] = r.small_size, r.large_size
    for r in pdf.sort_values("place").itertuples():
        a, b = now(r.small), now(r.large)
        if a != b:
            gone, kept = (a, b) if size[a] <= size[b] else (b, a)
            became[gone] = kept
    return pd.DataFrame({"child": list(became), "parent": [now(c) for c in became]}, columns=["child", "parent"])


def resolve_merges(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """(child, parent) from candidates(small, large, large_shared) and sizes(cluster, n).

    Each small goes with the large of greatest large_shared; the chosen pairs are taken in the order of (lesser id, greater id,
    small) of each small's first candidate.  Pairs of different components never touch, so each component is one task."""
    pair = F.struct(F.least("small", "large").alias("lo"), F.greatest("small", "large").alias("hi"), "small", "large")
    ranked = candidates.withColumn("place", pair)
    best = Window.partitionBy("small").orderBy(F.col("large_shared").desc(), "place")
    chosen = ranked.withColumn("first", F.min("place").over(Window.partitionBy("small"))).withColumn("r", F.row_number().over(best)).filter("r = 1")
    chosen = graph.cut(chosen.select("small", "large", F.col("first.lo"), F.col("first.hi"), F.col("first.large").alias("at")))
    roots = graph.connected_components(chosen.select(F.col("small").alias("u"), F.col("large").alias("v")))
    named = chosen.join(roots.withColumnRenamed("node", "small"), "small")
    for side in ("small", "large"):
        named = named.join(sizes.select(F.col("cluster").alias(side), F.col("n").alias(f"{side}_size")), side)
    named = named.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("lo", "hi", "small", "at")))
    return named.select("root", "small", "large", "small_size", "large_size", "place").groupBy("root").applyInPandas(_merged, "child int, parent int")


def merge_contained(blocks: DataFrame, threshold: float = 0.8, reciprocal: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """blocks with contained clusters merged, and the merge map (child, parent)."""
    many = blocks.filter("cluster_id > 0").groupBy("cluster_id").count().filter("count >= 2").select("cluster_id")
    sides = block_sides(blocks).join(blocks.join(many, "cluster_id", "left_semi").select("block_id", F.col("cluster_id").alias("cluster")), "block_id")
    foot = graph.cut(sides.select("cluster", "genome", "contig", F.explode(F.sequence("start", "end")).alias("pos")).distinct())
    found = containment_candidates(foot, threshold=threshold, reciprocal=reciprocal)
    merged = graph.cut(resolve_merges(found.select("small", "large", "large_shared"), foot.groupBy("cluster").agg(F.count("*").alias("n"))))
    table = merged.select(F.col("child").alias("cluster_id"), F.col("parent").alias("_into"))
    return blocks.join(table, "cluster_id", "left").withColumn("cluster_id", F.coalesce("_into", "cluster_id")).drop("_into"), merged


def merge_hierarchy(merge_map: DataFrame, rounds: int = 24) -> DataFrame:
    """merge_map(child, parent) -> child, parent, root, depth, by pointer doubling: each round doubles the steps that a row has taken.
    A map with a cycle is an error."""
    now = graph.cut(merge_map.select("child", "parent", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    for _ in range(rounds):
        on = now.select(F.col("child").alias("root"), F.col("root").alias("_on"), F.col("depth").alias("_more"))
        step = now.join(on, "root", "left")
        if step.filter("_on IS NOT NULL").isEmpty():
            return now
        now = graph.cut(step.select("child", "parent", F.coalesce("_on", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
    raise ValueError("the merge map has a cycle")
