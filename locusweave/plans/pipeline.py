"""The batch run: genes -> anchors -> blocks -> clusters -> merged clusters -> architecture, each
stage a table under the output folder that a later run reads instead of computing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.operators import anchors, architecture, chains, clusters, genes, store


@dataclass(frozen=True)
class ChainConfig:
    k: int = 50
    similarity: float = 0.85
    max_gap: int | None = 2
    min_size: int = 2
    gap_penalty: float = 0.0
    jaccard: float = 0.3
    mutual_k: int = 5
    support: int = 2
    merge_threshold: float = 0.8
    merge_reciprocal: float = 0.5
    min_cluster_size: int = 3
    max_slots: int | None = 50  # None: clusters with references of any length
    index: str = "auto"  # see nearest.INDEXES
    nprobe: int | None = None  # of approximate indexes; None: measured for a recall of 0.95

    def search(self):
        return anchors.index_search(self.index, self.nprobe)


def run_chain_pipeline(gene_table: DataFrame, output: str, config: ChainConfig = ChainConfig()) -> DataFrame:
    """Run all stages and return the one-row summary.  A stage is read again only if the input and the settings up to it are the same; the
    folder of a stage carries a digest of both."""
    spark: SparkSession = gene_table.sparkSession
    placed = genes.position_index(genes.fold_vectors(genes.checked(gene_table)))
    known: list[object] = [store.input_digest(gene_table)]

    def stage(name: str, build, *settings: object) -> DataFrame:
        known.append((name, *settings))
        return store.stage(spark, f"{output}/{name}", build, key=store.digest_of(*known))

    c = config
    found = stage("anchors", lambda: anchors.cross_genome_anchors(placed, c.k, c.similarity, c.search()), c.k, c.similarity, c.index, c.nprobe)
    blocks = stage("blocks", lambda: chains.blocks(found, c.max_gap, c.min_size, c.gap_penalty), c.max_gap, c.min_size, c.gap_penalty)
    premerge = stage("premerge", lambda: clusters.cluster_blocks(blocks, c.jaccard, c.mutual_k, c.support), c.jaccard, c.mutual_k, c.support)
    merged, merge_map = clusters.merge_contained(blocks.join(premerge, "block_id"), c.merge_threshold, c.merge_reciprocal)
    clustered = stage("clustered_blocks", lambda: genes.block_bp_ranges(merged, placed), c.merge_threshold, c.merge_reciprocal)
    summary = stage("clusters", lambda: clusters.cluster_summary(clustered))
    merge_map.select(F.col("child").alias("child_cluster"), F.col("parent").alias("merged_into")).write.mode("overwrite").parquet(f"{output}/merge_map")
    store.write_csv(clustered.filter("cluster_id > 0"), f"{output}/blocks_csv")
    store.write_csv(summary, f"{output}/clusters_csv")
    store.write_tables({"blocks": clustered, "cluster_table": summary}, output)
    store.write_tables(architecture.run(clustered, placed, c.min_cluster_size, c.max_slots), f"{output}/architecture")
    return clusters.run_summary(clustered, summary, placed)


def search_locus(locus: DataFrame, gene_table: DataFrame, config: ChainConfig = ChainConfig(), max_results: int = 50) -> DataFrame:
    """Blocks between a locus and all other genomes, best first."""
    near = anchors.locus_anchors(locus, gene_table, config.k, config.similarity, config.search())
    return chains.blocks(near, config.max_gap, config.min_size, config.gap_penalty).orderBy(F.col("chain_score").desc(), "block_id").limit(max_results)
