"""The browser's tables from the result of a batch run, as Parquet and, where asked for, as one SQLite file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators import explorer, genes, store, tokens
from locusweave.operators.intervals import block_sides, gene_block_mapping

#: Columns that the SQLite tables are looked up by.
KEYS = {
    "genes": ["gene_id", "contig_id"], "syntenic_blocks": ["block_id", "query_genome", "target_genome"], "cluster_assignments": ["block_id", "cluster_id"],
    "gene_block_mappings": ["gene_id", "block_id"], "annotations": ["gene_id"],
}


def with_domains(gene_table: DataFrame, annotations: DataFrame, source: str = "pfam") -> DataFrame:
    """gene_table with pfam_domains, pfam_count and primary_pfam from annotations(protein_id, source, accession)."""
    hits = annotations.filter(F.lower("source") == source).select(F.col("protein_id").alias("sequence_id"), F.col("accession").alias("hmm_name"))
    held = tokens.gene_domains(hits).withColumnRenamed("sequence_id", "gene_id")
    fresh = gene_table.drop("pfam_domains", "pfam_count", "primary_pfam")
    return fresh.join(held, "gene_id", "left").na.fill({"pfam_domains": "", "pfam_count": 0})


def browser_tables(gene_table: DataFrame, blocks: DataFrame, clusters: DataFrame, annotations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Genomes, contigs, genes, blocks, clusters, assignments, gene-block mappings and, if given, annotations by gene."""
    placed = genes.position_index(gene_table)
    if annotations is not None:
        placed = with_domains(placed, annotations)
    spots = placed.select("gene_id", F.col("sample_id").alias("genome"), F.col("contig_id").alias("contig"), F.col("position_index").alias("start"), F.col("position_index").alias("end"))
    mappings = gene_block_mapping(spots, block_sides(blocks), ["genome", "contig"], 64)
    out = explorer.star_schema(placed, blocks, clusters, mappings)
    if "pfam_domains" in placed.columns:
        out["genes"] = out["genes"].join(placed.select("gene_id", "pfam_domains", "pfam_count", "primary_pfam"), "gene_id", "left")
    if annotations is not None:
        known = annotations.withColumnRenamed("protein_id", "gene_id")
        out["annotations"] = known.join(placed.select("gene_id"), "gene_id", "left_semi")
        out["annotation_stats"] = known.groupBy("source").agg(F.count("*").alias("n_annotations"), F.countDistinct("gene_id").alias("n_genes"))
    return out


def write_browser(run: str, gene_table: DataFrame, path: str, annotations: DataFrame | None = None, sqlite: str | None = None) -> dict[str, DataFrame]:
    """Browser tables of the batch run in folder run, written under path and, if named, into the SQLite file on the driver."""
    spark = gene_table.sparkSession
    tables = browser_tables(gene_table, spark.read.parquet(f"{run}/blocks"), spark.read.parquet(f"{run}/cluster_table"), annotations)
    store.write_tables(tables, path)
    held = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    if sqlite:
        store.write_sqlite(held, sqlite, KEYS)
    return held
