"""Similarity anchors: nearest neighbours by cosine, then cross-genome pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.genes import strand
from locusweave.operators.nearest import index_search


def orientation(a: Column, b: Column) -> Column:
    """+1 for equal strands, -1 for different ones, 0 where the tables have no strands."""
    return F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).otherwise(-1)


_SIDE = ("idx", "genome", "contig", "gene_id")


def _sided(genes: DataFrame, key: str, side: str) -> DataFrame:
    return genes.select(
        F.col("_id").alias(key), F.col("position_index").alias(f"{side}_idx"), F.col("sample_id").alias(f"{side}_genome"),
        F.col("contig_id").alias(f"{side}_contig"), F.col("gene_id").alias(f"{side}_gene_id"), strand(genes).alias(f"{side}_strand"),
    )


def numbered(genes: DataFrame) -> DataFrame:
    """genes with a stable 64-bit _id of gene and place."""
    return genes.withColumn("_id", F.xxhash64("sample_id", "contig_id", "position_index", "gene_id"))


def cross_genome_anchors(genes: DataFrame, k: int = 50, tau: float = 0.85, search=index_search()) -> DataFrame:
    """Unordered cross-genome pairs among the k+10 nearest of each gene (the gene itself and its
    own genome count in k+10), similarity at least tau, the query genome first in string order."""
    genes = numbered(genes)
    vectors = genes.select(F.col("_id").alias("id"), F.col("emb").alias("v"))
    hits = search(vectors, vectors, k + 10).filter((F.col("sim") >= tau) & (F.col("i") != F.col("j")))
    pairs = hits.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("sim").alias("similarity"))
    both = pairs.join(_sided(genes, "i", "query"), "i").join(_sided(genes, "j", "target"), "j")
    both = both.filter("query_genome <> target_genome").drop("i", "j")
    swap = F.col("query_genome") > F.col("target_genome")
    out = [F.when(swap, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for c in _SIDE for a, b in (("query", "target"), ("target", "query"))]
    turn = orientation(F.col("query_strand"), F.col("target_strand"))
    return both.select(*out, "similarity", turn.cast("tinyint").alias("orientation"))


def locus_anchors(locus: DataFrame, genes: DataFrame, k: int = 50, tau: float = 0.85, search=index_search()) -> DataFrame:
    """Anchors from the genes of a locus to all genes but those of the locus' first genome."""
    genes, locus = numbered(genes), numbered(locus)
    first = locus.agg(F.min_by("sample_id", F.struct("contig_id", "position_index"))).first()[0]
    hits = search(locus.select(F.col("_id").alias("id"), F.col("emb").alias("v")), genes.select(F.col("_id").alias("id"), F.col("emb").alias("v")), k + 10)
    hits = hits.filter(F.col("sim") >= tau).select("i", "j", F.col("sim").alias("similarity"))
    both = hits.join(_sided(locus, "i", "query"), "i").join(_sided(genes, "j", "target"), "j").filter(F.col("target_genome") != F.lit(first))
    turn = orientation(F.col("query_strand"), F.col("target_strand"))
    return both.select(*[f"{s}_{c}" for s in ("query", "target") for c in _SIDE], "similarity", turn.cast("tinyint").alias("orientation"))


PAIR = ["query_genome", "target_genome", "query_contig", "target_contig"]


def by_contig_pair(anchors: DataFrame, min_size: int = 2) -> DataFrame:
    return anchors.groupBy(*PAIR).agg(F.count("*").alias("n_anchors"), F.sum("similarity").alias("sum_similarity")).filter(F.col("n_anchors") >= min_size)
