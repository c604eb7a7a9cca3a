"""Gene tables: embedding columns, positions on contigs, bp lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("sample_id", "contig_id", "gene_id", "start", "end")


def fold_vectors(df: DataFrame, prefix: str = "emb_", to: str = "emb") -> DataFrame:
    """Columns prefix000.. (in name order) as one array column; kept if it is there already."""
    if to in df.columns:
        return df
    wide = sorted(c for c in df.columns if c.startswith(prefix))
    if not wide:
        raise ValueError(f"no column {prefix}*")
    return df.withColumn(to, F.array(*[F.col(c).cast("float") for c in wide])).drop(*wide)


def checked(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"genes lack {', '.join(missing)}")
    return df


def strand(df: DataFrame) -> Column:
    """+1 or -1; an unknown strand (null, 0) of a table that has strands is +1, a table without them gives null."""
    if "strand" not in df.columns:
        return F.lit(None).cast("int")
    return F.when(df["strand"] < 0, -1).otherwise(1)


def position_index(genes: DataFrame) -> DataFrame:
    """0-based ordinal on the contig by start, end, gene_id."""
    order = Window.partitionBy("sample_id", "contig_id").orderBy("start", "end", "gene_id")
    return genes.withColumn("position_index", F.row_number().over(order) - 1)


def ordinal(rows: DataFrame, key: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with their 0-based place within the key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def genes_by_ordinal(genes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Genes between the ordinals of ranges(range_id, sample_id, contig_id, offset, size) of their contig: the fallback where a range names
    places, not genes."""
    placed = ordinal(genes, ["sample_id", "contig_id"], ["start", "gene_id"], "pos")
    spans = ranges.select("range_id", "sample_id", "contig_id", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("size") - 1)).alias("pos")).filter("size > 0")
    return spans.join(placed.select("sample_id", "contig_id", "pos", "gene_id"), ["sample_id", "contig_id", "pos"]).select("range_id", "gene_id", "pos")


def from_embeddings(vectors: DataFrame) -> DataFrame:
    """The genes view of embeddings(vec_id, embedding, label)."""
    return position_index(
        vectors.select(
            F.concat(F.lit("g"), "label").alias("sample_id"),
            F.concat(F.lit("c"), F.col("vec_id") % 2).alias("contig_id"),
            F.concat(F.lit("v"), "vec_id").alias("gene_id"),
            (F.col("vec_id") * 1000).alias("start"),
            (F.col("vec_id") * 1000 + 900).alias("end"),
            F.when(F.expr("vec_id div 2") % 2 == 0, 1).otherwise(-1).alias("strand"),
            F.col("embedding").alias("emb"),
        )
    )


def join_embeddings(proteins: DataFrame, vectors: DataFrame) -> DataFrame:
    """Inner join on gene_id; proteins without a vector drop out."""
    return proteins.join(vectors, "gene_id")


def block_bp_ranges(blocks: DataFrame, genes: DataFrame) -> DataFrame:
    """Blocks with bp of both sides' first and last gene (0 where a gene is missing)."""
    at = genes.select("sample_id", "contig_id", "position_index", "start", "end")
    out = blocks
    for side in ("query", "target"):
        for end, bp in (("start", "start"), ("end", "end")):
            look = at.select(
                F.col("sample_id").alias(f"{side}_genome"), F.col("contig_id").alias(f"{side}_contig"),
                F.col("position_index").alias(f"{side}_{end}"), F.col(bp).alias(f"{side}_{end}_bp"),
            )
            out = out.join(look, [f"{side}_genome", f"{side}_contig", f"{side}_{end}"], "left")
            out = out.withColumn(f"{side}_{end}_bp", F.coalesce(f"{side}_{end}_bp", F.lit(0)))
    return out


def genome_rollup(genes: DataFrame) -> DataFrame:
    return genes.groupBy(F.col("sample_id").alias("genome_id")).agg(
        F.countDistinct("contig_id").alias("n_contigs"), F.count("*").alias("n_genes"), F.max("end").alias("max_end")
    )


def contig_rollup(genes: DataFrame) -> DataFrame:
    return genes.groupBy(F.col("sample_id").alias("genome_id"), "contig_id").agg(
        F.count("*").alias("gene_count"), F.max("end").alias("length")
    )
