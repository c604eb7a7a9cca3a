"""Explorer queries over blocks, clusters, genomes and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.expr import all_of, size_bucket


def block_page(
    blocks: DataFrame, genomes: DataFrame, annotations: DataFrame | None = None, *, in_genomes: list | None = None, min_size: int | None = None,
    max_size: int | None = None, min_identity: float | None = None, block_type: str | None = None, locus_tokens: list[str] = (), domain: str | None = None,
    order: str = "score", offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """A page of blocks(block_id, query_genome_id, target_genome_id, query_locus, target_locus, size, score,
    identity) with both genomes' names; annotations(block_id, domains) serve the domain filter."""
    tests: list[Column] = []
    if in_genomes:
        tests.append(F.col("query_genome_id").isin(in_genomes) | F.col("target_genome_id").isin(in_genomes))
    if min_size is not None:
        tests.append(F.col("size") >= min_size)
    if max_size is not None:
        tests.append(F.col("size") <= max_size)
    if min_identity is not None:
        tests.append(F.col("identity") >= min_identity)
    if block_type:
        tests.append(size_bucket("size") == block_type)
    for token in locus_tokens:
        tests.append(F.lower("query_locus").contains(token.lower()) | F.lower("target_locus").contains(token.lower()))
    rows = blocks.filter(all_of(tests)) if tests else blocks
    if domain and annotations is not None:
        rows = rows.join(annotations.filter(F.lower("domains").contains(domain.lower())), "block_id", "left_semi")
    name = genomes.select("genome_id", "name")
    for side in ("query", "target"):
        rows = rows.join(name.withColumnsRenamed({"genome_id": f"{side}_genome_id", "name": f"{side}_name"}), f"{side}_genome_id", "left")
    by = {"score": [F.col("score").desc()], "size": [F.col("size").desc()], "identity": [F.col("identity").desc()], "id": []}[order]
    rows = rows.orderBy(*by, "block_id")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


def annotation_stats(genes: DataFrame, mappings: DataFrame, group: str) -> DataFrame:
    """Per group: genes, annotated and mapped genes, and the domain sum over the join (a gene counts
    once for each of its mappings, and once if it has none)."""
    met = genes.join(mappings, "gene_id", "left")
    return met.groupBy(group).agg(
        F.countDistinct("gene_id").alias("total_genes"), F.countDistinct(F.when(F.col("pfam_count") > 0, F.col("gene_id"))).alias("annotated_genes"),
        F.countDistinct(F.when(F.col("block_id").isNotNull(), F.col("gene_id"))).alias("mapped_genes"), F.sum("pfam_count").alias("pfam_sum"),
    )


def cluster_rebuild(blocks: DataFrame, cluster: str, length: str, identity: str, score: str, block: str) -> DataFrame:
    """Per cluster: size, mean length (whole), mean identity, representative (top score, then least id)."""
    return blocks.groupBy(cluster).agg(
        F.count("*").alias("size"), F.floor(F.avg(length)).cast("bigint").alias("mean_length"), F.avg(identity).alias("mean_identity"),
        F.max_by(block, F.struct(score, -F.col(block))).alias("representative"),
    )


def organisms(blocks: DataFrame, cluster: str, sides: list[str], sep: str = ",") -> DataFrame:
    """Sorted distinct organisms over both sides per cluster."""
    names = F.array_sort(F.array_union(*[F.collect_set(s) for s in sides])) if len(sides) > 1 else F.array_sort(F.collect_set(sides[0]))
    return blocks.groupBy(cluster).agg(F.array_join(names, sep).alias("organisms"), F.size(names).alias("n_organisms"))


def pair_matrix(blocks: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return blocks.groupBy(row).pivot(column, values).count().na.fill(0)


def dashboard(blocks: DataFrame, genomes: DataFrame, genes: DataFrame, cluster: str) -> DataFrame:
    """Counts of each table in one row (single aggregates side by side)."""
    one = blocks.agg(F.count("*").alias("n_blocks"), F.countDistinct(F.when(F.col(cluster) > 0, F.col(cluster))).alias("n_clusters"))
    return one.crossJoin(genomes.agg(F.count("*").alias("n_genomes"))).crossJoin(genes.agg(F.count("*").alias("n_genes")))


def region_slice(genes: DataFrame, key: list[str], order: list[str], first: int, last: int, flank: int) -> DataFrame:
    """Genes of positions first..last with flank on both sides and their role: core, boundary, context."""
    w = Window.partitionBy(*key).orderBy(*order)
    i = F.col("idx")
    role = F.when((i == first) | (i == last), "boundary").when(i.between(first, last), "core").otherwise("context")
    return genes.withColumn("idx", F.row_number().over(w) - 1).filter(i.between(first - flank, last + flank)).withColumn("role", role)


def micro_and_macro(macro: DataFrame, micro: DataFrame) -> DataFrame:
    """UNION ALL of two block sources with different columns, each marked."""
    return macro.withColumn("kind", F.lit("macro")).unionByName(micro.withColumn("kind", F.lit("micro")), allowMissingColumns=True)


def reassign(blocks: DataFrame, assigned: DataFrame) -> DataFrame:
    """blocks with cluster ids taken from assigned(block_id, new_cluster) where it has them."""
    return blocks.join(assigned, "block_id", "left").withColumn("cluster_id", F.coalesce("new_cluster", "cluster_id")).drop("new_cluster")


def merge_assignments(first: DataFrame, second: DataFrame, least: int = 2) -> DataFrame:
    """Two maps (block_id, cluster_id): the second fills blocks that the first leaves at 0, if its cluster
    has at least `least` blocks."""
    big = second.filter("cluster_id > 0").groupBy("cluster_id").count().filter(F.col("count") >= least)
    fill = second.join(big, "cluster_id", "left_semi").withColumnRenamed("cluster_id", "fill")
    met = first.join(fill, "block_id", "full")
    own = F.coalesce("cluster_id", F.lit(0))
    return met.select("block_id", F.when(own > 0, own).otherwise(F.coalesce("fill", F.lit(0))).alias("cluster_id"))


def having(rows: DataFrame, others: DataFrame, on: dict[str, str]) -> DataFrame:
    """rows for which some row of others has equal values (row column -> other column)."""
    asked = others.select(*[F.col(o).alias(c) for c, o in on.items()])
    return rows.join(asked, list(on), "left_semi")


def with_counts(rows: DataFrame, others: DataFrame, key: str, other_key: str, **aggregates: Column) -> DataFrame:
    """rows with aggregates over the rows of others that have its key; 0 where there are none."""
    per = others.groupBy(F.col(other_key).alias(key)).agg(*[x.alias(name) for name, x in aggregates.items()])
    return rows.join(per, key, "left").na.fill(0, list(aggregates))


def star_join(facts: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """facts joined with dimensions (table, column there, its key) one after another; the planner broadcasts those that are small."""
    for table, column, key in dimensions:
        facts = facts.join(table, facts[column] == table[key])
    return facts


def top_per_group(rows: DataFrame, group: str, by: str, tie: str, n: int) -> DataFrame:
    """The n rows of greatest `by` of each group, of equal ones those with the smaller tie."""
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), tie)
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def cluster_type(mean_length: str | None = None, size: str | None = None) -> Column:
    """Cluster type by mean length (as blocks) or by size (above 100, above 1000)."""
    if mean_length is not None:
        return size_bucket(mean_length)
    return F.when(F.col(size) > 1000, "large").when(F.col(size) > 100, "medium").otherwise("small")


def with_species(blocks: DataFrame, samples: DataFrame) -> DataFrame:
    """blocks with both sides' species, their unordered pair and is_cross_genus; complains about unmapped genomes."""
    out = blocks
    for side in ("query", "target"):
        look = samples.select(F.col("sample_id").alias(f"{side}_genome"), F.col("species").alias(f"{side}_species"))
        out = out.join(look, f"{side}_genome", "left")
    missing = out.filter(F.col("query_species").isNull() | F.col("target_species").isNull()).limit(1).collect()
    if missing:
        raise ValueError(f"no species for {missing[0]['query_genome']} or {missing[0]['target_genome']}")
    genus = lambda c: F.split(c, " ")[0]
    pair = F.concat_ws("-", F.array_sort(F.array("query_species", "target_species")))
    return out.withColumn("species_pair", pair).withColumn("is_cross_genus", genus("query_species") != genus("target_species"))


def export_best(blocks: DataFrame, score: str, identity: str, length: str, n: int = 1000) -> dict[str, DataFrame]:
    """High identity and long; longer than the 95th percentile; top n by score."""
    p95 = blocks.agg(F.percentile(length, F.lit(0.95)).alias("_p95"))
    return {
        "high_identity": blocks.filter((F.col(identity) > 0.9) & (F.col(length) > 5000)),
        "longest": blocks.join(F.broadcast(p95), F.col(length) > F.col("_p95")).drop("_p95"),
        "top_score": blocks.orderBy(F.col(score).desc(), "block_id").limit(n),
    }


def cluster_extent(blocks: DataFrame, mappings: DataFrame, genes: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per cluster: contigs (query and target counted apart), distinct genes, distinct domain lists."""
    contigs = blocks.groupBy(cluster).agg((F.countDistinct("query_contig") + F.countDistinct("target_contig")).alias("n_contigs"))
    met = mappings.join(blocks.select("block_id", cluster), "block_id").join(genes.select("gene_id", "pfam_domains"), "gene_id")
    held = met.groupBy(cluster).agg(F.countDistinct("gene_id").alias("n_genes"), F.countDistinct(F.when(F.col("pfam_domains") != "", F.col("pfam_domains"))).alias("n_domain_lists"))
    return contigs.join(held, cluster, "left").na.fill(0)


def pair_genome_counts(pairs: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Micro pairs: distinct genomes and contigs over both sides per cluster."""
    side = lambda s: F.struct(F.col(f"{s}_genome_id").alias("g"), F.col(f"{s}_contig_id").alias("c"))
    rows = pairs.select(cluster, F.explode(F.array(side("query"), side("target"))).alias("x"))
    return rows.groupBy(cluster).agg(F.countDistinct("x.g").alias("n_genomes"), F.countDistinct("x").alias("n_contigs"))


def star_schema(genes: DataFrame, blocks: DataFrame, clusters: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """The browser's tables: genomes, contigs, genes, blocks, clusters, assignments, mappings."""
    from locusweave.functions.expr import identity
    from locusweave.operators.genes import contig_rollup, genome_rollup, strand

    wide = blocks.withColumn("identity", identity("chain_score", "n_anchors")).withColumn("block_type", size_bucket("n_anchors"))
    return {
        "genomes": genome_rollup(genes), "contigs": contig_rollup(genes),
        "genes": genes.select("gene_id", F.col("sample_id").alias("genome_id"), "contig_id", "start", "end", strand(genes).alias("strand"), (F.col("end") - F.col("start") + 1).alias("gene_length")),
        "syntenic_blocks": wide, "clusters": clusters.withColumn("cluster_type", cluster_type(mean_length="mean_chain_length")),
        "cluster_assignments": blocks.filter("cluster_id > 0").select("block_id", "cluster_id"), "gene_block_mappings": mappings,
    }


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
