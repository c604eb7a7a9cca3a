"""Driver queries of the library's own operators, bound to the generic tables, with their SQL.

QUERIES maps a key to (function of spark and folder, SQL or None).  Values are rounded half-up by
the same explicit formula on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.functions import expr as X
from locusweave.operators import anchors as A
from locusweave.operators import architecture, chains, clusters, communities, density, evaluation, explorer, genes, graph, intervals, nearest, regions, shingles, statistics, store, tokens
from locusweave.plans import pipeline
from locusweave.plans.chain_sql import blocks_sql, chains_sql, clusters_sql, components_sql, loci_sql, merged_sql, slot_rows_sql, slots_sql

TAU = 0.2
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.from_embeddings(table(spark, sf_dir, "embeddings"))


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", hour.alias("start"), (hour + F.floor("value") % 5).alias("end")
    )


WIDTH = 8  # hours in a bin: intervals are up to 5 hours long

GENES = """genes AS (
  SELECT 'g' || label AS sample_id, 'c' || (vec_id % 2) AS contig_id, 'v' || vec_id AS gene_id, vec_id * 1000 AS start, vec_id * 1000 + 900 AS "end",
    CASE WHEN (vec_id // 2) % 2 = 0 THEN 1 ELSE -1 END AS strand, CAST(embedding AS DOUBLE[]) AS emb,
    row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id * 1000, 'v' || vec_id) - 1 AS position_index
  FROM embeddings)"""
IV = """iv AS (
  SELECT event_id AS id, user_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s,
    CAST(floor(epoch(ts) / 3600) AS BIGINT) + CAST(floor(value) AS BIGINT) % 5 AS e FROM events)"""
KNN = f"""{GENES}, knn AS (
  SELECT a.gene_id AS qi, b.gene_id AS qj, a.sample_id AS ga, b.sample_id AS gb, list_cosine_similarity(a.emb, b.emb) AS sim,
    row_number() OVER (PARTITION BY a.gene_id ORDER BY list_cosine_similarity(a.emb, b.emb) DESC, b.gene_id) AS r
  FROM genes a CROSS JOIN genes b)"""
ANCHORS = f"""{KNN}, pairs AS (
  SELECT least(qi, qj) AS i, greatest(qi, qj) AS j, max(sim) AS similarity FROM knn
  WHERE r <= 60 AND sim >= {TAU} AND qi <> qj AND ga <> gb GROUP BY 1, 2), anchors AS (
  SELECT q.position_index AS query_idx, t.position_index AS target_idx, q.sample_id AS query_genome, t.sample_id AS target_genome,
    q.contig_id AS query_contig, t.contig_id AS target_contig, q.gene_id AS query_gene_id, t.gene_id AS target_gene_id, similarity,
    CASE WHEN q.strand = t.strand THEN 1 ELSE -1 END AS orientation
  FROM pairs p JOIN genes x ON x.gene_id = p.i JOIN genes y ON y.gene_id = p.j
  JOIN genes q ON q.gene_id = CASE WHEN x.sample_id <= y.sample_id THEN x.gene_id ELSE y.gene_id END
  JOIN genes t ON t.gene_id = CASE WHEN x.sample_id <= y.sample_id THEN y.gene_id ELSE x.gene_id END)"""


def r(x: str, d: int = 4) -> str:
    return f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"


# --- genes and vectors


@query(f"WITH {GENES} SELECT sample_id, contig_id, gene_id, position_index FROM genes")
def w1_position_index(spark, sf_dir):
    return genes_view(spark, sf_dir).select("sample_id", "contig_id", "gene_id", "position_index")


@query(f"WITH {GENES} SELECT a.vec_id AS range_id, g.gene_id, g.position_index AS pos FROM embeddings a JOIN genes x ON x.gene_id = 'v' || a.vec_id JOIN genes g ON g.sample_id = x.sample_id AND g.contig_id = x.contig_id AND g.position_index BETWEEN x.position_index // 2 AND x.position_index // 2 + 2")
def j9_genes_by_ordinal(spark, sf_dir):
    every = genes_view(spark, sf_dir)
    asked = every.select(F.substring("gene_id", 2, 20).cast("bigint").alias("range_id"), "sample_id", "contig_id", F.floor(F.col("position_index") / 2).cast("int").alias("offset"), F.lit(3).alias("size"))
    return genes.genes_by_ordinal(every, asked)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def w1_event_ordinal(spark, sf_dir):
    return genes.ordinal(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"SELECT vec_id, {r('sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))', 6)} AS norm FROM embeddings")
def p1_l2_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", X.fixed(X.norm("embedding"), 6).alias("norm"))


@query(f"WITH {GENES} SELECT sample_id AS genome_id, count(DISTINCT contig_id) AS n_contigs, count(*) AS n_genes, max(\"end\") AS max_end FROM genes GROUP BY 1")
def a7_genome_rollup(spark, sf_dir):
    return genes.genome_rollup(genes_view(spark, sf_dir))


@query(f"WITH {ANCHORS} SELECT query_gene_id, target_gene_id, query_genome, target_genome, orientation, {r('similarity')} AS similarity FROM anchors")
def j1_anchor_pairs(spark, sf_dir):
    found = A.cross_genome_anchors(genes_view(spark, sf_dir), 50, TAU)
    return found.select("query_gene_id", "target_gene_id", "query_genome", "target_genome", F.col("orientation").cast("int").alias("orientation"), X.fixed("similarity").alias("similarity"))


@query(
    f"WITH {ANCHORS} SELECT query_genome, target_genome, query_contig, target_contig, count(*) AS n_anchors, {r('sum(similarity)', 3)} AS sum_similarity FROM anchors GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"
)
def a1_anchors_by_contig_pair(spark, sf_dir):
    found = A.by_contig_pair(A.cross_genome_anchors(genes_view(spark, sf_dir), 50, TAU))
    return found.withColumn("sum_similarity", X.fixed("sum_similarity", 3))


_GROUP = "query_genome, target_genome, query_contig, target_contig"


@query(
    f"""WITH {ANCHORS}, g AS (SELECT *, count(*) OVER (PARTITION BY {_GROUP}) AS n FROM anchors),
    d AS (SELECT *, orientation < 0 AS rev, row_number() OVER (PARTITION BY {_GROUP}, query_idx, target_idx ORDER BY similarity DESC, query_gene_id, target_gene_id) AS r1 FROM g WHERE n >= 2),
    e AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP}, rev, query_idx ORDER BY similarity DESC, target_idx, query_gene_id, target_gene_id) AS r2 FROM d WHERE r1 = 1),
    f AS (SELECT *, count(*) OVER (PARTITION BY {_GROUP}, rev) AS n2 FROM e WHERE r2 = 1)
    SELECT {_GROUP}, rev, query_idx, target_idx, {r('similarity')} AS similarity FROM f WHERE n2 >= 2"""
)
def w2_anchor_dedup(spark, sf_dir):
    ready = chains.prepared(A.cross_genome_anchors(genes_view(spark, sf_dir), 50, TAU))
    return ready.select(*A.PAIR, "rev", "query_idx", "target_idx", X.fixed("similarity").alias("similarity"))


@query(
    f"""WITH {GENES}, l AS (SELECT * FROM genes WHERE sample_id = 'g0' AND contig_id = 'c0' AND position_index BETWEEN 0 AND 9), k AS (
      SELECT l.gene_id AS query_gene_id, b.gene_id AS target_gene_id, b.sample_id AS target_genome, list_cosine_similarity(l.emb, b.emb) AS sim,
        row_number() OVER (PARTITION BY l.gene_id ORDER BY list_cosine_similarity(l.emb, b.emb) DESC) AS r FROM l CROSS JOIN genes b)
    SELECT query_gene_id, target_gene_id, target_genome, {r('sim')} AS similarity FROM k WHERE r <= 60 AND sim >= {TAU} AND target_genome <> 'g0'"""
)
def j2_locus_search_anchors(spark, sf_dir):
    genome, contig, first, last = X.parse_locus("g0:c0:0-9")
    every = genes_view(spark, sf_dir)
    locus = every.filter((F.col("sample_id") == genome) & (F.col("contig_id") == contig) & F.col("position_index").between(first, last))
    return A.locus_anchors(locus, every, 50, TAU).select("query_gene_id", "target_gene_id", "target_genome", X.fixed("similarity").alias("similarity"))


def blocks_view(spark, sf_dir) -> DataFrame:
    return chains.blocks(A.cross_genome_anchors(genes_view(spark, sf_dir), 50, TAU), max_gap=2)


def clustered_blocks(spark, sf_dir) -> DataFrame:
    found = graph.cut(blocks_view(spark, sf_dir))
    return graph.cut(found.join(clusters.cluster_blocks(found), "block_id"))


_SCORE = r("score")
_LISTS = ("anchor_query_ids", "anchor_target_ids", "anchor_query_gene_ids", "anchor_target_gene_ids")


def _joined_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in _LISTS})


@query(
    f"""WITH RECURSIVE {blocks_sql(ANCHORS)} SELECT block_id, {_GROUP}, query_start, query_end, target_start, target_end, n_anchors, {_SCORE} AS chain_score, orientation, {", ".join(_LISTS)} FROM blocks"""
)
def g1_blocks(spark, sf_dir):
    return _joined_lists(blocks_view(spark, sf_dir)).withColumn("chain_score", X.fixed("chain_score"))


@query(
    f"""WITH RECURSIVE {chains_sql(ANCHORS, 5, 0.5)} SELECT row_number() OVER (ORDER BY {_GROUP}, rev, prio) - 1 AS block_id, {_GROUP}, n_anchors, {_SCORE} AS chain_score, CASE WHEN rev THEN -1 ELSE 1 END AS orientation FROM chain"""
)
def g1_chains_concave_gaps(spark, sf_dir):
    found = chains.blocks(A.cross_genome_anchors(genes_view(spark, sf_dir), 50, TAU), max_gap=5, gap_penalty=0.5, select=False)
    return found.select("block_id", *A.PAIR, "n_anchors", X.fixed("chain_score").alias("chain_score"), "orientation")


LOCUS = f"""{GENES}, l AS (SELECT * FROM genes WHERE sample_id = 'g0' AND contig_id = 'c0' AND position_index < 10), near_ AS (
      SELECT l.position_index AS query_idx, b.position_index AS target_idx, l.sample_id AS query_genome, b.sample_id AS target_genome, l.contig_id AS query_contig, b.contig_id AS target_contig,
        l.gene_id AS query_gene_id, b.gene_id AS target_gene_id, list_cosine_similarity(l.emb, b.emb) AS similarity, CASE WHEN l.strand = b.strand THEN 1 ELSE -1 END AS orientation,
        row_number() OVER (PARTITION BY l.gene_id ORDER BY list_cosine_similarity(l.emb, b.emb) DESC) AS r FROM l CROSS JOIN genes b),
    anchors AS (SELECT * EXCLUDE (r) FROM near_ WHERE r <= 60 AND similarity >= {TAU} AND target_genome <> 'g0')"""


@query(
    f"""WITH RECURSIVE {blocks_sql(LOCUS)} SELECT block_id, {_GROUP}, query_start, query_end, target_start, target_end, n_anchors, {_SCORE} AS chain_score, orientation, {", ".join(_LISTS)}
    FROM blocks ORDER BY score DESC, block_id LIMIT 50"""
)
def g13_locus_search(spark, sf_dir):
    every = genes_view(spark, sf_dir)
    locus = every.filter("sample_id = 'g0' AND contig_id = 'c0' AND position_index < 10")
    found = pipeline.search_locus(locus, every, pipeline.ChainConfig(similarity=TAU))
    return _joined_lists(found).withColumn("chain_score", X.fixed("chain_score"))


@query(
    f"""WITH RECURSIVE {blocks_sql(ANCHORS)} SELECT block_id, coalesce(a.start, 0) AS query_start_bp, coalesce(b."end", 0) AS query_end_bp, coalesce(c.start, 0) AS target_start_bp, coalesce(d."end", 0) AS target_end_bp
    FROM blocks LEFT JOIN genes a ON a.sample_id = query_genome AND a.contig_id = query_contig AND a.position_index = query_start LEFT JOIN genes b ON b.sample_id = query_genome AND b.contig_id = query_contig AND b.position_index = query_end
    LEFT JOIN genes c ON c.sample_id = target_genome AND c.contig_id = target_contig AND c.position_index = target_start LEFT JOIN genes d ON d.sample_id = target_genome AND d.contig_id = target_contig AND d.position_index = target_end"""
)
def j5_block_bp_ranges(spark, sf_dir):
    found = genes.block_bp_ranges(blocks_view(spark, sf_dir), genes_view(spark, sf_dir))
    return found.select("block_id", "query_start_bp", "query_end_bp", "target_start_bp", "target_end_bp")


@query(f"WITH RECURSIVE {clusters_sql(ANCHORS)} SELECT block_id, cluster_id, n_anchors FROM clustered")
def g6_block_clusters(spark, sf_dir):
    return clustered_blocks(spark, sf_dir).select("block_id", "cluster_id", "n_anchors")


@query(
    f"""WITH RECURSIVE {clusters_sql(ANCHORS)}, spot AS (SELECT DISTINCT cluster_id, genome, contig || ':' || unnest(range(s, e + 1)) AS p FROM sides JOIN clustered USING (block_id) WHERE cluster_id > 0),
    held AS (SELECT cluster_id, genome, '"' || genome || '":["' || string_agg(p, '","' ORDER BY p) || '"]' AS l FROM spot GROUP BY 1, 2),
    genes_ AS (SELECT cluster_id, count(*) AS genome_support, '{{' || string_agg(l, ',' ORDER BY genome) || '}}' AS genes FROM held GROUP BY 1)
    SELECT cluster_id, count(*) AS size, any_value(genome_support) AS genome_support, {r('avg(n_anchors)', 2)} AS mean_chain_length, any_value(genes) AS genes FROM clustered JOIN genes_ USING (cluster_id) GROUP BY 1"""
)
def a4_block_cluster_summary(spark, sf_dir):
    found = clustered_blocks(spark, sf_dir)
    mean = found.groupBy("cluster_id").agg(X.fixed(F.avg("n_anchors"), 2).alias("mean_chain_length"))
    told = clusters.cluster_summary(found).withColumn("genes", F.to_json("genes"))
    return told.drop("mean_chain_length").join(mean, "cluster_id")


@query(f"WITH RECURSIVE {merged_sql(ANCHORS)} SELECT block_id, cluster_id FROM merged")
def g7_merged_clusters(spark, sf_dir):
    merged, _ = clusters.merge_contained(clustered_blocks(spark, sf_dir))
    return merged.select("block_id", "cluster_id")


@query(
    f"""WITH RECURSIVE {clusters_sql(ANCHORS)}, c AS (SELECT cluster_id, count(*) AS size, (SELECT count(DISTINCT genome) FROM sides JOIN clustered k USING (block_id) WHERE k.cluster_id = x.cluster_id) AS support
      FROM clustered x WHERE cluster_id > 0 GROUP BY 1)
    SELECT (SELECT count(*) FROM genes) AS num_genes, (SELECT count(*) FROM blocks) AS num_blocks, (SELECT sum(n_anchors) FROM blocks) AS num_anchors, (SELECT count(*) FROM clustered WHERE cluster_id = 0) AS num_singletons,
      count(*) AS num_clusters, CAST(trunc(quantile_cont(support, 0.5)) AS INTEGER) AS median_support, {r('avg(size)')} AS mean_size FROM c WHERE size >= 2"""
)
def a6_run_summary(spark, sf_dir):
    found = clustered_blocks(spark, sf_dir)
    return clusters.run_summary(found, clusters.cluster_summary(found), genes_view(spark, sf_dir)).withColumn("mean_size", X.fixed("mean_size"))


def _architecture(name: str, key: str, sql: str | None = None, max_slots: int | None = None):
    def run(spark, sf_dir):
        return architecture.run(clustered_blocks(spark, sf_dir), genes_view(spark, sf_dir), max_slots=max_slots, tables=(name,))[name]

    run.__name__ = key
    return query(sql)(run)


g12_members = _architecture(
    "members", "g12_block_members",
    f"""WITH RECURSIVE {loci_sql(ANCHORS)}, p AS (SELECT block_id, role, genome, contig, unnest(range(s, e + 1)) AS position_index, unnest(range(0, e - s + 1)) AS anchor_order FROM chosen)
    SELECT block_id, role, genome, contig, anchor_order, p.position_index, coalesce(gene_id, genome || '_' || contig || '_' || p.position_index) AS gene_id, coalesce(strand, 0) AS strand, g.start AS bp_start, g."end" AS bp_end
    FROM p LEFT JOIN genes g ON g.sample_id = genome AND g.contig_id = contig AND g.position_index = p.position_index""",
)
g11_loci = _architecture("loci", "g11_cluster_loci", f"WITH RECURSIVE {loci_sql(ANCHORS)} SELECT * FROM loci")
w11_references = _architecture(
    "references", "w11_cluster_references",
    f"""WITH RECURSIVE {loci_sql(ANCHORS)}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY support DESC, n_genes DESC, locus_id) AS k FROM loci)
    SELECT cluster_id, locus_id AS ref_locus, n_genes AS ref_genes FROM k WHERE k = 1""",
)
a9_slots = _architecture("slots", "a9_slot_summary", f"WITH RECURSIVE {slot_rows_sql(ANCHORS, 50)} SELECT * FROM slots", max_slots=50)
a11_arch = _architecture(
    "architecture", "a11_architecture",
    f"""WITH RECURSIVE {slot_rows_sql(ANCHORS)}, x AS (SELECT cluster_id, count(*) FILTER (is_insertion) AS n_insertions, count(DISTINCT locus_id) AS n_loci FROM assigned GROUP BY 1),
    a AS (SELECT cluster_id, count(*) AS n_slots, count(*) FILTER (is_core) AS n_core, sum(CAST(round(occupancy * 1000) AS BIGINT)) / (1000 * count(*)) AS mean, count(*) FILTER (n_types > 1) AS n_hotspots FROM slots GROUP BY 1),
    c AS (SELECT *, round_even(n_core / n_slots * mean, 4) AS coherence FROM a JOIN x USING (cluster_id))
    SELECT cluster_id, n_slots, n_core, {r('mean')} AS mean_occupancy, n_hotspots, n_insertions, n_loci, coherence,
      CASE WHEN coherence >= 0.7 AND n_hotspots = 0 THEN 'coherent' WHEN n_hotspots > 0 THEN 'variable' WHEN coherence >= 0.4 THEN 'moderate' ELSE 'fragmented' END AS label FROM c""",
)


@query(f"WITH RECURSIVE {slots_sql(ANCHORS)} SELECT cluster_id, locus_id, gene_id, position_index, slot, {r('similarity')} AS similarity, is_insertion FROM assigned")
def g10_slot_assignments(spark, sf_dir):
    found = architecture.run(clustered_blocks(spark, sf_dir), genes_view(spark, sf_dir), tables=("assignments",))["assignments"]
    return found.withColumn("similarity", X.fixed("similarity"))


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query()
def j3_ann_recall(spark, sf_dir):
    v = _rows(spark, sf_dir)
    return evaluation.ann_recall(nearest.nearest_exact(v, v, 10), nearest.nearest_ivf(v, v, 10, recall=0.98))


def _reached(spark, sf_dir, search, least: float) -> DataFrame:
    v = _rows(spark, sf_dir)
    return evaluation.ann_recall(nearest.nearest_exact(v, v, 10), search(v, v, 10)).select("total", (F.col("recall") >= least).alias("reached"))


REACHED = "SELECT count(*) * least(10, count(*)) AS total, true AS reached FROM embeddings"


@query(REACHED)
def j3_flat_recall(spark, sf_dir):
    """Whether cells, as many as a sample asks for, find 0.95 of the true neighbours."""
    return _reached(spark, sf_dir, nearest.index_search("ivf_flat", recall=0.98), 0.95)


@query(REACHED)
def j3_codes_recall(spark, sf_dir):
    """Whether product codes whose shortlist is ranked again find 0.9 of the true neighbours."""
    return _reached(spark, sf_dir, nearest.index_search("ivf_pq", recall=0.98), 0.9)


@query(REACHED)
def j3_graph_recall(spark, sf_dir):
    """Whether walks over neighbour graphs find 0.95 of the true neighbours."""
    return _reached(spark, sf_dir, nearest.index_search("graph"), 0.95)


def _nearest_sql(k: int) -> str:
    return f"""WITH k AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a CROSS JOIN embeddings b),
      n AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY round(sim, 12) DESC, j) AS INTEGER) AS rank FROM k) SELECT i, j, rank, {r('sim')} AS sim FROM n WHERE rank <= {k}"""


@query(_nearest_sql(10))
def j1_pruned_cells(spark, sf_dir):
    v = _rows(spark, sf_dir)
    return nearest.nearest_cells(v, v, 10).withColumn("sim", X.fixed("sim")).select("i", "j", "rank", "sim")


@query(_nearest_sql(5))
def k7_store_search(spark, sf_dir):
    """A store of two thirds of the vectors and its index; the others are added; all are asked for their neighbours."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("gene_id"), F.col("embedding").alias("emb"))
    grown = store.GeneStore.create(rows.filter("gene_id % 3 <> 0"), f"{graph.checkpoint_folder(spark)}/store-{uuid.uuid4().hex}").build_index().add(rows)
    found = grown.search(_rows(spark, sf_dir), 5)
    return found.select("i", F.col("gene_id").cast("bigint").alias("j"), "rank", X.fixed("sim").alias("sim"))


@query()
def g23_density_clusters(spark, sf_dir):
    """Clusters of dense places on the sphere, by mutual reachability over the ten nearest; tests compare with a plain implementation."""
    v = _rows(spark, sf_dir)
    near = nearest.nearest_exact(v, v, 10).withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("sim"))))
    return density.hdbscan(density.itself_first(near), 5)


@query()
def g17_window_shingles(spark, sf_dir):
    v = genes_view(spark, sf_dir)
    tokened = shingles.token_windows(v.select("sample_id", "position_index", "contig_id", "emb").withColumn("block", F.concat_ws(":", "sample_id", "contig_id")), 64, 8, 4)
    return shingles.shingle_blocks(tokened, "block", "position_index", k=2, mode="bandset")


@query()
def g21_sinkhorn_rerank(spark, sf_dir):
    """Windows of which genes share at least two projection tokens, by the cost of moving one onto the other."""
    genes_ = genes_view(spark, sf_dir)
    runs = shingles.windows(genes_, ["sample_id", "contig_id"], ["position_index"], 5, 5)
    named = runs.select(F.concat_ws(":", "sample_id", "contig_id", "window").alias("id"), "ids", F.col("vectors").alias("vs"))
    tokened = shingles.token_windows(genes_.select("gene_id", "emb"), 64, 8, 10)
    held = named.select("id", F.explode("ids").alias("gene_id")).join(tokened, "gene_id").groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return shingles.rerank_sharing(held.join(named.select("id", "vs"), "id"), 2, top_k=3).withColumn("cost", X.fixed("cost", 6))


@query()
def g24_projection(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    mean, comp, _ = shingles.pca(v, 8)
    return _values(shingles.project(v, mean, comp))


# --- intervals


@query(f"WITH {IV} SELECT a.id AS u, b.id AS v FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e AND a.id < b.id")
def j7_interval_overlap_pairs(spark, sf_dir):
    return intervals.overlap_pairs(event_intervals(spark, sf_dir), ["user_id"], WIDTH)


JACCARD = f"""{IV}, edges AS (SELECT * FROM (
  SELECT a.id AS u, b.id AS v, (least(a.e, b.e) - greatest(a.s, b.s) + 1) / ((a.e - a.s + 1) + (b.e - b.s + 1) - (least(a.e, b.e) - greatest(a.s, b.s) + 1)) AS w
  FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e AND a.id < b.id) WHERE w >= 0.3)"""


def interval_edges(spark, sf_dir) -> DataFrame:
    return intervals.jaccard_edges(event_intervals(spark, sf_dir), ["user_id"], 0.3, WIDTH)


@query(f"WITH {JACCARD} SELECT u, v, {r('w')} AS w FROM edges")
def a3_interval_jaccard(spark, sf_dir):
    return interval_edges(spark, sf_dir).withColumn("w", X.fixed("w"))


MUTUAL = f"""{JACCARD}, both_ AS (SELECT u, v, w FROM edges UNION ALL SELECT v, u, w FROM edges),
  top AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS k FROM both_),
  mutual AS (SELECT a.u, a.v, a.w FROM top a JOIN top b ON a.u = b.v AND a.v = b.u WHERE a.k <= 2 AND b.k <= 2 AND a.u < a.v)"""


@query(f"WITH {MUTUAL} SELECT u, v, {r('w')} AS w FROM mutual")
def w4_mutual_top_k(spark, sf_dir):
    return graph.mutual_top_k(interval_edges(spark, sf_dir), 2).withColumn("w", X.fixed("w"))


COMPONENTS = f"""RECURSIVE {MUTUAL}, links AS (SELECT u, v FROM mutual UNION ALL SELECT v, u FROM mutual),
  reach(node, root) AS (SELECT id, id FROM iv UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node WHERE r.root < l.v),
  comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


def interval_components(spark, sf_dir) -> DataFrame:
    nodes = event_intervals(spark, sf_dir).select(F.col("id").alias("node"))
    return graph.components_of(nodes, graph.mutual_top_k(interval_edges(spark, sf_dir), 2))


@query(f"WITH {COMPONENTS} SELECT node, root FROM comp")
def g5_components(spark, sf_dir):
    return interval_components(spark, sf_dir)


@query(
    f"""WITH {COMPONENTS} SELECT root AS cluster_id, count(*) AS size, count(DISTINCT event_type) AS support, {r('avg(e - s + 1)', 2)} AS mean_length,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM comp JOIN iv ON iv.id = comp.node GROUP BY 1"""
)
def a4_cluster_summary(spark, sf_dir):
    met = interval_components(spark, sf_dir).withColumnRenamed("node", "id").join(event_intervals(spark, sf_dir), "id")
    members = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return met.groupBy(F.col("root").alias("cluster_id")).agg(
        F.count("*").alias("size"), F.countDistinct("event_type").alias("support"), X.fixed(F.avg(F.col("end") - F.col("start") + 1), 2).alias("mean_length"), members.alias("members")
    )


@query(
    f"""WITH {IV}, foot AS (SELECT DISTINCT user_id || ':' || event_type AS c, user_id, unnest(range(s, e + 1)) AS pos FROM iv),
    ov AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM foot a JOIN foot b ON a.user_id = b.user_id AND a.pos = b.pos AND a.c < b.c GROUP BY 1, 2),
    t AS (SELECT c, count(*) AS total FROM foot GROUP BY 1)
    SELECT CASE WHEN x.total <= y.total THEN a ELSE b END AS small, CASE WHEN x.total <= y.total THEN b ELSE a END AS large, n AS overlap,
      least(x.total, y.total) AS small_shared, greatest(x.total, y.total) AS large_shared
    FROM ov JOIN t x ON x.c = a JOIN t y ON y.c = b WHERE n / least(x.total, y.total) >= 0.3 AND n / greatest(x.total, y.total) >= 0.1"""
)
def j17_contained_clusters(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    foot = iv.select(F.concat_ws(":", "user_id", "event_type").alias("cluster"), "user_id", F.explode(F.sequence("start", "end")).alias("pos")).distinct()
    return clusters.containment_candidates(foot, "user_id", ("user_id", "pos"), 0.3, 0.1)


def _islands(gap: int) -> str:
    return f"""{IV}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
      f AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS isl FROM m),
      islands AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n, count(DISTINCT event_type) AS kinds FROM f GROUP BY user_id, isl)"""


@query(f'WITH {_islands(1)} SELECT user_id, s AS start, e AS "end" FROM islands')
def w7_merge_intervals(spark, sf_dir):
    return intervals.merge_islands(event_intervals(spark, sf_dir), ["user_id"], 1)


@query(f'WITH {_islands(24)} SELECT user_id, s AS start, e AS "end", n, kinds FROM islands WHERE kinds >= 2')
def w8_merge_intervals_gap(spark, sf_dir):
    more = [F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds")]
    return intervals.merge_islands(event_intervals(spark, sf_dir), ["user_id"], 24, more).filter("kinds >= 2")


@query(f'WITH {_islands(1)} SELECT i.user_id, i.s AS start, i.e AS "end", count(*) AS support FROM islands i JOIN iv ON iv.user_id = i.user_id AND iv.s <= i.e AND i.s <= iv.e GROUP BY 1, 2, 3')
def w7b_locus_support(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return intervals.island_support(intervals.merge_islands(iv, ["user_id"], 1), iv, ["user_id"], 64)


@query(
    f"""WITH {_islands(1)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, e - s DESC, s) AS k FROM islands)
    SELECT user_id, s AS start, e AS "end", n FROM ranked WHERE k = 1"""
)
def w11_reference_locus(spark, sf_dir):
    found = intervals.merge_islands(event_intervals(spark, sf_dir), ["user_id"], 1, [F.count("*").alias("n")])
    order = Window.partitionBy("user_id").orderBy(F.col("n").desc(), (F.col("end") - F.col("start")).desc(), "start")
    return found.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


@query(
    f"""WITH {IV}, g AS (SELECT id AS gene_id, user_id, s FROM iv WHERE event_type = 'click'),
    side AS (SELECT a.id AS block_id, 'query' AS role, a.user_id, a.s, a.e FROM iv a WHERE event_type = 'view'
      UNION ALL SELECT id, 'target', user_id, s + 24, e + 24 FROM iv WHERE event_type = 'view'),
    met AS (SELECT g.gene_id, b.block_id, min(role) AS role, min(g.s) AS s FROM g JOIN side b ON g.user_id = b.user_id AND g.s BETWEEN b.s AND b.e GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY block_id, role ORDER BY s, gene_id) - 1 AS i, count(*) OVER (PARTITION BY block_id, role) AS n FROM met)
    SELECT gene_id, block_id, role, {r('CASE WHEN n > 1 THEN i / (n - 1) ELSE 0.0 END')} AS relative_position FROM p"""
)
def j8_gene_block_mapping(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    points = iv.filter("event_type = 'click'").select(F.col("id").alias("gene_id"), "user_id", "start", F.col("start").alias("end"))
    views = iv.filter("event_type = 'view'")
    sides = views.select(F.col("id").alias("block_id"), F.lit("query").alias("role"), "user_id", "start", "end").unionByName(
        views.select(F.col("id").alias("block_id"), F.lit("target").alias("role"), "user_id", (F.col("start") + 24).alias("start"), (F.col("end") + 24).alias("end"))
    )
    return intervals.gene_block_mapping(points, sides, ["user_id"], WIDTH).withColumn("relative_position", X.fixed("relative_position"))


# Ranges of user pairs (u, u + 1): per event type, cut at day 10 and 20, the hours from the first to the last event.
RANGES = f"""{IV}, span AS (SELECT user_id, event_type, (s - 473352) // 240 AS part, min(s) AS s, max(e) AS e FROM iv GROUP BY 1, 2, 3),
  ranges AS (SELECT a.event_type, a.part, a.user_id AS genome_a, b.user_id AS genome_b, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end,
    a.user_id * 100 + a.part * 10 + ascii(a.event_type) % 10 AS rid FROM span a JOIN span b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type AND a.part = b.part),
  gt AS (SELECT * FROM ranges WHERE event_type = 'purchase'), pred AS (SELECT * FROM ranges WHERE event_type IN ('view', 'error')),
  pred2 AS (SELECT rid, genome_a, genome_b, a_start, a_end, b_start, b_end FROM pred UNION ALL SELECT rid, genome_b, genome_a, b_start, b_end, a_start, a_end FROM pred),
  met AS (SELECT g.rid AS gt_id, g.a_end - g.a_start + g.b_end - g.b_start + 2 AS own, p.rid AS block_id, p.a_end - p.a_start + p.b_end - p.b_start + 2 AS span,
    coalesce(greatest(0, least(g.a_end, p.a_end) - greatest(g.a_start, p.a_start) + 1) / (g.a_end - g.a_start + 1), 0) AS fa,
    coalesce(greatest(0, least(g.b_end, p.b_end) - greatest(g.b_start, p.b_start) + 1) / (g.b_end - g.b_start + 1), 0) AS fb
    FROM gt g LEFT JOIN pred2 p ON p.genome_a = g.genome_a AND p.genome_b = g.genome_b)"""


def user_ranges(spark, sf_dir) -> DataFrame:
    part = F.expr("(start - 473352) div 240")
    span = event_intervals(spark, sf_dir).groupBy("user_id", "event_type", part.alias("part")).agg(F.min("start").alias("s"), F.max("end").alias("e"))
    a = span.select("event_type", "part", F.col("user_id").alias("genome_a"), (F.col("user_id") + 1).alias("genome_b"), F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    b = span.select("event_type", "part", F.col("user_id").alias("genome_b"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    rid = F.col("genome_a") * 100 + F.col("part") * 10 + F.ascii("event_type") % 10
    return a.join(b, ["event_type", "part", "genome_b"]).withColumn("rid", rid)


def truth_and_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    every = user_ranges(spark, sf_dir)
    truth = every.filter("event_type = 'purchase'").select(F.col("rid").alias("gt_id"), *intervals.RANGE)
    return truth, every.filter("event_type IN ('view', 'error')").select(F.col("rid").alias("block_id"), *intervals.RANGE)


@query(
    f"""WITH {RANGES} SELECT gt_id, {r('max(fa)')} AS best_a, {r('max(fb)')} AS best_b, max(CASE WHEN fa >= 0.5 AND fb >= 0.5 THEN 1 ELSE 0 END) AS strict,
    CASE WHEN max(fa) >= 0.5 AND max(fb) >= 0.5 THEN 1 ELSE 0 END AS independent, CASE WHEN max(fa) >= 0.5 OR max(fb) >= 0.5 THEN 1 ELSE 0 END AS "any" FROM met GROUP BY 1"""
)
def j19_range_recall(spark, sf_dir):
    told = intervals.range_recall(*truth_and_blocks(spark, sf_dir))
    return told.withColumn("best_a", X.fixed("best_a")).withColumn("best_b", X.fixed("best_b"))


@query(
    f"""WITH {RANGES}, ok AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY span, block_id) AS k FROM met WHERE fa >= 0.5 AND fb >= 0.5)
    SELECT gt_id, block_id, span, {r('span / own')} AS size_ratio FROM ok WHERE k = 1"""
)
def j22_best_cover(spark, sf_dir):
    return intervals.best_cover(*truth_and_blocks(spark, sf_dir)).select("gt_id", "block_id", "span", X.fixed("size_ratio").alias("size_ratio"))


@query(
    f"""WITH {RANGES} SELECT a.rid AS block_id, count(*) AS n_inside FROM ranges a JOIN ranges b ON a.genome_a = b.genome_a AND a.genome_b = b.genome_b AND a.rid <> b.rid
    AND a.a_start <= b.a_start AND b.a_end <= a.a_end AND a.b_start <= b.b_start AND b.b_end <= a.b_end GROUP BY 1 HAVING count(*) >= 1"""
)
def j23_containment(spark, sf_dir):
    return intervals.containers(user_ranges(spark, sf_dir).select(F.col("rid").alias("block_id"), *intervals.RANGE), 1)


@query(
    f"""WITH {IV}, p AS (SELECT id, user_id, s FROM iv WHERE event_type = 'error'), g AS (SELECT user_id, s, min(id) AS id FROM iv WHERE event_type = 'view' GROUP BY 1, 2),
    k AS (SELECT p.id AS point_id, abs(g.s - p.s) AS distance, row_number() OVER (PARTITION BY p.id ORDER BY abs(g.s - p.s), g.s) AS k FROM p JOIN g USING (user_id))
    SELECT point_id, distance FROM k WHERE k = 1"""
)
def j24_nearest_start(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    points = iv.filter("event_type = 'error'").select(F.col("id").alias("point_id"), "user_id", F.col("start").alias("at"))
    near = intervals.nearest_start(points, iv.filter("event_type = 'view'").select(F.col("id").cast("string").alias("gene_id"), "user_id", "start"), ["user_id"])
    return near.filter("gene_id IS NOT NULL").select("point_id", "distance")


@query(
    f"""WITH {IV}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, id) - 1 AS pos FROM iv), b AS (SELECT user_id, min(pos) + 2 AS a, max(pos) - 2 AS z FROM q GROUP BY 1)
    SELECT q.id, q.user_id, q.pos FROM q JOIN b ON q.user_id = b.user_id AND q.pos BETWEEN b.a AND b.z"""
)
def j11_between_join(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("start", "id")
    q = event_intervals(spark, sf_dir).select("id", "user_id", (F.row_number().over(order) - 1).alias("pos"))
    b = q.groupBy("user_id").agg((F.min("pos") + 2).alias("start_index"), (F.max("pos") - 2).alias("end_index")).filter("start_index <= end_index")
    return intervals.between_join(q, b, ["user_id"], 32).select("id", "user_id", "pos")


# --- tokens


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1")
def a16_token_domain_counts(spark, sf_dir):
    return tokens.domain_counts(table(spark, sf_dir, "part"), "p_name", " ")


@query(
    "SELECT p_brand AS sequence_id, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS pfam_domains, count(DISTINCT p_type) AS pfam_count, min(p_type) AS primary_pfam FROM part GROUP BY 1"
)
def s7_gene_domains(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sequence_id"), F.col("p_type").alias("hmm_name"))
    return tokens.gene_domains(hits)


@query("SELECT p_brand AS sequence_id, string_agg(p_type, ';' ORDER BY p_partkey, p_type) AS pfam_domains FROM part GROUP BY 1")
def s19_gene_domains_in_order(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sequence_id"), F.col("p_type").alias("hmm_name"), F.col("p_partkey").alias("env_from"))
    return tokens.gene_domains_in_order(hits)


SEQ = """seq AS (SELECT user_id, event_type AS token, CAST(floor(value / 10) AS BIGINT) AS v, CASE WHEN value >= 30 THEN 1 ELSE -1 END AS strand,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def event_sequence(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("token"), F.floor(F.col("value") / 10).alias("v"), F.when(F.col("value") >= 30, 1).otherwise(-1).alias("strand"), (F.row_number().over(order) - 1).alias("pos")
    )


@query(
    f"""WITH {SEQ}, h AS (SELECT user_id, token || ':' || v AS token, 2 * pos < count(*) OVER (PARTITION BY user_id) AS first_half FROM seq),
    x AS (SELECT DISTINCT user_id, token FROM h WHERE first_half), y AS (SELECT DISTINCT user_id, token FROM h WHERE NOT first_half)
    SELECT u.user_id AS block_id, count(y.token) AS n_shared FROM (SELECT DISTINCT user_id FROM seq) u LEFT JOIN x ON x.user_id = u.user_id
    LEFT JOIN y ON y.user_id = x.user_id AND y.token = x.token GROUP BY 1"""
)
def j16_token_intersection(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("user_id"))
    seq = event_sequence(spark, sf_dir).withColumn("half", 2 * F.col("pos") < n).withColumn("token", F.concat_ws(":", "token", "v")).withColumnRenamed("user_id", "block_id")
    return tokens.token_intersection(seq.filter("half"), seq.filter("NOT half"), seq.select("block_id").distinct())


TOK = "tok AS (SELECT DISTINCT doc_id AS doc, unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents)"


def document_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("token")).distinct()


@query(
    f"""WITH {TOK}, n AS (SELECT count(DISTINCT doc) AS n FROM tok), df AS (SELECT token, count(*) AS df FROM tok GROUP BY 1),
    sets AS (SELECT doc, list_sort(list(token)) AS l FROM tok GROUP BY 1), reps AS (SELECT min(doc) AS doc, count(*) AS size FROM sets GROUP BY l),
    w AS (SELECT doc, size, tok.token, ln(1 + n / df) AS idf FROM tok JOIN reps USING (doc) JOIN df USING (token) CROSS JOIN n),
    t AS (SELECT doc, size, sum(idf) AS total FROM w GROUP BY 1, 2), s AS (SELECT a.doc AS a, b.doc AS b, sum(a.idf) AS shared FROM w a JOIN w b ON a.token = b.token AND a.doc < b.doc GROUP BY 1, 2)
    SELECT a, b, x.size AS size_a, y.size AS size_b, {r('shared / (x.total + y.total - shared)')} AS jaccard FROM s JOIN t x ON x.doc = a JOIN t y ON y.doc = b WHERE shared / (x.total + y.total - shared) >= 0.8
    UNION ALL SELECT rep, doc, size, size, 1.0 FROM (SELECT doc, min(doc) OVER same AS rep, count(*) OVER same AS size FROM sets WINDOW same AS (PARTITION BY l)) WHERE doc <> rep"""
)
def j18_idf_weighted_jaccard(spark, sf_dir):
    """Pairs of different token sets of similarity 0.8 or more, each named by its least document, with the number of documents that have it; and
    every other document of a set, paired with that least one at similarity 1, so that no link is lost."""
    texts = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.array_distinct(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("tokens"))
    listed = tokens.single_lists(texts)
    classes = graph.written(tokens.set_classes(listed))
    reps = classes.filter("doc = rep").select("doc", "size")
    pairs = tokens.similar_sets(listed, 0.8, reps).withColumn("jaccard", X.fixed("jaccard"))
    size = lambda side: reps.select(F.col("doc").alias(side), F.col("size").alias(f"size_{side}"))
    members = classes.filter("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.lit(1.0).alias("jaccard"))
    return pairs.join(size("a"), "a").join(size("b"), "b").unionByName(members)


@query(
    f"""WITH {TOK}, df AS (SELECT token, count(*) AS df FROM tok GROUP BY 1), o AS (SELECT df, row_number() OVER (ORDER BY df) - 1 AS i, count(*) OVER () AS n FROM df),
    c AS (SELECT df AS cutoff FROM o WHERE i = CAST(floor(0.99 * (n - 1)) AS BIGINT)) SELECT token, df, cutoff FROM df CROSS JOIN c WHERE df >= cutoff"""
)
def a25_df_percentile_ban(spark, sf_dir):
    return tokens.percentile_ban(tokens.document_frequency(document_tokens(spark, sf_dir)), 0.99)


RUNS = f"""{SEQ}, lagged AS (SELECT *, lag(token) OVER (PARTITION BY user_id ORDER BY pos) AS before_ FROM seq),
  runs AS (SELECT user_id, token, strand, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM lagged WHERE before_ IS NULL OR before_ <> token)"""


@query(f"WITH {RUNS} SELECT user_id, token, pos FROM runs")
def w9_compact_runs(spark, sf_dir):
    return tokens.compact_runs(event_sequence(spark, sf_dir), "user_id", ["pos"]).select("user_id", "token", "pos")


@query(
    f"""WITH {RUNS}, f AS (SELECT user_id, token, arg_min(CASE WHEN n > 1 THEN i / (n - 1) ELSE 0.0 END, i) AS place, arg_min(strand, i) AS strand, count(*) AS occ FROM runs GROUP BY 1, 2)
    SELECT token, count(*) AS df, sum(occ) AS n_occ, {r('avg(place)')} AS mean_pos, {r('avg(CASE WHEN strand > 0 THEN 1 ELSE 0 END)')} AS fwd_frac,
      {r('count(*) / (SELECT count(DISTINCT user_id) FROM seq)')} AS coverage, '#' || substr(md5(token), 1, 6) AS color FROM f GROUP BY token
    HAVING count(*) / (SELECT count(DISTINCT user_id) FROM seq) >= 0.5"""
)
def a26_consensus_tokens(spark, sf_dir):
    told = tokens.consensus(event_sequence(spark, sf_dir), "user_id", "pos", "strand")
    return told.withColumns({c: X.fixed(c) for c in ("mean_pos", "fwd_frac", "coverage")})


@query(
    f"""WITH {RUNS}, p AS (SELECT token, strand, lead(token) OVER (PARTITION BY user_id ORDER BY pos) AS next_token, lead(strand) OVER (PARTITION BY user_id ORDER BY pos) AS s2 FROM runs)
    SELECT token, next_token, count(*) AS support, {r('avg(CASE WHEN strand = s2 THEN 1 ELSE 0 END)')} AS same_frac FROM p WHERE next_token IS NOT NULL GROUP BY 1, 2"""
)
def a27_consensus_pairs(spark, sf_dir):
    return tokens.adjacent_pairs(event_sequence(spark, sf_dir), "user_id", "pos", "strand").withColumn("same_frac", X.fixed("same_frac"))


KMERS = f"""{SEQ}, w3 AS (SELECT user_id, pos, token AS a, lead(token, 1) OVER o AS b, lead(token, 2) OVER o AS c FROM seq WINDOW o AS (PARTITION BY user_id ORDER BY pos)),
  kmers AS (SELECT user_id, pos, CASE WHEN a <= c THEN a || '|' || b || '|' || c ELSE c || '|' || b || '|' || a END AS kmer FROM w3 WHERE c IS NOT NULL)"""


@query(f"WITH {KMERS} SELECT kmer, count(DISTINCT user_id) AS support, count(*) AS n FROM kmers GROUP BY 1 HAVING count(DISTINCT user_id) >= 5")
def w15_kmer_support(spark, sf_dir):
    return tokens.kmer_support(tokens.canonical_kmers(event_sequence(spark, sf_dir), "user_id", ["pos"], 3), "user_id", 5)


@query(
    f"""WITH {KMERS}, good AS (SELECT kmer FROM kmers GROUP BY 1 HAVING count(DISTINCT user_id) >= 40), h AS (SELECT user_id, pos AS s, pos + 2 AS e FROM kmers JOIN good USING (kmer)),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
    f AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS isl FROM m)
    SELECT user_id, min(s) AS start, max(e) AS "end" FROM f GROUP BY user_id, isl"""
)
def w16_conserved_runs(spark, sf_dir):
    return tokens.conserved_runs(tokens.canonical_kmers(event_sequence(spark, sf_dir), "user_id", ["pos"], 3), "user_id", 3, 40)


@query(
    f"""WITH {SEQ}, d AS (SELECT x.user_id, least(x.token, y.token) AS a, greatest(x.token, y.token) AS b, min(y.pos - x.pos) AS d FROM seq x JOIN seq y
      ON x.user_id = y.user_id AND y.pos - x.pos BETWEEN 1 AND 5 AND x.token <> y.token GROUP BY 1, 2, 3) SELECT a, b, count(*) AS n_keys, min(d) AS min_distance FROM d GROUP BY 1, 2"""
)
def w17_neighbour_pairs(spark, sf_dir):
    return tokens.neighbour_pairs(event_sequence(spark, sf_dir), "user_id", "pos", 5)


LINES = "li AS (SELECT l_orderkey AS block, CAST(l_linenumber AS BIGINT) * 7 AS q, l_partkey % 60 AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)"


def order_lines(spark, sf_dir) -> DataFrame:
    """Anchors of an order: query place from the line number (repeats moved apart), target place from the part."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block"), F.row_number().over(order).alias("i"), (F.col("l_partkey") % 60).alias("t"), (F.col("l_linenumber").cast("bigint") * 7).alias("q")
    )


@query(
    f"""WITH {LINES}, j AS (SELECT *, CASE WHEN i - lag(i) OVER w > 10 OR abs(t - lag(t) OVER w) > 10 THEN 1 ELSE 0 END AS cut FROM li WINDOW w AS (PARTITION BY block ORDER BY i, t)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY block ORDER BY i, t ROWS UNBOUNDED PRECEDING) AS sub FROM j) SELECT block, sub, count(*) AS n, min(i) AS q_start, max(i) AS q_end FROM s GROUP BY 1, 2"""
)
def w12_sub_blocks(spark, sf_dir):
    return tokens.sub_blocks(order_lines(spark, sf_dir), "block", "i", "t", 10)


@query(
    f"""WITH {LINES}, st AS (SELECT *, t - lag(t) OVER w AS dt, i - lag(i) OVER w AS dq FROM li WINDOW w AS (PARTITION BY block ORDER BY i, t)),
    a AS (SELECT block, count(*) AS n, sum(CASE WHEN dt < 0 THEN 1 ELSE 0 END) AS down, sum(CASE WHEN dt > 0 THEN 1 ELSE 0 END) AS up, max(abs(dt)) AS max_gap_t, max(dq) AS max_gap_q,
      median(t - i) AS m1, median(t + i) AS m2 FROM st GROUP BY 1),
    b AS (SELECT li.block, median(abs(t - i - m1)) AS d1, median(abs(t + i - m2)) AS d2 FROM li JOIN a ON a.block = li.block GROUP BY 1)
    SELECT a.block, n, max_gap_t, max_gap_q, least(up, down) AS violations, CAST(least(d1, d2) AS DOUBLE) AS mad, least(up, down) <= 0.1 * n AND least(d1, d2) < 3 AS coherent FROM a JOIN b ON a.block = b.block"""
)
def w13_coherence(spark, sf_dir):
    return tokens.coherence(order_lines(spark, sf_dir), "block", "i", "t")


# --- explorer


EXPLORER = """bl AS (SELECT o_orderkey AS block_id, CAST(c_nationkey AS BIGINT) AS query_genome_id, CAST((c_nationkey + o_custkey) % 25 AS BIGINT) AS target_genome_id, o_orderpriority AS query_locus,
  c_mktsegment AS target_locus, o_orderkey % 14 AS size, o_totalprice AS score, o_totalprice / 500000 AS identity, o_custkey % 40 AS cluster_id FROM orders JOIN customer ON c_custkey = o_custkey)"""


def order_blocks(spark, sf_dir) -> DataFrame:
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return met.select(
        F.col("o_orderkey").alias("block_id"), F.col("c_nationkey").cast("bigint").alias("query_genome_id"), ((F.col("c_nationkey") + F.col("o_custkey")) % 25).cast("bigint").alias("target_genome_id"),
        F.col("o_orderpriority").alias("query_locus"), F.col("c_mktsegment").alias("target_locus"), (F.col("o_orderkey") % 14).alias("size"),
        F.col("o_totalprice").alias("score"), (F.col("o_totalprice") / 500000).alias("identity"), (F.col("o_custkey") % 40).alias("cluster_id"),
    )


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("genome_id"), F.col("n_name").alias("name"))


@query(
    f"""WITH {EXPLORER}, an AS (SELECT l_orderkey AS block_id, l_returnflag AS domains FROM lineitem)
    SELECT block_id, q.n_name AS query_name, t.n_name AS target_name, size, score FROM bl LEFT JOIN nation q ON q.n_nationkey = query_genome_id LEFT JOIN nation t ON t.n_nationkey = target_genome_id
    WHERE (query_genome_id IN (1, 2, 3, 4, 5, 6) OR target_genome_id IN (1, 2, 3, 4, 5, 6)) AND size >= 4 AND size <= 10 AND identity >= 0.2 AND lower(query_locus) || ' ' || lower(target_locus) LIKE '%u%'
      AND (contains(lower(query_locus), 'u') OR contains(lower(target_locus), 'u')) AND EXISTS (SELECT 1 FROM an WHERE an.block_id = bl.block_id AND lower(domains) LIKE '%r%')
    ORDER BY score DESC, block_id LIMIT 50 OFFSET 10"""
)
def p8_explorer_page(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_returnflag").alias("domains"))
    page = explorer.block_page(
        order_blocks(spark, sf_dir), nations(spark, sf_dir), notes, in_genomes=[1, 2, 3, 4, 5, 6], min_size=4, max_size=10, min_identity=0.2,
        block_type="medium", locus_tokens=["u"], domain="R", offset=10, limit=50,
    )
    return page.select("block_id", "query_name", "target_name", "size", "score")


@query(
    f"""WITH {EXPLORER} SELECT count(*) AS n_blocks, count(DISTINCT CASE WHEN cluster_id > 0 THEN cluster_id END) AS n_clusters, (SELECT count(*) FROM nation) AS n_genomes, (SELECT count(*) FROM part) AS n_genes FROM bl"""
)
def a19_dashboard(spark, sf_dir):
    return explorer.dashboard(order_blocks(spark, sf_dir), nations(spark, sf_dir), table(spark, sf_dir, "part"), "cluster_id")


@query(f"WITH {EXPLORER} SELECT query_genome_id, {', '.join(f'count(*) FILTER (target_genome_id = {i}) AS t{i}' for i in range(25))} FROM bl GROUP BY 1")
def a19_pair_matrix(spark, sf_dir):
    rows = order_blocks(spark, sf_dir).withColumn("target", F.concat(F.lit("t"), "target_genome_id"))
    return explorer.pair_matrix(rows, "query_genome_id", "target", [f"t{i}" for i in range(25)])


@query(f"WITH {EXPLORER} SELECT CASE WHEN size <= 3 THEN 'small' WHEN size <= 10 THEN 'medium' ELSE 'large' END AS block_type, count(*) AS n, {r('avg(identity)')} AS mean_identity FROM bl GROUP BY 1")
def p10_size_buckets(spark, sf_dir):
    rows = order_blocks(spark, sf_dir).withColumn("block_type", X.size_bucket("size"))
    return rows.groupBy("block_type").agg(F.count("*").alias("n"), X.fixed(F.avg("identity")).alias("mean_identity"))


@query(
    f"""SELECT CASE WHEN l_quantity <= 10 THEN '(1, 10]' WHEN l_quantity <= 25 THEN '(10, 25]' ELSE '(25, 50]' END AS bin, count(*) AS n, {r('avg(l_extendedprice)', 2)} AS mean, {r('stddev_samp(l_extendedprice)', 2)} AS std FROM lineitem GROUP BY 1"""
)
def p13_histogram_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("bin", X.histogram_label("l_quantity", [1, 10, 25, 50]))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), X.fixed(F.avg("l_extendedprice"), 2).alias("mean"), X.fixed(F.stddev_samp("l_extendedprice"), 2).alias("std"))


@query(
    """SELECT c_nationkey, count(DISTINCT o_orderkey) AS total_genes, count(DISTINCT CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END) AS annotated_genes, count(DISTINCT CASE WHEN l_partkey IS NOT NULL THEN o_orderkey END) AS mapped_genes,
    CAST(sum(o_orderkey % 3) AS BIGINT) AS pfam_sum FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def a12_annotation_stats(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    rows = met.select("c_nationkey", F.col("o_orderkey").alias("gene_id"), (F.col("o_orderkey") % 3).alias("pfam_count"))
    return explorer.annotation_stats(rows, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gene_id"), F.col("l_partkey").alias("block_id")), "c_nationkey")


@query(
    f"""WITH {EXPLORER}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, block_id) AS k FROM bl)
    SELECT cluster_id, count(*) AS size, CAST(floor(avg(size)) AS BIGINT) AS mean_length, {r('avg(identity)')} AS mean_identity, max(CASE WHEN k = 1 THEN block_id END) AS representative FROM k GROUP BY 1"""
)
def a13_cluster_rebuild(spark, sf_dir):
    told = explorer.cluster_rebuild(order_blocks(spark, sf_dir), "cluster_id", "size", "identity", "score", "block_id")
    return told.withColumn("mean_identity", X.fixed("mean_identity"))


@query(
    f"""WITH {EXPLORER}, n AS (SELECT cluster_id, query_genome_id AS g FROM bl UNION SELECT cluster_id, target_genome_id FROM bl)
    SELECT cluster_id, string_agg(n_name, ',' ORDER BY n_name) AS organisms, count(*) AS n_organisms FROM n JOIN nation ON n_nationkey = g GROUP BY 1"""
)
def a14_organisms_per_cluster(spark, sf_dir):
    page = explorer.block_page(order_blocks(spark, sf_dir), nations(spark, sf_dir), order="id")
    return explorer.organisms(page, "cluster_id", ["query_name", "target_name"])


@query(f"WITH {EXPLORER} SELECT cluster_id, {r('avg(identity)')} AS mean, min(identity) AS min, max(identity) AS max, {r('stddev_pop(identity)')} AS std_pop, count(*) AS n FROM bl GROUP BY 1")
def a15_identity_per_cluster(spark, sf_dir):
    told = statistics.moments(order_blocks(spark, sf_dir), ["cluster_id"], "identity")
    return told.select("cluster_id", X.fixed("mean").alias("mean"), "min", "max", X.fixed("std_pop").alias("std_pop"), "n")


@query(
    f"SELECT l_returnflag, count(*) AS n, {r('avg(l_quantity)')} AS mean, {r('stddev_pop(l_quantity)')} AS std_pop, {r('stddev_samp(l_quantity)')} AS std_samp, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1"
)
def a18_block_stats(spark, sf_dir):
    return statistics.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").withColumns({c: X.fixed(c) for c in ("mean", "std_pop", "std_samp")})


@query(f"SELECT l_linestatus, {', '.join(r(f'quantile_cont(l_extendedprice, {p / 100})', 2) + f' AS p{p}' for p in (10, 25, 50, 75, 90, 99))} FROM lineitem GROUP BY 1")
def a21_quantiles(spark, sf_dir):
    told = statistics.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9, 0.99], ["l_linestatus"])
    return told.withColumns({c: X.fixed(c, 2) for c in told.columns if c != "l_linestatus"})


@query(f"SELECT {r('corr(l_quantity, l_extendedprice)', 6)} AS corr, count(*) AS n FROM lineitem")
def a21_corr(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(X.fixed(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.count("*").alias("n"))


@query(f"WITH {EXPLORER} SELECT least(CAST(query_genome_id AS VARCHAR), CAST(target_genome_id AS VARCHAR)) || '-' || greatest(CAST(query_genome_id AS VARCHAR), CAST(target_genome_id AS VARCHAR)) AS pair, count(*) AS n, sum(CASE WHEN query_genome_id = target_genome_id THEN 1 ELSE 0 END) AS n_self FROM bl GROUP BY 1")
def a22_pair_counts(spark, sf_dir):
    rows = order_blocks(spark, sf_dir).select(F.col("query_genome_id").cast("string").alias("a"), F.col("target_genome_id").cast("string").alias("b"))
    return statistics.pair_counts(rows, "a", "b")


@query("WITH c AS (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM c) SELECT x AS value FROM o WHERE i = CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT)")
def a37_nearest_rank(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("x"))
    return statistics.nearest_rank(sizes, "x", 0.9)


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)
    SELECT event_id, user_id, idx, CASE WHEN idx IN (5, 9) THEN 'boundary' WHEN idx BETWEEN 5 AND 9 THEN 'core' ELSE 'context' END AS role FROM e WHERE idx BETWEEN 2 AND 12"""
)
def w18_region_roles(spark, sf_dir):
    return explorer.region_slice(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5, 9, 3).select("event_id", "user_id", "idx", "role")


@query("SELECT o_orderkey AS block_id, o_totalprice AS score, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'macro' ELSE 'micro' END AS kind FROM orders")
def u1_union_sources(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))
    return explorer.micro_and_macro(orders.filter("block_id % 2 = 0"), orders.filter("block_id % 2 = 1").drop("status"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def k7_store_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return store.append_new(orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"), "o_orderkey")


@query(
    """WITH f AS (SELECT o_orderkey AS block_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 20 END AS c FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT o_orderkey AS block_id, o_custkey % 700 AS c FROM orders WHERE o_orderpriority <> '5-LOW'),
    big AS (SELECT c FROM s WHERE c > 0 GROUP BY 1 HAVING count(*) >= 8), fill AS (SELECT s.* FROM s JOIN big USING (c))
    SELECT coalesce(f.block_id, fill.block_id) AS block_id, CASE WHEN coalesce(f.c, 0) > 0 THEN f.c ELSE coalesce(fill.c, 0) END AS cluster_id FROM f FULL JOIN fill ON f.block_id = fill.block_id"""
)
def u5_merge_assignments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("block_id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 20 END").alias("cluster_id"))
    second = orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("block_id"), (F.col("o_custkey") % 700).alias("cluster_id"))
    return explorer.merge_assignments(first, second, 8)


@query(
    """WITH c AS (SELECT c_custkey AS cluster_id, o_orderkey AS block_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT cluster_id, block_id, score FROM c WHERE k <= 3"""
)
def t4_top_n_per_cluster(spark, sf_dir):
    rows = explorer.top_per_group(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3)
    return rows.select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("block_id"), F.col("o_totalprice").alias("score"))


@query("SELECT x.o_orderkey, x.o_custkey FROM orders x WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = x.o_orderkey AND l_returnflag = 'R')")
def j13_exists_semi_join(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return explorer.having(table(spark, sf_dir, "orders"), returned, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0) AS top_price FROM customer")
def j14_scalar_counts(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    return explorer.with_counts(customers, orders, "c_custkey", "o_custkey", n_orders=F.count("*"), top_price=F.max("o_totalprice"))


@query("SELECT r_name, n_name, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def j15_star_join(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_suppkey", "l_partkey")
    rows = explorer.star_join(lines, (t("supplier"), "l_suppkey", "s_suppkey"), (t("nation"), "s_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))


# --- evaluation


@query(
    """WITH t AS (SELECT o_custkey AS gt, o_orderkey AS item FROM orders), p AS (SELECT o_custkey * 3 + ascii(o_orderstatus) % 3 AS pred, o_orderkey AS item FROM orders),
    a AS (SELECT gt, count(*) AS na FROM t GROUP BY 1), b AS (SELECT pred, count(*) AS nb FROM p GROUP BY 1), m AS (SELECT gt, pred, count(*) AS n_shared FROM t JOIN p USING (item) GROUP BY 1, 2)
    SELECT gt, pred, n_shared, floor(n_shared / (na + nb - n_shared) * 10000 + 0.5) / 10000 AS jaccard FROM m JOIN a USING (gt) JOIN b USING (pred) WHERE n_shared / (na + nb - n_shared) >= 0.5 OR n_shared >= 3"""
)
def j31_set_matches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    truth = orders.select(F.col("o_custkey").alias("gt"), F.col("o_orderkey").alias("item"))
    parts = orders.select((F.col("o_custkey") * 3 + F.ascii("o_orderstatus") % 3).alias("pred"), F.col("o_orderkey").alias("item"))
    return evaluation.set_matches(truth, parts).withColumn("jaccard", X.fixed("jaccard"))


@query(
    f"""WITH s AS (SELECT o_totalprice AS score, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS label FROM orders), k AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1),
    c AS (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0, coalesce(sum(q) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM k)
    SELECT {r('sum(q * (p0 + p / 2)) / (sum(p) * sum(q))')} AS roc_auc, {r('sum(p * ((p0 + p) / (p0 + p + q0 + q))) / sum(p)')} AS average_precision, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM c"""
)
def a34_pair_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("label"))
    return evaluation.pair_metrics(rows).withColumns({c: X.fixed(c) for c in ("roc_auc", "average_precision")}).drop("precision_at_recall_50")


LABELLED = "s AS (SELECT o_totalprice AS score, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS label FROM orders)"


@query(
    f"""WITH {LABELLED}, k AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n FROM k)
    SELECT {r('max(tp / n)', 6)} AS precision_at_recall_50 FROM c WHERE tp >= 0.5 * (SELECT sum(label) FROM s)"""
)
def a34_precision_at_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("label"))
    return evaluation.pair_metrics(rows).select(X.fixed("precision_at_recall_50", 6).alias("precision_at_recall_50"))


_TOLD = f"count(*) AS count, {r('avg(score)', 2)} AS mean, {r('stddev_pop(score)', 2)} AS std, min(score) AS min, max(score) AS max"


@query(f"WITH {LABELLED} SELECT label > 0 AS class, {_TOLD} FROM s GROUP BY 1 UNION ALL SELECT NULL, {_TOLD} FROM s")
def a34_pair_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("label"))
    return evaluation.pair_summary(rows).withColumns({c: X.fixed(c, 2) for c in ("mean", "std")})


@query(
    f"""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c),
    i AS (SELECT sum(m * (m - 1) / 2) AS i FROM (SELECT sum(n) AS m FROM c GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2) AS j FROM (SELECT sum(n) AS m FROM c GROUP BY b))
    SELECT {r('(ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2))', 6)} AS ari FROM x CROSS JOIN i CROSS JOIN j"""
)
def a34_adjusted_rand(spark, sf_dir):
    return evaluation.adjusted_rand(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select(X.fixed("ari", 6).alias("ari"))


@query("SELECT p_type AS orthogroup, count(*) AS size, count(DISTINCT p_brand) AS genomes, count(*) = 1 AS is_singleton, count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part) AS is_core FROM part GROUP BY 1")
def a31_orthogroup_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("orthogroup"), F.col("p_brand").alias("sample_id"))
    return evaluation.orthogroup_stats(rows)


@query(
    "SELECT count(*) FILTER (k <= 1) / count(*) AS recall_1, count(*) FILTER (k <= 5) / count(*) AS recall_5, count(*) FILTER (k <= 10) / count(*) AS recall_10 FROM (SELECT min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS k FROM lineitem GROUP BY l_orderkey)"
)
def a32_recall_at_k(spark, sf_dir):
    ranks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("rank"))
    return evaluation.recall_at(ranks, [1, 5, 10])


@query(
    """WITH p AS (SELECT l_orderkey AS block_id, l_partkey AS query_gene, l_suppkey AS target_gene FROM lineitem), t AS (SELECT DISTINCT l_partkey AS query_gene, l_suppkey AS target_gene FROM lineitem WHERE l_returnflag = 'R'),
    n AS (SELECT block_id, count(*) AS n, count(t.query_gene) AS n_true FROM p LEFT JOIN t ON t.query_gene = p.query_gene AND t.target_gene = p.target_gene GROUP BY 1)
    SELECT block_id, n, n_true, CASE WHEN n_true / n >= 0.9 THEN 'true' WHEN n_true / n >= 0.5 THEN 'partial' WHEN n_true > 0 THEN 'weak' ELSE 'accidental' END AS kind FROM n"""
)
def j28_correspondence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("query_gene"), F.col("l_suppkey").alias("target_gene"), "l_returnflag")
    return evaluation.correspondence(rows.drop("l_returnflag"), rows.filter("l_returnflag = 'R'")).drop("share")


@query(f"WITH {MUTUAL}, l AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) SELECT e.u, e.v, count(c.v) AS triangles FROM edges e LEFT JOIN (SELECT a.u AS x, a.v AS z, b.v FROM l a JOIN l b ON a.v = b.u) c ON c.x = e.u AND c.v = e.v GROUP BY 1, 2")
def g16_triangle_support(spark, sf_dir):
    return graph.triangle_support(interval_edges(spark, sf_dir)).select("u", "v", "triangles")


@query(
    f"""WITH RECURSIVE {JACCARD}, peel(n, es) AS (SELECT 0, list(struct_pack(u := u, v := v)) FROM edges
      UNION ALL SELECT n, es FROM (SELECT n + 1 AS n, es AS old, list_filter(es, lambda e: len(list_filter(es, lambda f: f.u = e.u OR f.v = e.u)) >= 2 AND len(list_filter(es, lambda f: f.u = e.v OR f.v = e.v)) >= 2) AS es
        FROM peel) WHERE len(es) < len(old))
    SELECT e.u, e.v FROM (SELECT unnest(es) AS e FROM (SELECT es FROM peel ORDER BY n DESC LIMIT 1))"""
)
def g16_k_core(spark, sf_dir):
    return graph.k_core(interval_edges(spark, sf_dir), 2)


@query(
    """WITH RECURSIVE mm AS (SELECT o_orderkey AS child, o_orderkey // 16 AS parent FROM orders WHERE o_orderkey // 16 <> o_orderkey), up(child, root, depth) AS (
      SELECT child, parent, 1 FROM mm UNION ALL SELECT up.child, mm.parent, depth + 1 FROM up JOIN mm ON up.root = mm.child),
    t AS (SELECT child, max(depth) AS depth, arg_max(root, depth) AS root FROM up GROUP BY 1) SELECT t.child, mm.parent, t.root, t.depth FROM t JOIN mm ON mm.child = t.child"""
)
def g33_merge_hierarchy(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 16").alias("parent")).filter("parent <> child")
    told = clusters.merge_hierarchy(rows)
    return told.drop("parent").join(rows, "child")


# --- regions and communities


@query(
    """WITH g AS (SELECT DISTINCT p_brand AS gene_id FROM part), w AS (SELECT l_orderkey AS block_id, 'x_' || (l_linenumber % 2) || '_Brand#' || (l_partkey % 40) AS name FROM lineitem),
    t AS (SELECT block_id, name, gene_id FROM w JOIN g ON g.gene_id = string_split(name, '_')[3]) SELECT DISTINCT block_id, name, gene_id, 2 AS trim FROM t"""
)
def j10_trimmed_ids(spark, sf_dir):
    name = F.concat(F.lit("x_"), F.col("l_linenumber") % 2, F.lit("_Brand#"), F.col("l_partkey") % 40)
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), name.alias("name"))
    return regions.match_trimmed_ids(wanted, table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id")))


@query(
    f"""WITH {IV}, l AS (SELECT id, user_id, s, e FROM iv WHERE event_type = 'click'), x AS (SELECT user_id, s, e, min(id) AS o FROM iv WHERE event_type = 'view' GROUP BY 1, 2, 3),
    y AS (SELECT user_id, s, min(id) AS o FROM iv WHERE event_type = 'view' GROUP BY 1, 2) SELECT l.id, coalesce(x.o, y.o) AS other_id FROM l LEFT JOIN x USING (user_id, s, e) LEFT JOIN y USING (user_id, s)"""
)
def j25_coordinate_match(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return regions.match_coordinates(iv.filter("event_type = 'click'"), iv.filter("event_type = 'view'").withColumnRenamed("id", "other_id"), ["user_id"])


@query(
    f"""WITH {IV} SELECT a.id, b.id AS other_id FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.s < b.e AND b.s < a.e
    AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * least(a.e - a.s, b.e - b.s)"""
)
def j26_overlap_match(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return regions.match_overlap(iv.filter("event_type = 'click'"), iv.filter("event_type = 'view'").withColumnRenamed("id", "other_id"), ["user_id"], WIDTH)


@query(
    f"""WITH {RANGES}, side AS (SELECT genome_a AS g, part, a_start AS s, a_end AS e FROM pred UNION ALL SELECT genome_b, part, b_start, b_end FROM pred),
    a AS (SELECT DISTINCT gt.rid FROM gt JOIN side ON g = genome_a AND side.part = gt.part AND greatest(0, least(a_end, e) - greatest(a_start, s) + 1) / (a_end - a_start + 1) >= 0.5),
    b AS (SELECT DISTINCT gt.rid FROM gt JOIN side ON g = genome_b AND side.part = gt.part AND greatest(0, least(b_end, e) - greatest(b_start, s) + 1) / (b_end - b_start + 1) >= 0.5),
    c AS (SELECT DISTINCT gt_id AS rid FROM met WHERE fa >= 0.5 AND fb >= 0.5)
    SELECT gt.rid AS gt_id, gt.rid IN (SELECT rid FROM a) AS covered_a, gt.rid IN (SELECT rid FROM b) AS covered_b, gt.rid IN (SELECT rid FROM c) AS strict FROM gt"""
)
def j21_side_coverage(spark, sf_dir):
    every = user_ranges(spark, sf_dir).withColumn("contig_a", F.col("part")).withColumn("contig_b", F.col("part"))
    truth = every.filter("event_type = 'purchase'").withColumnRenamed("rid", "gt_id")
    return regions.coverage_of_sides(truth, every.filter("event_type IN ('view', 'error')"))


@query(
    """WITH o AS (SELECT s_suppkey AS operon_id, s_nationkey % 5 AS genus FROM supplier), g AS (SELECT n_nationkey AS genome, n_regionkey AS genus FROM nation),
    h AS (SELECT DISTINCT l_suppkey AS operon_id, c_nationkey AS genome FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R'),
    t AS (SELECT o.operon_id, count(*) AS n_genomes, count(h.genome) AS n_reached FROM o JOIN g ON g.genus <> o.genus LEFT JOIN h ON h.operon_id = o.operon_id AND h.genome = g.genome GROUP BY 1)
    SELECT operon_id, n_genomes, n_reached, floor(n_reached / n_genomes * 10000 + 0.5) / 10000 AS share FROM t"""
)
def j27_cross_genus_coverage(spark, sf_dir):
    operons = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("operon_id"), (F.col("s_nationkey") % 5).alias("genus"))
    genomes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("genome"), F.col("n_regionkey").alias("genus"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    hits = lines.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("l_suppkey").alias("operon_id"), F.col("c_nationkey").alias("genome"))
    return regions.cross_genus_coverage(operons, genomes, hits).withColumn("share", X.fixed("share"))


@query(
    f"""WITH {IV}, p AS (SELECT user_id, event_type, s, e, e - s + 1 AS n, CASE WHEN id % 7 = 0 THEN -1 ELSE 1 END AS o FROM iv WHERE event_type IN ('view', 'click')),
    g AS (SELECT *, s - lag(e) OVER (PARTITION BY user_id ORDER BY s, e) - 1 AS gap FROM p), t AS (SELECT user_id, count(*) AS n_parts, count(DISTINCT o) AS turns, max(gap) AS max_gap, avg(n) AS m FROM g GROUP BY 1)
    SELECT user_id, n_parts, CASE WHEN turns > 1 THEN 'inversion' WHEN max_gap > 10 THEN 'insertion' WHEN m < 2 THEN 'over_fragmentation' ELSE 'moderate_gap' END AS kind FROM t"""
)
def w14_fragmentation_types(spark, sf_dir):
    iv = event_intervals(spark, sf_dir).filter("event_type IN ('view', 'click')")
    parts = iv.select("user_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), (F.col("end") - F.col("start") + 1).alias("n"), F.when(F.col("id") % 7 == 0, -1).otherwise(1).alias("orientation"))
    return regions.fragmentation_types(parts, "user_id").drop("max_gap")


@query(
    f"""WITH {IV}, m AS (SELECT *, max(s) OVER (PARTITION BY user_id ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    f AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 7 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS isl FROM m),
    runs AS (SELECT user_id, min(s) AS start, max(s) AS "end", count(DISTINCT event_type) AS n_names FROM f GROUP BY user_id, isl),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_names DESC, start) AS k FROM runs) SELECT user_id, start, "end", n_names FROM k WHERE k = 1"""
)
def w21_best_runs(spark, sf_dir):
    return regions.best_runs(event_intervals(spark, sf_dir), ["user_id"], "start", "event_type", 6)


@query(
    """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey * 10000 + l_suppkey AS item FROM lineitem), m AS (SELECT item, min(set_id) AS v FROM s GROUP BY 1),
    e AS (SELECT DISTINCT set_id AS u, v FROM s JOIN m USING (item) WHERE set_id <> v), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    r(node, root) AS (SELECT DISTINCT set_id, set_id FROM s UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v) SELECT node AS set_id, min(root) AS root FROM r GROUP BY 1"""
)
def g31_sets_joined(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("item"))
    return regions.sets_joined(rows)


@query(
    f"""WITH RECURSIVE {SEQ}, o AS (SELECT user_id, user_id % 6 AS species, token || ':' || v || ':' || (user_id % 4) AS og, pos FROM seq),
    pairs AS (SELECT *, lead(og) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM o),
    kept AS (SELECT og AS a, nxt AS b FROM pairs WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT species) >= 3), links AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept),
    reach(node, root) AS (SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
    cover AS (SELECT a AS og, species FROM pairs JOIN kept ON og = a AND nxt = b UNION SELECT b, species FROM pairs JOIN kept ON og = a AND nxt = b)
    SELECT root, count(DISTINCT og) AS size, count(DISTINCT species) AS n_species, string_agg(DISTINCT og, ',' ORDER BY og) AS orthogroups FROM comp JOIN cover ON og = node GROUP BY 1"""
)
def g32_orthogroup_blocks(spark, sf_dir):
    og = F.concat_ws(":", "token", "v", F.col("user_id") % 4)
    seq = event_sequence(spark, sf_dir).withColumn("og", og)
    w = Window.partitionBy("user_id").orderBy("pos")
    pairs = seq.select(F.col("og").alias("a"), F.lead("og").over(w).alias("b"), F.col("user_id").alias("genome")).filter("b IS NOT NULL")
    species = seq.select(F.col("user_id").alias("genome"), (F.col("user_id") % 6).alias("species")).distinct()
    return regions.orthogroup_blocks(pairs, species, 3).withColumn("orthogroups", F.array_join("orthogroups", ","))


@query(
    f"""WITH RECURSIVE {TOK}, df AS (SELECT token, count(*) AS df FROM tok GROUP BY 1), o AS (SELECT df, row_number() OVER (ORDER BY df) - 1 AS i, count(*) OVER () AS n FROM df),
    c AS (SELECT df AS cutoff FROM o WHERE i = CAST(floor(0.99 * (n - 1)) AS BIGINT)), kept AS (SELECT doc, token FROM tok JOIN df USING (token), c WHERE NOT (df >= cutoff AND df > 1)),
    n AS (SELECT count(DISTINCT doc) AS n FROM kept), df2 AS (SELECT token, count(*) AS df FROM kept GROUP BY 1), w AS (SELECT doc, token, ln(1 + n / df) AS idf, df FROM kept JOIN df2 USING (token), n),
    t AS (SELECT doc, sum(idf) AS total FROM w GROUP BY 1), s AS (SELECT a.doc AS a, b.doc AS b, sum(a.idf) AS shared FROM w a JOIN w b ON a.token = b.token AND a.doc < b.doc GROUP BY 1, 2),
    edges AS (SELECT * FROM (SELECT a AS u, b AS v, round(shared / (x.total + y.total - shared), 9) AS w FROM s JOIN t x ON x.doc = a JOIN t y ON y.doc = b) WHERE w >= 0.3),
    two AS (SELECT u, v, w FROM edges UNION ALL SELECT v, u, w FROM edges), near AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS k FROM two),
    mutual AS (SELECT a.u, a.v FROM near a JOIN near b ON a.u = b.v AND a.v = b.u WHERE a.k <= 5 AND b.k <= 5 AND a.u < a.v),
    {components_sql("SELECT DISTINCT u AS id FROM (SELECT u FROM mutual UNION SELECT v FROM mutual)", "mutual", "d")},
    sizes AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, min(node)) AS cluster_id FROM dcomp GROUP BY 1)
    SELECT doc, coalesce(cluster_id, 0) AS cluster_id FROM (SELECT DISTINCT doc FROM tok) LEFT JOIN dcomp ON node = doc LEFT JOIN sizes USING (root)"""
)
def g14_token_clusters(spark, sf_dir):
    words = F.array_distinct(F.split("text", r"[ \t\n\x0B\f\r]+"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("doc"), words.alias("tokens"))
    return communities.token_clusters(rows, tau=0.3, k=5, ban=0.99)


@query(
    f"""WITH k AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a CROSS JOIN embeddings b),
    n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM k), x AS (SELECT least(i, j) AS u, greatest(i, j) AS v, sim FROM n WHERE r <= 11 AND i <> j)
    SELECT u, v, {r('max(sim)')} AS w FROM x GROUP BY 1, 2 HAVING count(*) = 2"""
)
def g22_reciprocal_graph(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return communities.reciprocal_graph(nearest.nearest_exact(v, v, 11), 10).withColumn("w", X.fixed("w"))


def _values(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("emb").alias("i", "x")).withColumn("x", X.fixed("x", 3))


@query()
def g26_all_but_the_top(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    return _values(shingles.drop_top_components(v, 3))


@query(
    f"""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS dev FROM x GROUP BY 1),
    z AS (SELECT vec_id, i, (x - mean) / dev AS z FROM x JOIN m USING (i)), n AS (SELECT vec_id, sqrt(sum(z * z)) AS n FROM z GROUP BY 1) SELECT vec_id, i, {r('z / n', 3)} AS x FROM z JOIN n USING (vec_id)"""
)
def g26_standardised(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    return _values(shingles.standardised(v))


TRACKS = f"""{GENES}, nxt AS (SELECT sample_id, lead(sample_id) OVER (ORDER BY sample_id) AS below FROM (SELECT DISTINCT sample_id FROM genes)),
    met AS (SELECT a.contig_id || ':' || a.sample_id AS view, a.gene_id AS a, b.gene_id AS b, a.position_index AS i, b.position_index AS j, list_cosine_similarity(a.emb, b.emb) AS sim, a.start % 7000 = b.start % 7000 AS same
      FROM genes a JOIN nxt USING (sample_id) JOIN genes b ON b.sample_id = below AND b.contig_id = a.contig_id)"""


@query(
    f"""WITH RECURSIVE {TRACKS}, c AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY abs(i - j), a, b) AS k FROM met WHERE same),
    pick(view, k, a, b, ok, ta, tb) AS (SELECT view, k, a, b, true, [a], [b] FROM c WHERE k = 1
      UNION ALL SELECT view, k, a, b, ok, CASE WHEN ok THEN list_append(ta, a) ELSE ta END, CASE WHEN ok THEN list_append(tb, b) ELSE tb END FROM (
        SELECT c.view, c.k, c.a, c.b, ta, tb, NOT (list_contains(ta, c.a) OR list_contains(tb, c.b)) AS ok FROM pick JOIN c ON c.view = pick.view AND c.k = pick.k + 1)),
    pf AS (SELECT view, a, b FROM pick WHERE ok), co AS (SELECT view, a, b FROM met WHERE sim >= 0.3),
    both_ AS (SELECT coalesce(co.view, pf.view) AS view, coalesce(co.a, pf.a) AS a, coalesce(co.b, pf.b) AS b, CASE WHEN co.a IS NULL THEN 'pfam' WHEN pf.a IS NULL THEN 'cos' ELSE 'both' END AS kind
      FROM co FULL JOIN pf ON co.view = pf.view AND co.a = pf.a AND co.b = pf.b)
    SELECT * FROM both_ UNION ALL SELECT view, a, b, 'fallback' FROM met WHERE i = j AND view NOT IN (SELECT view FROM both_)"""
)
def g27_comparative_edges(spark, sf_dir):
    """Each genome's contigs beside those of the next genome."""
    v = genes_view(spark, sf_dir).withColumn("domains", F.array((F.col("start") % 7000).cast("string")))
    tracks = v.select("sample_id").distinct().withColumn("below", F.lead("sample_id").over(Window.orderBy("sample_id")))  # one row for each genome
    rows = v.select("contig_id", "sample_id", F.col("gene_id").alias("id"), F.col("position_index").alias("idx"), "emb", "domains")
    upper = rows.join(tracks.filter("below IS NOT NULL"), "sample_id").withColumn("view", F.concat_ws(":", "contig_id", "sample_id"))
    under = tracks.filter("below IS NOT NULL").select(F.col("sample_id").alias("above"), F.col("below").alias("sample_id"))
    lower = rows.join(under, "sample_id").withColumn("view", F.concat_ws(":", "contig_id", "above"))
    return regions.comparative_edges(upper, lower, 0.3)


@query(
    f"""WITH {SEQ}, x AS (SELECT user_id, CASE WHEN pos % 2 = 0 THEN 'query' ELSE 'target' END AS role, token || ':' || v AS token, strand, pos FROM seq),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, role ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY user_id, role) AS n FROM x),
    f AS (SELECT user_id, role, token, arg_min(CASE WHEN n > 1 THEN i / (n - 1) ELSE 0.0 END, i) AS p, arg_min(strand, i) AS s FROM p GROUP BY 1, 2, 3)
    SELECT q.user_id, q.token, {r('q.p')} AS query_pos, {r('t.p')} AS target_pos, q.s = t.s AS same_strand FROM f q JOIN f t ON q.user_id = t.user_id AND q.token = t.token AND q.role = 'query' AND t.role = 'target'"""
)
def a28_block_consensus(spark, sf_dir):
    seq = event_sequence(spark, sf_dir).withColumn("token", F.concat_ws(":", "token", "v")).withColumn("role", F.when(F.col("pos") % 2 == 0, "query").otherwise("target"))
    told = tokens.block_consensus(seq, "user_id", "role", "pos", "strand")
    return told.withColumns({c: X.fixed(c) for c in ("query_pos", "target_pos")})


@query(
    f"""WITH {EXPLORER}, g AS (SELECT l_orderkey AS block_id, l_partkey AS gene_id FROM lineitem) SELECT cluster_id, count(DISTINCT query_locus) + count(DISTINCT target_locus) AS n_contigs,
    count(DISTINCT gene_id) AS n_genes, count(DISTINCT p_type) AS n_domain_lists FROM bl JOIN g USING (block_id) JOIN part ON p_partkey = gene_id GROUP BY 1"""
)
def a17_cluster_extent(spark, sf_dir):
    rows = order_blocks(spark, sf_dir).withColumnsRenamed({"query_locus": "query_contig", "target_locus": "target_contig"})
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("gene_id"))
    used = rows.join(lines, "block_id", "left_semi")
    return explorer.cluster_extent(used, lines, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("pfam_domains")))


@query(
    """WITH c AS (SELECT o_orderkey AS block_id, o_custkey % 30 AS cluster_id FROM orders), k AS (SELECT l_orderkey AS block_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 16 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2)
    SELECT cluster_id, count(*) AS size, count(k.block_id) AS curated, floor(count(k.block_id) / count(*) * 10000 + 0.5) / 10000 AS purity, count(*) > 500 AS over_cap FROM c LEFT JOIN k ON k.block_id = c.block_id GROUP BY 1"""
)
def a36_marker_purity(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("gene_id"))
    markers = table(spark, sf_dir, "part").filter("p_size <= 16").select(F.col("p_partkey").alias("gene_id"), F.col("p_partkey").alias("marker"))
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_id"), (F.col("o_custkey") % 30).alias("cluster_id"))
    return evaluation.marker_purity(members, named, markers, 2, 500).withColumn("purity", X.fixed("purity"))
