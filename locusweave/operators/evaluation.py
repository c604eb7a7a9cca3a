"""Evaluation: recall, retrieval and pair metrics, orthogroup statistics, set matching."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.numbering import running_totals
from locusweave.operators.statistics import sample_rows

def ann_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: hits, truth size and recall of found(i, j) against truth(i, j)."""
    hits = truth.select("i", "j").join(found.select("i", "j").distinct(), ["i", "j"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(truth.agg(F.count("*").alias("total"))).withColumn("recall", F.col("hits") / F.col("total"))


def recall_at(first_ranks: DataFrame, ks: list[int]) -> DataFrame:
    """first_ranks(query, target, rank or null) -> recall at each k over all rows."""
    n = F.count("*")
    return first_ranks.agg(*[(F.count_if(F.col("rank") <= k) / n).alias(f"recall_{k}") for k in ks])


def pair_summary(scored: DataFrame, score: str = "score", label: str | None = "label") -> DataFrame:
    """count, mean, std, min and max of the scores; with a label a row for each class (positive or not), and one for all of them (class null)."""
    told = [F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max")]
    whole = scored.agg(*told)
    if label is None:
        return whole
    return scored.groupBy((F.col(label) > 0).alias("class")).agg(*told).unionByName(whole.withColumn("class", F.lit(None).cast("boolean")))


def pair_metrics(scored: DataFrame, score: str = "score", label: str = "label", recall: float = 0.5) -> DataFrame:
    """ROC AUC (rank statistic with mean ranks of ties), average precision and the best precision at a recall of that or more; null where
    a class is empty.  Running counts over the distinct scores come from range partitions and their totals, not from one window."""
    by = scored.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    run = running_totals(by, [-F.col("_s")], {"p0": "p", "q0": "q"})
    upto = F.col("p0") + F.col("p")
    precision = upto / (upto + F.col("q0") + F.col("q"))
    whole = by.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    told = run.crossJoin(F.broadcast(whole)).agg(
        F.sum(F.col("q") * (F.col("p0") + F.col("p") / 2)).alias("won"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.sum(F.col("p") * precision).alias("ap"), F.max(F.when(upto >= recall * F.col("n_pos"), precision)).alias("at"),
    )
    some = lambda c: F.when(F.col("n_pos") > 0, c)
    return told.select(
        some(F.when(F.col("n_neg") > 0, F.col("won") / (F.col("n_pos") * F.col("n_neg")))).alias("roc_auc"), some(F.col("ap") / F.col("n_pos")).alias("average_precision"),
        "n_pos", "n_neg", some(F.col("at")).alias(f"precision_at_recall_{round(100 * recall)}"),
    )


def sampled_rand(labels: DataFrame, key: str, a: str, b: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """Adjusted Rand index of the pairs among at most n rows, chosen by a hash of their key (the sampling is the operator)."""
    return adjusted_rand(sample_rows(labels, key, n, seed), a, b)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency table (partial sums, no pairs)."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(two("n").alias("ij"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("i"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("j"))
    one = both.crossJoin(rows).crossJoin(cols)  # three single rows
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("i") + F.col("j")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected)).alias("ari"))


def orthogroup_stats(genes: DataFrame, og: str = "orthogroup", genome: str = "sample_id") -> DataFrame:
    """Per orthogroup: size, genomes, singleton, core (in all genomes)."""
    n = genes.agg(F.countDistinct(genome).alias("n_genomes"))
    told = genes.groupBy(og).agg(F.count("*").alias("size"), F.countDistinct(genome).alias("genomes"))
    return told.crossJoin(F.broadcast(n)).withColumn("is_singleton", F.col("size") == 1).withColumn("is_core", F.col("genomes") == F.col("n_genomes")).drop("n_genomes")


def set_matches(truth: DataFrame, predicted: DataFrame, jaccard: float = 0.5, shared: int = 3) -> DataFrame:
    """(gt, pred, n_shared, jaccard) of set pairs that match: sets are rows (gt|pred, item); pairs come
    from the inverted index, so sets without a common item never meet."""
    a, b = truth.select("gt", "item").distinct(), predicted.select("pred", "item").distinct()
    na, nb = a.groupBy("gt").agg(F.count("*").alias("na")), b.groupBy("pred").agg(F.count("*").alias("nb"))
    met = a.join(b, "item").groupBy("gt", "pred").agg(F.count("*").alias("n_shared")).join(na, "gt").join(nb, "pred")
    j = F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared"))
    return met.withColumn("jaccard", j).filter((F.col("jaccard") >= jaccard) | (F.col("n_shared") >= shared)).select("gt", "pred", "n_shared", "jaccard")


def match_rates(matches: DataFrame, n_truth: int, n_predicted: int) -> DataFrame:
    """Recall, precision, fragmentation (truth sets over several predictions) and merge rates."""
    per_gt = matches.groupBy("gt").count().agg(F.count("*").alias("found"), F.count_if(F.col("count") > 1).alias("fragmented"))
    per_pred = matches.groupBy("pred").count().agg(F.count("*").alias("right"), F.count_if(F.col("count") > 1).alias("merged"))
    one = per_gt.crossJoin(per_pred)
    return one.select((F.col("found") / n_truth).alias("recall"), (F.col("right") / n_predicted).alias("precision"), (F.col("fragmented") / F.col("found")).alias("fragmentation_rate"), (F.col("merged") / F.col("right")).alias("merge_rate"))


def best_cluster(scores: DataFrame) -> DataFrame:
    """Per gt the cluster of greatest 0.7 * j_og + 0.3 * j_genome (first by cluster id on ties)."""
    s = 0.7 * F.col("j_og") + 0.3 * F.col("j_genome")
    order = Window.partitionBy("gt").orderBy(F.col("score").desc(), "cluster")
    return scores.withColumn("score", s).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def correspondence(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per block the share of its gene pairs that are true pairs, and its class."""
    known = truth.select("query_gene", "target_gene").distinct().withColumn("_t", F.lit(1))
    told = pairs.join(known, ["query_gene", "target_gene"], "left").groupBy("block_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("_t"), F.lit(0)).alias("n_true"))
    share = F.col("n_true") / F.col("n")
    return told.withColumn("share", share).withColumn("kind", F.when(share >= 0.9, "true").when(share >= 0.5, "partial").when(share > 0, "weak").otherwise("accidental"))


def region_sharing(members: DataFrame, og: DataFrame) -> DataFrame:
    """members(block_id, role, gene_id) -> per block the share of genes on each side whose orthogroup
    is on the other side too, and the smaller of the two."""
    named = members.join(og.select("gene_id", "orthogroup"), "gene_id", "left")
    sides = named.filter("orthogroup IS NOT NULL").select("block_id", "role", "orthogroup").distinct()
    both = sides.groupBy("block_id", "orthogroup").agg(F.count("*").alias("n")).filter("n = 2").select("block_id", "orthogroup", F.lit(1).alias("_both"))
    told = named.join(both, ["block_id", "orthogroup"], "left").groupBy("block_id", "role").agg((F.coalesce(F.sum("_both"), F.lit(0)) / F.count("*")).alias("share"))
    return told.groupBy("block_id").agg(F.max(F.when(F.col("role") == "query", F.col("share"))).alias("query_share"), F.max(F.when(F.col("role") == "target", F.col("share"))).alias("target_share"), F.min("share").alias("min_share"))


def positional_match(blocks: DataFrame) -> DataFrame:
    """blocks(block_id, orientation, query_og, target_og arrays): share of equal entries at equal places, the target
    reversed for orientation -1."""
    turned = F.when(F.col("orientation") < 0, F.reverse("target_og")).otherwise(F.col("target_og"))
    same = F.aggregate(F.zip_with("query_og", turned, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    n = F.least(F.size("query_og"), F.size("target_og"))
    return blocks.select("block_id", n.alias("n_pairs"), F.when(n > 0, same / n).otherwise(0.0).alias("match_rate"))


def marker_status(members: DataFrame, markers: list[str], least: int) -> DataFrame:
    """members(block_id, role, pfam_domains) -> canonical (both/one/none) by the distinct markers that occur
    in each side's domain lists."""
    hit = F.array(*[F.when(F.lower("pfam_domains").contains(m.lower()), F.lit(m)) for m in markers])
    found = members.select("block_id", "role", F.explode(F.array_compact(hit)).alias("m")).groupBy("block_id", "role").agg(F.countDistinct("m").alias("n"))
    good = found.filter(F.col("n") >= least).groupBy("block_id").agg(F.countDistinct("role").alias("sides"))
    every = members.select("block_id").distinct().join(good, "block_id", "left")
    sides = F.coalesce("sides", F.lit(0))
    return every.select("block_id", F.when(sides == 2, "both").when(sides == 1, "one").otherwise("none").alias("status"))


def _expected_mutual(p: int, q: int, total: int) -> float:
    """Expected part of the mutual information of one class of p and one of q rows under random labels."""
    n = np.arange(max(1, p + q - total), min(p, q) + 1)
    lg = lambda x: np.array([math.lgamma(v + 1) for v in np.atleast_1d(x).tolist()])
    fixed = lg(p) + lg(q) + lg(total - p) + lg(total - q) - lg(total)
    chance = np.exp(fixed - lg(n) - lg(p - n) - lg(q - n) - lg(total - p - q + n))
    return float((n / total * np.log(n * total / (p * q)) * chance).sum())


def adjusted_mutual_information(labels: DataFrame, a: str, b: str) -> float:
    """AMI from the contingency table.  Only the numbers of classes of each size come to the driver, at most sqrt(2 rows) a side."""
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    sizes = {c: labels.groupBy(c).agg(F.count("*").alias("size")) for c in (a, b)}
    total = labels.count()
    if not total:
        return 1.0
    ra, rb = sizes[a].withColumnRenamed("size", "p"), sizes[b].withColumnRenamed("size", "q")
    met = cells.join(ra, cells[a].eqNullSafe(ra[a])).drop(ra[a]).join(rb, cells[b].eqNullSafe(rb[b]))
    mutual = met.agg(F.sum(F.col("n") / total * F.log(F.col("n") * F.lit(float(total)) / (F.col("p") * F.col("q"))))).first()[0]
    hist = {c: {r[0]: r[1] for r in sizes[c].groupBy("size").count().collect()} for c in (a, b)}
    entropy = lambda c: -sum(k * n / total * math.log(n / total) for n, k in hist[c].items())
    expected = sum(i * j * _expected_mutual(p, q, total) for p, i in hist[a].items() for q, j in hist[b].items())
    top = (entropy(a) + entropy(b)) / 2
    return 1.0 if abs(top - expected) < 1e-15 else (mutual - expected) / (top - expected)


def pair_count_check(blocks: DataFrame, expected: dict[str, int], tolerance: float = 0.0) -> DataFrame:
    """blocks(species_pair) against expected counts: pair, n, expected, ok."""
    spark = blocks.sparkSession
    want = spark.createDataFrame(sorted(expected.items()), "species_pair string, expected long")
    got = blocks.groupBy("species_pair").agg(F.count("*").alias("n"))
    met = want.join(got, "species_pair", "full").na.fill(0)
    return met.withColumn("ok", F.abs(F.col("n") - F.col("expected")) <= tolerance * F.col("expected"))


def marker_purity(members: DataFrame, clusters: DataFrame, markers: DataFrame, least: int = 8, cap: int = 10_000) -> DataFrame:
    """Per cluster: blocks with at least `least` distinct markers as a share of its blocks; clusters over cap are flagged."""
    met = members.select("block_id", "gene_id").join(markers.select("gene_id", "marker"), "gene_id")
    good = met.groupBy("block_id").agg(F.countDistinct("marker").alias("m")).filter(F.col("m") >= least).select("block_id", F.lit(1).alias("_g"))
    told = clusters.join(good, "block_id", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.coalesce(F.sum("_g"), F.lit(0)).alias("curated"))
    return told.withColumn("purity", F.col("curated") / F.col("size")).withColumn("over_cap", F.col("size") > cap)


def cluster_coverage(members: DataFrame, required: list[str], ribosomal: str = "ribosomal") -> DataFrame:
    """Per cluster: share of required genomes, share of ribosomal genes; the best cluster is the first by
    (coverage, ribosomal share, size, -id)."""
    told = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"), (F.countDistinct(F.when(F.col("genome").isin(required), F.col("genome"))) / len(required)).alias("coverage"),
        F.avg(F.coalesce(F.lower("annotation").contains(ribosomal), F.lit(False)).cast("int")).alias("ribosomal_share"),
    )
    best = told.agg(F.max_by("cluster_id", F.struct("coverage", "ribosomal_share", "size", -F.col("cluster_id"))).alias("_best"))
    return told.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("cluster_id") == F.col("_best")).drop("_best")


def search_recall(found: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """found(query, rank, genome), truth(query, genome): share of true (query, genome) within the first k blocks."""
    first = found.groupBy("query", "genome").agg(F.min("rank").alias("rank"))
    return recall_at(truth.select("query", "genome").distinct().join(first, ["query", "genome"], "left"), ks)
