"""Closed integer intervals: overlap joins over position bins, islands, containment, recall.

A range predicate alone would make Spark compare all rows of a key.  Bins come in levels, each eight times as wide as the one before; an
interval lives in the level whose bins are as long as it is or longer, so it touches two of them at most, however long it is.  Two intervals
meet in the level of the longer one: each also looks into the wider levels that the other side lives in (one or two rows a level).  A pair
is kept in the bin where the later of the two starts, so no duplicate arises and no distinct is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.expr import overlap, overlap_fraction
from locusweave.operators.graph import written

WIDTH = 16  # bins of the lowest level, where a caller names none
STEP = 8  # times that a level's bins are as wide as the last one's


def _level(start: str, end: str, width: int) -> Column:
    length = (F.col(end) - F.col(start) + 1) / width
    return F.greatest(F.lit(0), F.ceil(F.log(length) / math.log(STEP) - 1e-9).cast("int"))


def _placed(rows: DataFrame, start: str, end: str, width: int, looks: Column) -> DataFrame:
    """rows with _bin for each (m, side) of looks: the bins of level m that the interval touches."""
    wide = F.lit(width) * F.pow(F.lit(STEP), F.col("_at.m")).cast("bigint")
    seen = rows.withColumn("_at", F.explode(looks)).select("*", "_at.m", "_at.side").withColumn("_wide", wide).drop("_at")
    return seen.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("_wide")), F.floor(F.col(end) / F.col("_wide")))))


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs of left(key, l_start, l_end, ...) and right(key, r_start, r_end, ...) that overlap; width: bins of the lowest level."""
    a, b = left.withColumn("_own", _level("l_start", "l_end", width)), right.withColumn("_own", _level("r_start", "r_end", width))
    levels = lambda rows: F.broadcast(rows.agg(F.collect_set("_own").alias("_other")))  # noqa: E731  a row of a dozen numbers
    at = lambda m, side: F.struct(m.alias("m"), F.lit(side).alias("side"))
    wider = F.transform(F.filter("_other", lambda x: x > F.col("_own")), lambda x: at(x, 1))
    as_wide = F.transform(F.filter("_other", lambda x: x >= F.col("_own")), lambda x: at(x, 0))
    # side 0: left in its own level, right in all that left lives in; side 1: right in its own level, shorter ones of left there
    a = _placed(a.crossJoin(levels(b)), "l_start", "l_end", width, F.concat(F.array(at(F.col("_own"), 0)), wider)).drop("_own", "_other", "_wide")
    own = F.when(F.exists("_other", lambda x: x < F.col("_own")), F.array(at(F.col("_own"), 1))).otherwise(F.array().cast("array<struct<m:int,side:int>>"))
    b = _placed(b.crossJoin(levels(left.withColumn("_own", _level("l_start", "l_end", width)))), "r_start", "r_end", width, F.concat(as_wide, own)).drop("_own", "_other")
    meets = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) & (F.col("_bin") == F.floor(F.greatest("l_start", "r_start") / F.col("_wide")))
    return a.join(b, [*key, "m", "side", "_bin"]).filter(meets).drop("m", "side", "_bin", "_wide")


def _by_side(truth: DataFrame, blocks: DataFrame, side: str, width: int) -> DataFrame:
    """Rows of truth (all columns) and blocks (columns p_...) of one genome pair whose intervals of a side overlap."""
    pair = ["genome_a", "genome_b"]
    left = truth.withColumns({"l_start": F.col(f"{side}_start"), "l_end": F.col(f"{side}_end")})
    right = blocks.withColumnsRenamed({c: f"p_{c}" for c in blocks.columns if c not in pair})
    right = right.withColumns({"r_start": F.col(f"p_{side}_start"), "r_end": F.col(f"p_{side}_end")})
    return overlap_join(left, right, pair, width).drop("l_start", "l_end", "r_start", "r_end")


def overlap_pairs(sides: DataFrame, key: list[str], width: int, id_col: str = "id") -> DataFrame:
    """Distinct id pairs (u < v) of which some interval of sides(id, key, start, end) overlaps."""
    left = sides.select(F.col(id_col).alias("a"), *key, F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = sides.select(F.col(id_col).alias("b"), *key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return overlap_join(left, right, key, width).filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def block_sides(blocks: DataFrame) -> DataFrame:
    """Both half-edges of each block: block_id, role, genome, contig, start, end (positions)."""
    one = lambda r: F.struct(
        F.lit(r).alias("role"), F.col(f"{r}_genome").alias("genome"), F.col(f"{r}_contig").alias("contig"),
        F.col(f"{r}_start").alias("start"), F.col(f"{r}_end").alias("end"),
    )
    return blocks.select("block_id", F.explode(F.array(one("query"), one("target"))).alias("s")).select("block_id", "s.*")


def jaccard_edges(sides: DataFrame, key: list[str], tau: float, width: int) -> DataFrame:
    """(u < v, w): interval Jaccard of two ids over all their side combinations, at least tau."""
    length = sides.groupBy("id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    left = sides.select(F.col("id").alias("u"), *key, F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = sides.select(F.col("id").alias("v"), *key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = overlap_join(left, right, key, width).filter("u < v")
    shared = met.groupBy("u", "v").agg(F.sum(overlap("l_start", "l_end", "r_start", "r_end")).alias("shared"))
    a, b = length.withColumnsRenamed({"id": "u", "n": "nu"}), length.withColumnsRenamed({"id": "v", "n": "nv"})
    w = F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))
    return shared.join(a, "u").join(b, "v").withColumn("w", w).filter(F.col("w") >= tau).select("u", "v", "w")


def merge_islands(rows: DataFrame, key: list[str], gap: int = 1, aggregates: list[Column] = ()) -> DataFrame:
    """Islands of intervals (start, end) per key: an interval joins while start <= running end + gap."""
    order = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("_new", (reach.isNull() | (F.col("start") > reach + gap)).cast("int")).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggregates).drop("_island")


def island_support(islands: DataFrame, sides: DataFrame, key: list[str], width: int) -> DataFrame:
    """islands with support: the number of sides that overlap each."""
    left = islands.select(*key, F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = sides.select(*key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    counts = overlap_join(left, right, key, width).groupBy(*key, "l_start", "l_end").agg(F.count("*").alias("support"))
    return counts.withColumnsRenamed({"l_start": "start", "l_end": "end"})


def gene_block_mapping(genes: DataFrame, sides: DataFrame, key: list[str], width: int, single: float = 0.0) -> DataFrame:
    """(gene_id, block_id, role, relative_position): genes(gene_id, key, start, end) inside block
    sides(block_id, role, key, start, end); a gene of both sides keeps the query role."""
    left = genes.select("gene_id", *key, F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = sides.select("block_id", "role", *key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = overlap_join(left, right, key, width)
    one = met.groupBy("gene_id", "block_id").agg(F.min("role").alias("role"), F.min("l_start").alias("l_start"))
    order = Window.partitionBy("block_id", "role").orderBy("l_start", "gene_id")
    n = F.count("*").over(Window.partitionBy("block_id", "role"))
    place = F.when(n > 1, (F.row_number().over(order) - 1) / (n - 1)).otherwise(F.lit(single))
    return one.withColumn("relative_position", place).drop("l_start")


def between_join(points: DataFrame, ranges: DataFrame, key: list[str], width: int) -> DataFrame:
    """points(key, pos) inside ranges(key, start_index, end_index)."""
    left = points.withColumnsRenamed({"pos": "l_start"}).withColumn("l_end", F.col("l_start"))
    right = ranges.withColumnsRenamed({"start_index": "r_start", "end_index": "r_end"})
    met = overlap_join(left, right, key, width)
    return met.withColumnsRenamed({"l_start": "pos", "r_start": "start_index", "r_end": "end_index"}).drop("l_end")


RANGE = ["genome_a", "genome_b", "a_start", "a_end", "b_start", "b_end"]


def both_directions(ranges: DataFrame, *more: str) -> DataFrame:
    """Ranges of genome pairs, once as given and once with the sides exchanged."""
    back = ranges.select(
        F.col("genome_b").alias("genome_a"), F.col("genome_a").alias("genome_b"), F.col("b_start").alias("a_start"), F.col("b_end").alias("a_end"),
        F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"), *more,
    )
    return ranges.select(*RANGE, *more).unionByName(back)


def _share(side: str) -> Column:
    return overlap_fraction(f"{side}_start", f"{side}_end", f"p_{side}_start", f"p_{side}_end")


def range_recall(truth: DataFrame, blocks: DataFrame, share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """Per row of truth(gt_id, RANGE): strict (one block covers both sides), independent (each side by
    some block) and any (one side), with the best shares of each side; contigs are not looked at.  share is above 0."""
    truth, found = written(truth.select("gt_id", *RANGE)), both_directions(written(blocks.select(*RANGE)))  # read for the levels and the pairs of both sides
    none, zero = F.lit(0.0), F.lit(0)
    told = truth.select("gt_id", none.alias("a"), none.alias("b"), zero.alias("strict"))
    for side in ("a", "b"):
        met = _by_side(truth, found, side, width)
        both = ((_share("a") >= share) & (_share("b") >= share)).cast("int")
        told = told.unionByName(met.select("gt_id", _share("a").alias("a"), _share("b").alias("b"), both.alias("strict")))
    out = told.groupBy("gt_id").agg(F.max("a").alias("best_a"), F.max("b").alias("best_b"), F.max("strict").alias("strict"))
    return out.withColumn("independent", ((F.col("best_a") >= share) & (F.col("best_b") >= share)).cast("int")).withColumn(
        "any", ((F.col("best_a") >= share) | (F.col("best_b") >= share)).cast("int")
    )


def best_match(truth: DataFrame, blocks: DataFrame, share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """Per truth row the block with the largest smaller-side overlap, as a share of the smaller
    range; contigs must agree (contig_a, contig_b beside RANGE).  precision and F1 follow from it.  share is above 0."""
    extra = ["block_id", "contig_a", "contig_b"]
    found = both_directions(blocks.select(*RANGE, "block_id", "contig_a", "contig_b"), *extra)
    contigs = F.array_sort(F.array("contig_a", "contig_b")) == F.array_sort(F.array("p_contig_a", "p_contig_b"))

    def smaller(s: str) -> Column:
        least = F.least(F.col(f"{s}_end") - F.col(f"{s}_start"), F.col(f"p_{s}_end") - F.col(f"p_{s}_start")) + 1
        return overlap(f"{s}_start", f"{s}_end", f"p_{s}_start", f"p_{s}_end") / least

    met = _by_side(truth, found, "a", width).filter(contigs)
    met = met.withColumn("score", F.least(smaller("a"), smaller("b"))).filter(F.col("score") >= share)
    best = met.groupBy("gt_id").agg(F.max("score").alias("score"), F.max_by("p_block_id", F.struct("score", -F.col("p_block_id"))).alias("block_id"))
    return truth.select("gt_id").join(best, "gt_id", "left")


def best_cover(truth: DataFrame, blocks: DataFrame, share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """Per truth row the smallest block (by both spans, then block_id) that covers share (above 0) of both sides."""
    found = both_directions(blocks, "block_id")
    met = _by_side(truth, found, "a", width).filter((_share("a") >= share) & (_share("b") >= share))
    span = F.col("p_a_end") - F.col("p_a_start") + F.col("p_b_end") - F.col("p_b_start") + 2
    own = F.col("a_end") - F.col("a_start") + F.col("b_end") - F.col("b_start") + 2
    met = met.withColumn("span", span).withColumn("own", own)
    return met.groupBy("gt_id").agg(F.min_by("p_block_id", F.struct("span", "p_block_id")).alias("block_id"), F.min("span").alias("span"), F.first("own").alias("own")).withColumn(
        "size_ratio", F.col("span") / F.col("own")
    )


def containers(blocks: DataFrame, least: int = 2, width: int = WIDTH) -> DataFrame:
    """Blocks that hold at least `least` other blocks of their genome pair on both sides; an inner block meets the others in the one
    bin where its first side starts."""
    blocks = blocks.select("block_id", *RANGE)
    inner = blocks.withColumns({"last": F.col("a_end"), "a_end": F.col("a_start")})
    inside = (F.col("p_last") <= F.col("a_end")) & (F.col("b_start") <= F.col("p_b_start")) & (F.col("p_b_end") <= F.col("b_end"))
    met = _by_side(blocks, inner, "a", width).filter(inside & (F.col("block_id") != F.col("p_block_id")))
    return met.groupBy("block_id").agg(F.count("*").alias("n_inside")).filter(F.col("n_inside") >= least)


def nearest_start(points: DataFrame, genes: DataFrame, key: list[str]) -> DataFrame:
    """Per point(point_id, key, at) the gene with the closest start (ties to the smaller start): as-of
    in both directions, by two running windows over the union instead of a join of all pairs."""
    both = points.select(*key, F.col("at").alias("x"), "point_id", F.lit(None).cast("string").alias("gene_id")).unionByName(
        genes.select(*key, F.col("start").alias("x"), F.lit(None).cast(dict(points.dtypes)["point_id"]).alias("point_id"), "gene_id")
    )
    order = Window.partitionBy(*key).orderBy("x", F.col("gene_id").asc_nulls_last())
    back = Window.partitionBy(*key).orderBy(F.col("x").desc(), F.col("gene_id").desc_nulls_last())
    gene = F.when(F.col("gene_id").isNotNull(), F.struct("x", "gene_id"))
    seen = both.withColumn("low", F.last(gene, True).over(order)).withColumn("high", F.last(gene, True).over(back)).filter("point_id IS NOT NULL")
    near = F.when(F.col("low").isNull() | (F.col("high.x") - F.col("x") < F.col("x") - F.col("low.x")), F.col("high")).otherwise(F.col("low"))
    return seen.select("point_id", near["gene_id"].alias("gene_id"), F.abs(near["x"] - F.col("x")).alias("distance"))
