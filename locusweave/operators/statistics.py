"""Block and cluster statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.expr import unordered_pair
from locusweave.operators.numbering import running_total


def moments(df: DataFrame, group: list[str], x: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_pop"), F.stddev_samp(x).alias("std_samp"), F.min(x).alias("min"), F.max(x).alias("max")
    )


def quantiles(df: DataFrame, x: str, ps: list[float], group: list[str] = ()) -> DataFrame:
    """Exact interpolated quantiles: running counts of the distinct values of each group say which of them stand at the two ranks around
    each quantile; no group's values meet in one task.  Nulls are left out; a group of nulls alone has null quantiles."""
    group = list(group)
    hist = df.filter(F.col(x).isNotNull()).groupBy(*group, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    told = running_total(hist, [*group, "_x"], "_c", "_before")
    sizes = df.groupBy(*group).agg(F.count(x).alias("_n"))
    starts = told.groupBy(*group).agg(F.min("_before").alias("_start"))
    same = lambda a, b: [a[g].eqNullSafe(b[g]) for g in group] or [F.lit(True)]
    placed = sizes.join(starts, same(sizes, starts), "left").select(*[sizes[g] for g in group], "_n", "_start")
    placed = placed.join(told, same(placed, told), "left").select(*[placed[g] for g in group], "_n", "_x", "_c", (F.col("_before") - F.col("_start")).alias("_low"))
    at = lambda i: F.max(F.when((F.col("_low") <= i) & (i < F.col("_low") + F.col("_c")), F.col("_x")))
    ranks = [F.lit(p) * (F.col("_n") - 1) for p in ps]
    ends = [at(whole(h)).cast("double") for h in ranks for whole in (F.floor, F.ceil)]
    found = placed.groupBy(*group, "_n").agg(*[e.alias(f"_e{i}") for i, e in enumerate(ends)])
    between = lambda i, h: F.col(f"_e{2 * i}") + (h - F.floor(h)) * (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}"))
    return found.select(*group, *[between(i, h).alias(f"p{round(p * 100)}") for i, (p, h) in enumerate(zip(ps, ranks))])


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(unordered_pair(a, b).alias("pair")).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("n_self"))


def nearest_rank(df: DataFrame, x: str, p: float) -> DataFrame:
    """Value at rank round(p * (n - 1)) of the sorted column, by running counts of its distinct values; nulls come first."""
    hist = df.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("c"))
    n = hist.agg(F.sum("c").alias("n"))
    ranked = running_total(hist, ["x"], "c", "before").crossJoin(F.broadcast(n))
    return ranked.filter(F.col("before") + F.col("c") > F.floor(F.lit(p) * (F.col("n") - 1) + 0.5)).agg(F.min("x").alias("value"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that depends on key and seed alone."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def density(n: str, *spans: Column) -> Column:
    return F.col(n) / F.greatest(*spans) if len(spans) > 1 else F.col(n) / spans[0]
