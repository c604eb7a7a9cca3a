"""Sequential numbers and running totals in a global order without one global window.

Rows are range-partitioned by the order, each partition is walked by itself, and the partitions' totals (one row for
each partition) are summed in partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.graph import cut


def running_totals(df: DataFrame, order: list[str | Column], values: dict[str, str | Column]) -> DataFrame:
    """df with, for each name of values, the total of that value over all rows before each one; order must be total."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    keys, held = [f"_o{i}" for i in range(len(order))], {n: f"_value{i}" for i, n in enumerate(values)}
    keyed = df.select("*", *[column(o).alias(k) for k, o in zip(keys, order)], *[column(v).alias(held[n]) for n, v in values.items()])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(keyed.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in held.values()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sums.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_start{v}") for v in held.values()])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_part").withColumns({n: F.col(f"_start{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in held.items()})
    return out.drop("_part", *held.values(), *[f"_start{v}" for v in held.values()], *keys)


def running_total(df: DataFrame, order: list[str | Column], value: str | Column, name: str) -> DataFrame:
    """df with the total of value over all rows before each one; order must be total."""
    return running_totals(df, order, {name: value})


def numbered_rows(df: DataFrame, order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """df with consecutive numbers from first on in the given total order."""
    return running_total(df, order, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) + F.lit(first))
