"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame only).

Each source wants weight-proportional tokens, at most `most` times what it has; what a
stopped source leaves is shared anew by weight.  Targets follow in closed form from
the sources sorted by stop/weight.  The total is cut into equal token blocks; sources
get integer block quotas by highest quotients size/(2s+1), and so do the shards of a
source from its quota.  In a shard the documents lie in seeded order and its quota is
taken as whole epochs and a run of blocks from the start of that order.

Highest quotients are found exactly without a loop: a common divisor that can't hand
out too many blocks gives each party its first seats, one that can't hand out too few
bounds its last, and only the few quotients between are ranked.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own,
last in order; repeated rows count each (equal rows tie in the seeded order and share one place); a very long text is only
counted; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import WORD, materialize

SHARD = 1_000  # documents aimed at in a shard
MOST_SHARDS = 100_000  # of a source; beyond that its shards grow


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources(source, source_size) -> with weight and target; one row per source comes together."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("level", left / weight)
    share = level.withColumn("stopped", F.col("stop") < F.col("level") * F.col("weight"))
    common = F.min(F.when(~F.col("stopped"), F.struct(F.col("stop") / F.col("weight"), F.col("level")))).over(every)
    return share.withColumn(
        "target", F.when(F.col("stopped"), F.col("stop")).otherwise(common["level"] * F.col("weight"))
    ).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, within: list[str], votes: str, seats: str, key: str) -> DataFrame:
    """parties with quota: Sainte-Lague seats of each party (column key) of a group (columns
    within); `seats` is the group's number of seats and the same in all its rows."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    total = F.sum(F.col(votes).cast("double")).over(group)
    n, half = F.col(seats).cast("double"), F.col("_half")
    known = parties.withColumn("_half", F.count("*").over(group) / 2).withColumn(
        "_v", F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    )
    known = known.withColumn("_low", F.when(n > half, F.floor((n - half) * F.col("_v") + 0.5)).otherwise(F.lit(0)))
    known = known.withColumn("_high", F.ceil((n + half) * F.col("_v") + 0.5) + 1)
    known = known.withColumn("_rest", F.col(seats) - F.sum("_low").over(group))
    asked = known.filter("_v > 0").select(
        *within, key, "_rest", "_v", F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_s")
    )
    best = group.orderBy((F.col("_v") / (2 * F.col("_s") + 1)).desc(), key, "_s")
    won = asked.withColumn("_k", F.row_number().over(best)).filter("_k <= _rest")
    won = won.groupBy(*within, key).agg(F.count("*").alias("_won"))
    out = known.join(won, [*within, key], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_v", "_half", "_low", "_high", "_rest", "_won")


def seeded(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The place of a document in the seeded order: a hash of seed, id and text."""
    return F.xxhash64(F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("")), docs[text_col])


def mix_sources(
    docs: DataFrame, seed: int = 17, most: int = 3, weights: tuple[int, ...] = (1, 2, 3),
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, source and the seeded
    order _at (equal rows share it)."""
    sized = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        seeded(docs, seed, id_col, text_col).alias("_at"),
    )
    sized = materialize(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    aimed = targets(per_source.select("source", "source_size"), most, weights)
    aimed = aimed.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    every = Window.partitionBy(F.lit(0))
    total, number = F.sum("source_size").over(every), F.count("*").over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(total / (number * 1000)))).cast("bigint")
    aimed = aimed.withColumn("block", block).withColumn("blocks", F.floor(total / block).cast("bigint"))
    quotas = apportion(aimed, [], "target", "blocks", "_key").withColumnRenamed("quota", "source_quota")
    quotas = quotas.join(
        per_source.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), "_docs"), "_key"
    ).select("_key", "source_size", "target", "block", "source_quota", F.least(F.ceil(F.col("_docs") / SHARD), F.lit(MOST_SHARDS)).alias("_shards"))
    quotas = materialize(quotas, "mix-quotas")
    placed = sized.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    placed = placed.join(quotas, "_key").withColumn("_shard", F.pmod(F.xxhash64("_at"), F.col("_shards")))
    shards = placed.groupBy("_key", "_shard").agg(
        F.sum("size").alias("_shard_size"), F.first("source_quota").alias("source_quota")
    )
    shard_quota = materialize(
        apportion(shards, ["_key"], "_shard_size", "source_quota", "_shard").select("_key", "_shard", "_shard_size", "quota"),
        "mix-shards",
    )
    order = Window.partitionBy("_key", "_shard").orderBy("_at", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    walked = placed.join(shard_quota, ["_key", "_shard"]).withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    tokens = F.least(F.col("quota") * F.col("block"), F.col("_shard_size") * most)
    walked = walked.withColumn("_tokens", tokens).withColumn(
        "_epochs", F.when(F.col("_shard_size") > 0, F.floor(F.col("_tokens") / F.col("_shard_size"))).otherwise(F.lit(0)).cast("bigint")
    )
    rest = F.col("_tokens") - F.col("_epochs") * F.col("_shard_size") - F.col("_before")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return walked.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("bigint").alias("taken"), "source", "_at"
    )
