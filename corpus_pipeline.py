"""Corpus preparation: five stages over documents, each written as Parquet and reread.

All stages but the last return the columns of documents; what a stage drops is gone
for the next one.  The near-duplicate stage links texts whose sets of five-word shingles have a
similarity of NEAR_SIMILARITY or more; each link is verified exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.llm import decontaminate, language_id, set_dedup, source_mix, token_output
from locusweave.llm.common import delete_paths, fresh, made_paths, shared_path
from locusweave.llm.queries import vocabulary

NEAR_SIMILARITY = 0.8
#: Least share of the main language of a document that stays.
LEAST_SHARE = 1 / 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a main language go."""
    labelled = docs.filter(~language_id.held_out("doc_id") & F.col("lang").isNotNull())
    model = language_id.learn(labelled, "doc_id", "text", "lang")
    pred, score, langs = (fresh(docs, n) for n in ("_pred", "_score", "_langs"))
    told = language_id.predict(docs, model, names=(pred, score, langs))
    return told.filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE)).drop(pred, score, langs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: the least doc_id (none comes last), then the least hash of the text.
    Rows count as repeated if id and text are equal."""
    named = set_dedup.similar_groups(docs.select("doc_id", "text"), width=5, similarity=NEAR_SIMILARITY)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    key, own = fresh(docs, "_key"), fresh(docs, "_own")
    named_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stay = named.filter(first).select(named_id.alias(key), F.col("text_hash").alias(own)).distinct()
    hashed = docs.withColumns({key: named_id, own: F.xxhash64("text")})
    return hashed.join(stay, [key, own], "left_semi").dropDuplicates([key, own]).drop(key, own)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.contaminated(docs, benchmark).select(F.col("doc_id").alias("_leak"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs["text"]) == leaks["text_hash"])
    return docs.join(leaks, same, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last copy is cut after the words taken.
    Repeated rows take one share each."""
    at, key, row, size, take = (fresh(docs, n) for n in ("_at", "_key", "_row", "_size", "_take"))
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mixed = source_mix.mix_sources(docs).select(
        F.col("_at").alias(at), text_id.alias(key), F.col("size").alias(size), F.col("taken").alias(take)
    )
    mixed = mixed.withColumn(row, F.row_number().over(Window.partitionBy(at, key).orderBy(F.col(take).desc())))
    copies = F.transform(
        F.sequence(F.lit(0), F.floor((F.col(take) - 1) / F.col(size))), lambda i: F.least(F.col(size), F.col(take) - i * F.col(size))
    )
    mixed = mixed.filter(F.col(take) > 0).withColumn(take, F.explode(copies))
    placed = docs.withColumn(at, source_mix.seeded(docs)).withColumn(key, text_id)
    placed = placed.withColumn(row, F.row_number().over(Window.partitionBy(at, key).orderBy("source")))
    met = placed.join(mixed, [at, key, row])
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    head = F.array_join(F.slice(pieces, F.lit(1), (F.col(take) + lead).cast("int")), "")
    return met.withColumn("text", F.when(F.col(take) < F.col(size), head).otherwise(F.col("text"))).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the shared folder; a row per document read back from them."""
    path = shared_path(spark, "pipeline-token-ids")
    token_output.write_tokens(docs, vocabulary(), path)
    return token_output.read_digest(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("source_mix", mix),
    ("token_output", write_token_ids),
]

#: Similarity components and EM have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's intermediate tables are deleted once its result is written; those of the
    last one stay, as its rows are read when asked for."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = []
    for number, (name, stage) in enumerate(STAGES):
        before = set(made_paths())
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            delete_paths(spark, [p for p in made_paths() if p not in before and p != path] + read)
            docs, read = spark.read.parquet(path), [path]
    return docs
