"""Command line: init, embed, project, analyze, synteny, search, stats, store, browser."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions import embed
from locusweave.functions.expr import parse_locus
from locusweave.operators import genes, shingles
from locusweave.operators.store import GeneStore, exists
from locusweave.plans.browser import with_domains, write_browser
from locusweave.plans.pipeline import ChainConfig, run_chain_pipeline, search_locus
from locusweave.sources import files

# Settings that `init` writes; "model" is a callable that makes an embedder, as module:name, or "hash" for the stand-in.
DEFAULTS = {
    "embedding": {"model": "hash", "dim": 32, "pooling": "mean", "batch_residues": 16_000, "min_residues": 60, "project_to": 0},
    "chain": {f.name: f.default for f in dataclasses.fields(ChainConfig)},
}


def _settings(path: str | None) -> dict:
    return files.merge_config(DEFAULTS, files.load_config(path) if path else {})


def _chain(path: str | None, **over) -> ChainConfig:
    known = {f.name for f in dataclasses.fields(ChainConfig)}
    chosen = _settings(path)["chain"] | {k: v for k, v in over.items() if v is not None}
    if strange := sorted(set(chosen) - known):
        raise SystemExit(f"unknown chain settings: {', '.join(strange)}")
    return ChainConfig(**chosen)


def _embedded(proteins: DataFrame, settings: dict) -> DataFrame:
    """proteins with emb; the sequence goes."""
    dim, name = settings["dim"], settings["model"]

    def make():
        if name == "hash":
            return embed.hash_model(dim)
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)()

    clean = files.clean_proteins(proteins, settings["min_residues"])
    return embed.embed(clean, make, dim, settings["pooling"], settings["batch_residues"]).drop("seq")


def _projected(raw: DataFrame, dim: int) -> tuple[DataFrame, float]:
    """Vectors on their dim leading components and the share of variance that these explain; dim 0 leaves them."""
    if not dim:
        return raw, 1.0
    mean, comp, share = shingles.pca(raw, dim)
    return shingles.project(raw, mean, comp), float(share.sum())


def _proteins(spark: SparkSession, path: str, fasta: str | None) -> DataFrame:
    """Proteins of a FASTA file or folder, or of a GFF file with its nucleotide FASTA."""
    if not path.endswith((".gff", ".gff3")):
        return files.fasta_proteins(spark, path)
    if not fasta:
        raise SystemExit("a GFF query needs --fasta with the contigs")
    contigs = files.fasta(spark, fasta).select(F.substring_index("header", " ", 1).alias("contig_id"), F.upper("seq").alias("seq"))
    cds = files.gff(spark, path)
    return files.genomic(cds, cds.select("sample_id", "contig_id").distinct().join(contigs, "contig_id"), 0)


def _gene_table(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Genes with vectors from a store, a gene table, or proteins and vectors given apart."""
    if getattr(args, "store", None):
        return GeneStore.load(spark, args.store).genes
    if getattr(args, "genes", None):
        return files.genes_parquet(spark, args.genes)
    if not args.embeddings or not (args.db or args.proteins):
        raise SystemExit("name --store, --genes, or --embeddings with --db or --proteins")
    proteins = files.duckdb_proteins(spark, args.db) if args.db else files.fasta_proteins(spark, args.proteins).drop("seq")
    vectors = files.embeddings_h5(spark, args.embeddings) if args.embeddings.endswith((".h5", ".hdf5")) else files.embeddings_parquet(spark, args.embeddings)
    return genes.join_embeddings(proteins, vectors)


def _init(args: argparse.Namespace) -> int:
    if os.path.exists(args.config) and not args.force:
        print(f"{args.config} is there already; --force replaces it", file=sys.stderr)
        return 1
    with open(args.config, "w") as f:
        f.write(json.dumps(DEFAULTS, indent=2) + "\n")  # JSON is YAML too
    return 0


def _embed(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = _settings(args.config)["embedding"]
    raw = _embedded(files.fasta_proteins(spark, args.proteins), settings)
    if args.raw:
        raw.withColumnRenamed("emb", "raw").write.mode("overwrite").parquet(args.raw)
        raw = spark.read.parquet(args.raw).withColumnRenamed("raw", "emb")
    out, _ = _projected(raw, settings["project_to"])
    out.write.mode("overwrite").parquet(args.output)


def _project(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = files.raw_embeddings(spark, args.raw).withColumnRenamed("raw", "emb")
    out, share = _projected(raw, args.dim or _settings(args.config)["embedding"]["project_to"])
    out.write.mode("overwrite").parquet(args.output)
    print(f"explained variance {share:.3f}")


def _search(spark: SparkSession, args: argparse.Namespace) -> None:
    config = _chain(args.config, similarity=args.similarity)
    placed = genes.position_index(files.genes_parquet(spark, args.genes))
    if os.path.exists(args.query) or args.query.endswith((".faa", ".fa", ".fasta", ".gff", ".gff3")):
        settings = _settings(args.config)["embedding"]
        locus = genes.position_index(_embedded(_proteins(spark, args.query, args.fasta), settings))
        if args.name:
            locus = locus.withColumn("sample_id", F.lit(args.name))
    else:
        genome, contig, first, last = parse_locus(args.query)
        locus = placed.filter((F.col("sample_id") == genome) & (F.col("contig_id") == contig) & F.col("position_index").between(first, last))
    search_locus(locus, placed, config, args.top).show(args.top, truncate=False)


def _synteny(spark: SparkSession, args: argparse.Namespace) -> None:
    table = _gene_table(spark, args)
    if args.add:
        grown = GeneStore.load(spark, args.store) if args.store and exists(spark, args.store) else None
        if grown is None:
            raise SystemExit("--add needs a --store that is there")
        table = grown.add(files.genes_parquet(spark, args.add)).genes
    over = {"similarity": args.similarity, "max_gap": args.max_gap, "min_size": args.min_size, "support": args.support, "gap_penalty": args.gap_penalty, "jaccard": args.jaccard, "index": args.index, "k": args.k}
    if args.annotations:
        table = with_domains(table, files.duckdb_annotations(spark, args.annotations))
    run_chain_pipeline(table, args.output, _chain(args.config, **over)).show(truncate=False)
    if args.browser:
        known = files.duckdb_annotations(spark, args.annotations) if args.annotations else None
        write_browser(args.output, table, f"{args.output}/browser", known, args.browser)


def _store(spark: SparkSession, args: argparse.Namespace) -> None:
    table = files.genes_parquet(spark, args.genes)
    if GeneStore.load(spark, args.path).parts:
        GeneStore.load(spark, args.path).add(table)
    else:
        GeneStore.create(table, args.path)


def _browser(spark: SparkSession, args: argparse.Namespace) -> None:
    known = files.duckdb_annotations(spark, args.annotations) if args.annotations else None
    tables = write_browser(args.run, _gene_table(spark, args), f"{args.run}/browser", known, args.sqlite)
    print("\n".join(sorted(tables)))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for x in positional:
            c.add_argument(x)
        if name not in ("init", "stats", "store", "browser"):
            c.add_argument("--config")
        return c

    c = command("init", "write the default settings")
    c.add_argument("--config", default="locusweave.json")
    c.add_argument("--force", action="store_true")
    c = command("embed", "vectors of protein FASTA files", "proteins", "output")
    c.add_argument("--raw", help="also keep the vectors before projection here")
    c = command("project", "project kept vectors by principal components", "raw", "output")
    c.add_argument("--dim", type=int)
    command("analyze", "blocks, clusters and architecture of a gene table", "genes", "output")
    c = command("synteny", "the same from a store, a database or files, with settings by option", "output")
    for name in ("--store", "--genes", "--db", "--proteins", "--embeddings", "--add", "--annotations", "--browser", "--index"):
        c.add_argument(name)
    for name, kind in (("--similarity", float), ("--max-gap", int), ("--min-size", int), ("--support", int), ("--gap-penalty", float), ("--jaccard", float), ("-k", int)):
        c.add_argument(name, type=kind)
    c = command("search", "blocks between a query (genome:contig:first-last, FASTA or GFF) and the other genomes", "genes", "query")
    c.add_argument("--similarity", type=float)
    c.add_argument("--top", type=int, default=50)
    c.add_argument("--fasta", help="contigs of a GFF query")
    c.add_argument("--name", help="genome name of a file query")
    command("stats", "genes and contigs per genome", "genes")
    command("store", "add a gene table to a store (made if there is none)", "path", "genes")
    c = command("browser", "browser tables of a finished run", "run")
    for name in ("--store", "--genes", "--sqlite", "--annotations", "--db", "--proteins", "--embeddings"):
        c.add_argument(name)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        return _init(args)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "analyze":
        run_chain_pipeline(files.genes_parquet(spark, args.genes), args.output, _chain(args.config)).show(truncate=False)
    elif args.command == "stats":
        genes.genome_rollup(files.genes_parquet(spark, args.genes)).show(1000)
    else:
        {"embed": _embed, "project": _project, "search": _search, "synteny": _synteny, "store": _store, "browser": _browser}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
