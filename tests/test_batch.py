from pyspark.sql import functions as F

from locusweave import cli
from locusweave.operators import genes
from locusweave.plans import catalogue
from locusweave.plans.pipeline import ChainConfig, run_chain_pipeline, search_locus


def test_run_and_resume(spark, sf_dir, tmp_path):
    table = catalogue.genes_view(spark, sf_dir).drop("position_index")
    config = ChainConfig(similarity=0.2)
    first = run_chain_pipeline(table, str(tmp_path / "out"), config).first()
    assert first.num_genes == 500 and first.num_blocks == 359  # as an independent count of the same tables has it
    assert run_chain_pipeline(table, str(tmp_path / "out"), config).first() == first
    loci = spark.read.parquet(str(tmp_path / "out" / "architecture" / "loci"))
    assert loci.count() > 0 and spark.read.parquet(str(next((tmp_path / "out").glob("anchors-*")))).count() == 6246
    other = run_chain_pipeline(table, str(tmp_path / "out"), ChainConfig(similarity=0.25)).first()
    assert other.num_blocks < first.num_blocks and len(list((tmp_path / "out").glob("anchors-*"))) == 2
    fewer = run_chain_pipeline(table.filter("sample_id <> 'g0'"), str(tmp_path / "out"), config).first()
    assert fewer.num_genes < 500


def test_inverted_file_run_finds_most_anchors(spark, sf_dir):
    from functools import partial

    from locusweave.operators import anchors, nearest

    table = catalogue.genes_view(spark, sf_dir)
    exact = anchors.cross_genome_anchors(table, 50, 0.2).count()
    found = anchors.cross_genome_anchors(table, 50, 0.2, partial(nearest.nearest_ivf, nprobe=16)).count()
    assert 0.9 * exact <= found <= exact


def test_search(spark, sf_dir):
    table = catalogue.genes_view(spark, sf_dir)
    locus = table.filter((F.col("sample_id") == "g0") & (F.col("contig_id") == "c0") & (F.col("position_index") < 10))
    got = search_locus(locus, table, ChainConfig(similarity=0.2)).collect()
    assert [r.chain_score for r in got] == sorted((r.chain_score for r in got), reverse=True)
    assert all(r.query_genome == "g0" and r.target_genome != "g0" for r in got)


def test_search_honours_the_index(spark, sf_dir, monkeypatch):
    from locusweave.operators import anchors, nearest

    asked = []
    monkeypatch.setattr(anchors, "index_search", lambda index, nprobe: asked.append((index, nprobe)) or nearest.nearest_exact)
    table = catalogue.genes_view(spark, sf_dir)
    locus = table.filter("sample_id = 'g0' AND contig_id = 'c0' AND position_index < 4")
    search_locus(locus, table, ChainConfig(similarity=0.2, index="ivf_sq", nprobe=3)).count()
    assert asked == [("ivf_sq", 3)]


def test_command_line(spark, sf_dir, tmp_path, capsys):
    import json
    import sqlite3

    at = lambda *x: str(tmp_path.joinpath(*x))
    catalogue.genes_view(spark, sf_dir).drop("position_index").write.parquet(at("genes"))
    assert cli.main(["stats", at("genes")]) == 0 and "genome_id" in capsys.readouterr().out
    assert cli.main(["store", at("st"), at("genes")]) == 0
    assert cli.main(["search", at("genes"), "g0:c0:0-9", "--similarity", "0.2"]) == 0
    assert cli.main(["init", "--config", at("c.json")]) == 0 and cli.main(["init", "--config", at("c.json")]) == 1
    assert json.load(open(at("c.json")))["chain"]["max_gap"] == 2
    assert cli.main(["synteny", at("run"), "--store", at("st"), "--similarity", "0.2", "--index", "exact", "--browser", at("b.db")]) == 0
    with sqlite3.connect(at("b.db")) as db:
        assert db.execute("SELECT count(*) FROM genes").fetchone()[0] == 500
        assert db.execute("SELECT count(*) FROM gene_block_mappings").fetchone()[0] > 0
    assert cli.main(["browser", at("run"), "--genes", at("genes")]) == 0 and "cluster_assignments" in capsys.readouterr().out


def test_command_line_from_proteins(spark, tmp_path, capsys):
    import random

    rng = random.Random(2)
    at = lambda *x: str(tmp_path.joinpath(*x))
    tmp_path.joinpath("faa").mkdir()
    families = ["M" + "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=90)) for _ in range(12)]
    for genome in ("p1", "p2", "p3"):
        lines = [f">{genome}c_{i} # {1000 * i + 1} # {1000 * i + 270} # 1 # x\n{s}*\n" for i, s in enumerate(families, 1)]
        tmp_path.joinpath("faa", f"{genome}.faa").write_text("".join(lines))
    assert cli.main(["embed", at("faa"), at("genes"), "--raw", at("raw")]) == 0
    assert spark.read.parquet(at("genes")).count() == 36
    assert cli.main(["project", at("raw"), at("small"), "--dim", "8"]) == 0 and "explained" in capsys.readouterr().out
    assert len(spark.read.parquet(at("small")).first().emb) == 8
    assert cli.main(["search", at("genes"), at("faa", "p1.faa"), "--similarity", "0.95"]) == 0
    out = capsys.readouterr().out
    assert "p2" in out and "p3" in out
    assert cli.main(["analyze", at("genes"), at("run")]) == 0 and "num_clusters" in capsys.readouterr().out


def test_position_ties(spark):
    rows = [("s", "c", "b", 5, 9), ("s", "c", "a", 5, 9), ("s", "c", "z", 1, 9)]
    df = spark.createDataFrame(rows, "sample_id string, contig_id string, gene_id string, start long, end long")
    assert {r.gene_id: r.position_index for r in genes.position_index(df).collect()} == {"z": 0, "a": 1, "b": 2}
