import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from locusweave.functions import embed, expr
from locusweave.operators import genes, store
from locusweave.sources import files


def test_fasta_proteins(spark, tmp_path):
    (tmp_path / "s1.faa").write_text(">c1_1 # 10 # 99 # 1 # ID=1_1;partial=00;conf=99.1\nMKV\nLL*\n>c1_2 # 120 # 200 # -1 # x\nMX\n>bad header\nMM\n>p|k|g # 1 # 9 # 1 # y\nMA\n")
    got = {r.gene_id: r for r in files.fasta_proteins(spark, str(tmp_path / "*.faa")).collect()}
    assert set(got) == {"c1_1", "c1_2", "p"}
    assert (got["c1_1"].contig_id, got["c1_1"].sample_id, got["c1_1"].start, got["c1_1"].strand, got["c1_1"].seq) == ("c1", "s1", 10, 1, "MKVLL*")
    assert (got["p"].contig_id, got["p"].sample_id) == ("k", "g") and got["c1_2"].strand == -1
    assert {r.seq for r in files.clean_proteins(files.fasta_proteins(spark, str(tmp_path / "*.faa")), 2).collect()} == {"MKVLL", "MA"}
    stats = {r.gene_id: r for r in files.browser_genes(spark, str(tmp_path / "*.faa")).collect()}
    assert stats["c1_1"].confidence == 99.1 and not stats["c1_1"].is_partial


def test_gff_and_translation(spark, tmp_path):
    dna = "ATGAAATTTTAA"
    back = "".join({"A": "T", "T": "A", "C": "G", "G": "C"}[c] for c in reversed(dna))
    (tmp_path / "s.gff").write_text(f"##gff\nc\tp\tCDS\t1\t12\t.\t+\t0\tID=1_1;partial=00\nc\tp\tCDS\t13\t24\t.\t-\t0\tID=1_2;partial=10\nc\tp\tgene\t1\t9\t.\t+\t0\tID=z\n")
    cds = files.gff(spark, str(tmp_path / "s.gff"))
    assert cds.count() == 2
    contigs = spark.createDataFrame([("s", "c", dna + back)], "sample_id string, contig_id string, seq string")
    got = [(r.gene_id, r.seq) for r in files.genomic(cds, contigs, 2).orderBy("gene_id").collect()]
    assert got == [("s_CDS_1", "MKF"), ("s_CDS_2", "MKF")]
    proteins = spark.createDataFrame([("c_1", "MKF*")], "gene_id string, seq string")
    assert [r.gene_id for r in files.prodigal(cds, proteins, 2).collect()] == ["c_1"]


def test_tables(spark, tmp_path):
    pq.write_table(pa.table({"protein_id": ["a", "b"], "emb_001": [1.0, 2.0], "emb_000": [3.0, 4.0]}), tmp_path / "e.parquet")
    assert [list(r.emb) for r in files.embeddings_parquet(spark, str(tmp_path / "e.parquet")).orderBy("gene_id").collect()] == [[3.0, 1.0], [4.0, 2.0]]
    pq.write_table(pa.table({"gene_id": ["a"], "emb_000": pa.array([1.5], pa.float16())}), tmp_path / "h.parquet")
    assert files.half_float_parquet(spark, [str(tmp_path / "h.parquet")], ["emb_000"]).first().emb == [1.5]
    (tmp_path / "h.tsv").write_text("sequence_id\thmm_name\tfull_E-value\tfull_score\na\tX\t1e-9\t50\na\tY\t1e-3\t50\n")
    assert files.hmm_hits(spark, str(tmp_path / "h.tsv")).count() == 1
    (tmp_path / "m.txt").write_text("#####\n## Alignment 0: score=9.0 e_value=1 N=2 x&y minus\n  0-  0:\tg1\th2\t 1e-5\n  0-  1:\tg2\th1\t 1e-6\n## Alignment 1: score=9.0 e_value=1 N=1 x&z plus\n  1-  0:\tg5\th6\t 0\n")
    got = files.collinearity(spark, str(tmp_path / "m.txt")).orderBy("alignment", "row").collect()
    assert [(r.alignment, r.contig_a, r.contig_b, r.orientation, r.gene_a) for r in got] == [(0, "x", "y", -1, "g1"), (0, "x", "y", -1, "g2"), (1, "x", "z", 1, "g5")]
    (tmp_path / "l.json").write_text('{"landscape": {"blocks": [{"id": 1}, {"id": 2}]}}')
    assert files.landscape(spark, str(tmp_path / "l.json"), 1).count() == 1


def test_duckdb(spark, tmp_path):
    path = str(tmp_path / "x.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE proteins AS SELECT 'p' AS protein_id, 'c' AS contig_id, 'b' AS bin_id, 1 AS start, 9 AS end_coord, '-' AS strand")
        con.execute("CREATE TABLE annotations AS SELECT 'p' AS protein_id, 'pfam' AS source, 'PF1' AS name")
    assert files.duckdb_proteins(spark, path).first().strand == -1
    assert files.duckdb_annotations(spark, path, "pfam").first().accession == "PF1"


def test_store(spark, tmp_path):
    g = lambda *ids: spark.createDataFrame([(i, "s") for i in ids], "gene_id string, sample_id string")
    s = store.GeneStore.create(g("a", "b"), str(tmp_path / "st")).add(g("b", "c", "c"))
    assert sorted(r.gene_id for r in store.GeneStore.load(spark, s.path).genes.collect()) == ["a", "b", "c"]
    calls = []
    for _ in range(2):
        store.stage(spark, str(tmp_path / "stage"), lambda: calls.append(1) or g("x"))
    assert calls == [1]
    m = store.Manifest()
    m.register("blocks", "chain", "p", b"abc")
    assert m.verify("blocks", b"abc") and not m.verify("blocks", b"abd") and m.complete("chain", ["blocks"])


def test_stream(spark, tmp_path):
    from locusweave.streaming.append import follow

    rows = spark.createDataFrame([("a", "s"), ("b", "s")], "gene_id string, sample_id string")
    store.GeneStore.create(rows.limit(1), str(tmp_path / "st"))
    rows.write.parquet(str(tmp_path / "in"))
    follow(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "st"), str(tmp_path / "cp")).awaitTermination()
    assert store.GeneStore.load(spark, str(tmp_path / "st")).genes.count() == 2


def test_expressions(spark):
    row = spark.createDataFrame([("AACG", "x_12", [3.0, 4.0])], "s string, g string, v array<double>").select(
        expr.reverse_complement("s").alias("rc"), expr.gc_fraction("s").alias("gc"), expr.contig_of_gene("g").alias("c"), expr.gene_number("g").alias("n"), expr.norm("v").alias("norm"),
        F.size(expr.normalise("v", "adapter")).alias("k"), expr.overlap(F.lit(1), F.lit(5), F.lit(4), F.lit(9)).alias("o"),
    ).first()
    assert (row.rc, row.gc, row.c, row.n, row.norm, row.k, row.o) == ("CGTT", 0.5, "x", 12, 5.0, 2, 2)
    assert expr.parse_locus("g:c:1-9") == ("g", "c", 1, 9)


def test_missing_columns(spark):
    import pytest

    with pytest.raises(ValueError):
        genes.checked(spark.range(1))


def test_embedding(spark):
    df = spark.createDataFrame([("a", "MKV"), ("b", "M" * 3000), ("c", None)], "gene_id string, seq string")
    got = {r.gene_id: r.emb for r in embed.embed(df, lambda: embed.hash_model(8), 8, "weighted").collect()}
    assert len(got["a"]) == 8 and any(got["b"]) and not any(got["c"])
    assert len(embed.windows("M" * 3000)) == 4 and embed.windows("MK") == ["MK"]
