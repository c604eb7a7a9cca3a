"""File sources: FASTA, GFF, tables, hits, collinearity text, blocks and clusters, JSON, DuckDB.

Text formats are read by Spark with a record delimiter, so a file of any size splits."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.functions.expr import contig_of_gene, gc_fraction, reverse_complement, translate_to_stop
from locusweave.operators.genes import checked, fold_vectors
from locusweave.operators.graph import checkpoint_folder
from locusweave.sources import split

ID_COLUMNS = ("gene_id", "protein_id", "id")
ACCESSION_COLUMNS = ("accession", "name", "annotation_id")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, seq) of every record under path; sequence lines are joined."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("_path"), F.regexp_replace("value", r"^>", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    rows = records.select(_stem(F.col("_path")).alias("file"), F.trim(F.regexp_replace(head, "\r", "")).alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return rows.filter("header <> ''")


def fasta_proteins(spark: SparkSession, path: str) -> DataFrame:
    """Headers `ID # start # end # strand`, or `P|C|G # ...`; the contig is the id without its trailing
    number; records with fewer than four # fields are skipped; the genome is the file unless the id names it."""
    parts, ids = F.split("header", "#"), F.split(F.trim(F.split("header", "#")[0]), r"\|")
    named = F.size(ids) == 3
    rows = fasta(spark, path).filter(F.size(parts) >= 4)
    gene = F.when(named, ids[0]).otherwise(F.trim(parts[0]))
    return rows.select(
        F.when(named, F.get(ids, F.lit(2))).otherwise(F.col("file")).alias("sample_id"),
        F.when(named, F.get(ids, F.lit(1))).otherwise(contig_of_gene(gene)).alias("contig_id"), gene.alias("gene_id"),
        F.trim(parts[1]).cast("bigint").alias("start"), F.trim(parts[2]).cast("bigint").alias("end"),
        F.when(F.trim(parts[3]).cast("int") >= 0, 1).otherwise(-1).alias("strand"), "seq",
    )


def clean_proteins(proteins: DataFrame, least: int = 0) -> DataFrame:
    """Stops and unknown residues removed, short sequences dropped."""
    return proteins.withColumn("seq", F.regexp_replace(F.upper("seq"), r"[*X]", "")).filter(F.length("seq") >= least)


def gff(spark: SparkSession, path: str) -> DataFrame:
    """CDS rows: sample_id (file), contig_id, start, end, strand, attributes, id, partial."""
    c = F.split("value", "\t")
    lines = spark.read.text(path).select(_stem(F.input_file_name()).alias("sample_id"), "value").filter(~F.col("value").startswith("#") & (F.size(c) >= 9))
    rows = lines.select(
        "sample_id", c[0].alias("contig_id"), c[2].alias("kind"), c[3].cast("bigint").alias("start"), c[4].cast("bigint").alias("end"),
        F.when(c[6] == "-", -1).otherwise(1).alias("strand"), c[8].alias("attributes"),
    )
    cds = rows.filter("kind = 'CDS'").drop("kind")
    return cds.withColumn("id", F.regexp_extract("attributes", r"(?:^|;)ID=([^;]+)", 1)).withColumn(
        "partial", F.regexp_extract("attributes", r"(?:^|;)partial=([^;]+)", 1).isin("10", "01", "11")
    )


def prodigal(cds: DataFrame, proteins: DataFrame, min_aa: int = 60, keep_partial: bool = False) -> DataFrame:
    """CDS rows with their protein, found under the id, contig_number of the id, or sample-prefixed id."""
    number = F.regexp_extract("id", r"(\d+)$", 1)
    tries = [F.col("id"), F.concat_ws("_", "contig_id", number), F.concat_ws("_", "sample_id", "id")]
    look = proteins.select(F.col("gene_id").alias("_key"), F.col("seq").alias("_seq"))
    rows = cds.filter(~F.col("partial")) if not keep_partial else cds
    tried = rows.select("*", F.posexplode(F.array(*tries)).alias("_order", "_key"))
    met = tried.join(look, "_key")
    best = Window.partitionBy("sample_id", "contig_id", "start", "end", "id").orderBy("_order")
    found = met.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return clean_proteins(found.select("sample_id", "contig_id", F.col("_key").alias("gene_id"), "start", "end", "strand", F.col("_seq").alias("seq")), min_aa)


def genomic(cds: DataFrame, contigs: DataFrame, min_aa: int = 60) -> DataFrame:
    """CDS rows translated from contigs(sample_id, contig_id, seq): sliced, reverse-complemented, read with table
    11 up to the stop; gene ids count the genes that are kept, in order of contig and start."""
    met = cds.join(contigs.withColumnRenamed("seq", "_contig"), ["sample_id", "contig_id"])
    piece = F.expr("substring(_contig, CAST(start AS INT), CAST(end - start + 1 AS INT))")
    coded = met.withColumn("_dna", piece).withColumn("_dna", F.when(F.col("strand") < 0, reverse_complement("_dna")).otherwise(F.col("_dna")))
    rows = coded.withColumn("seq", F.regexp_replace(translate_to_stop("_dna"), "[*X]", "")).filter(F.length("seq") >= min_aa)
    order = Window.partitionBy("sample_id").orderBy("contig_id", "start", "end")
    return rows.select("sample_id", "contig_id", F.concat(F.col("sample_id"), F.lit("_CDS_"), F.row_number().over(order)).alias("gene_id"), "start", "end", "strand", "seq")


def contig_stats(contigs: DataFrame) -> DataFrame:
    return contigs.select("sample_id", "contig_id", F.length("seq").alias("length"), gc_fraction("seq").alias("gc"))


def browser_genes(spark: SparkSession, path: str) -> DataFrame:
    """FASTA genes with conf= and partial= of their header."""
    rows = fasta(spark, path)
    return rows.select(
        F.col("file").alias("genome_id"), F.trim(F.split("header", "#")[0]).alias("gene_id"), F.length("seq").alias("aa_length"),
        F.regexp_extract("header", r"conf=([0-9.]+)", 1).try_cast("double").alias("confidence"), (F.regexp_extract("header", r"partial=([01]{2})", 1) != "00").alias("is_partial"),
    )


def genes_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Gene table; complains about missing columns, folds emb_* into emb."""
    return fold_vectors(checked(spark.read.parquet(path)))


def raw_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return fold_vectors(spark.read.parquet(path), "raw_", "raw")


def embeddings_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, emb); the id column is the first of gene_id, protein_id, id."""
    rows = spark.read.parquet(path)
    found = [c for c in ID_COLUMNS if c in rows.columns]
    if not found:
        raise ValueError(f"no id column among {', '.join(ID_COLUMNS)}")
    return fold_vectors(rows).select(F.col(found[0]).alias("gene_id"), "emb")


def half_float_parquet(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Parquet with float16 columns, which Spark's reader refuses: pyarrow reads each file in a task and
    widens them.  Paths must be readable by the executors (a shared mount)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for part in pq.ParquetFile(path).iter_batches():
                    vectors = list(zip(*[part.column(c).cast(pa.float32()).to_pylist() for c in columns]))
                    yield pa.record_batch({"gene_id": part.column("gene_id"), "emb": pa.array(vectors, pa.list_(pa.float32()))})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, "gene_id string, emb array<float>")


def hmm_hits(spark: SparkSession, path: str, evalue: float = 1e-5, score: float = 25.0) -> DataFrame:
    """Domain hits below the E-value and above the score."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    rows = rows.withColumn("evalue", F.col("`full_E-value`").cast("double")).withColumn("score", F.col("full_score").cast("double"))
    return rows.filter((F.col("evalue") <= evalue) & (F.col("score") >= score)).orderBy("evalue")


def collinearity(spark: SparkSession, path: str) -> DataFrame:
    """Gene pairs of `## Alignment N: ... a&b plus|minus` blocks: alignment, contig_a, contig_b,
    orientation, gene_a, gene_b, evalue.  A record ends where the next block begins, so a file of any size splits."""
    records = spark.read.option("lineSep", "\n## Alignment ").text(path)
    blocks = records.select(F.regexp_replace("value", r"(?s)^(?:.*\n)?## Alignment ", "").alias("b")).filter(F.col("b").rlike(r"^\d+:"))
    head = F.substring_index("b", "\n", 1)
    pairs = blocks.select(
        F.regexp_extract(head, r"^(\d+):", 1).cast("int").alias("alignment"), F.regexp_extract(head, r"(\S+)&(\S+)\s+(plus|minus)", 1).alias("contig_a"),
        F.regexp_extract(head, r"(\S+)&(\S+)\s+(plus|minus)", 2).alias("contig_b"), F.when(head.rlike(r"minus\s*$"), -1).otherwise(1).alias("orientation"),
        F.posexplode(F.slice(F.split("b", "\n"), 2, 1 << 30)).alias("row", "line"),
    )
    c = F.split("line", "\t")
    return pairs.filter(F.size(c) >= 3).select("alignment", "contig_a", "contig_b", "orientation", "row", F.trim(c[1]).alias("gene_a"), F.trim(c[2]).alias("gene_b"), F.trim(F.get(c, F.lit(3))).try_cast("double").alias("evalue"))


def block_csv(spark: SparkSession, path: str) -> DataFrame:
    """Blocks written as CSV, in any of three layouts that their columns tell apart."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    names = set(rows.columns)
    if "query_anchor_genes" in names:
        lists = {c: F.from_json(c, "array<string>") for c in ("query_anchor_genes", "target_anchor_genes")}
        return rows.withColumns(lists).withColumn("layout", F.lit("chain"))
    if "query_windows_json" in names or "query_windows" in names:
        side = "query_windows_json" if "query_windows_json" in names else "query_windows"
        return rows.withColumn("query_window_list", F.split(side, ";")).withColumn("layout", F.lit("windows"))
    return rows.withColumn("layout", F.lit("locus"))


def cluster_csv(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """Clusters that have blocks."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    return rows.join(blocks.select(F.col("cluster_id").cast("int").alias("cluster_id")), "cluster_id", "left_semi")


def landscape(spark: SparkSession, path: str, limit: int | None = None, size: int = split.BYTES) -> DataFrame:
    """landscape.blocks[] of a JSON document; a single file is read in ranges of whole objects of about `size` bytes."""
    if os.path.isfile(path):
        held = split.registered(spark).read.format("json_objects").options(path=path, keys="landscape.blocks", bytes=size).load()
        rows = spark.read.json(held.rdd.map(lambda r: r.value))
    else:
        rows = spark.read.option("multiLine", True).json(path).select(F.explode("landscape.blocks").alias("b")).select("b.*")
    return rows.limit(limit) if limit else rows


def _streamed(spark: SparkSession, path: str, sql: str, rows: int = 200_000) -> DataFrame:
    """Result of a query on a DuckDB file, batch by batch through the driver into Parquet in the shared folder."""
    import duckdb
    import pyarrow as pa

    out = f"{checkpoint_folder(spark)}/duckdb-{uuid.uuid4().hex}"
    with duckdb.connect(path, read_only=True) as con:
        reader = con.sql(sql).to_arrow_reader(rows)
        empty = True
        for batch in reader:
            spark.createDataFrame(pa.Table.from_batches([batch])).write.mode("append").parquet(out)
            empty = False
        if empty:
            spark.createDataFrame(reader.schema.empty_table()).write.parquet(out)
    return spark.read.parquet(out)


def _duckdb(spark: SparkSession, path: str, table: str, columns: str, schema: str, rows: int = split.ROWS) -> DataFrame:
    """Columns of a table of a DuckDB file, read by the tasks in ranges of row numbers; a view has none and is streamed."""
    import duckdb

    with duckdb.connect(path, read_only=True) as con:
        kind = con.execute("SELECT table_type FROM information_schema.tables WHERE table_name = ?", [table]).fetchone()
    if kind and kind[0] == "VIEW":
        return _streamed(spark, path, f"SELECT {columns} FROM {table}")
    return split.registered(spark).read.format("duckdb_rows").options(path=path, table=table, columns=columns, rows=rows).schema(schema).load()


def duckdb_proteins(spark: SparkSession, path: str) -> DataFrame:
    """Proteins of a DuckDB file; the strand - is -1."""
    columns = "CAST(protein_id AS VARCHAR) AS gene_id, CAST(contig_id AS VARCHAR) AS contig_id, CAST(bin_id AS VARCHAR) AS sample_id, start, end_coord AS \"end\", CAST(strand AS VARCHAR) AS strand"
    df = _duckdb(spark, path, "proteins", columns, "gene_id string, contig_id string, sample_id string, start bigint, `end` bigint, strand string")
    return df.withColumn("strand", F.when(F.col("strand").startswith("-"), -1).otherwise(1))


def duckdb_annotations(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Annotations of a DuckDB file: protein_id, source, accession, description, evalue, score; absent columns null."""
    import duckdb

    with duckdb.connect(path, read_only=True) as con:
        have = [r[0] for r in con.execute("SELECT column_name FROM information_schema.columns WHERE table_name = 'annotations'").fetchall()]
    accession = next((c for c in ACCESSION_COLUMNS if c in have), "NULL")
    more = ", ".join(f"CAST({c if c in have else 'NULL'} AS {t}) AS {c}" for c, t in (("description", "VARCHAR"), ("evalue", "DOUBLE"), ("score", "DOUBLE")))
    columns = f"CAST(protein_id AS VARCHAR) AS protein_id, CAST(source AS VARCHAR) AS source, CAST({accession} AS VARCHAR) AS accession, {more}"
    df = _duckdb(spark, path, "annotations", columns, "protein_id string, source string, accession string, description string, evalue double, score double")
    return df.filter(F.col("source") == source) if source else df


def vector_files(folder: str) -> list[str]:
    """Candidate vector files of a local folder, by name."""
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith((".npy", ".npz")))


def vectors_npy(spark: SparkSession, path: str, ids: list[str] | None = None, rows: int = split.ROWS) -> DataFrame:
    """(gene_id, emb) of a .npy matrix or an .npz archive, whose matrix and ids are found by name or, failing that, by their shape; the tasks read
    ranges of rows.  Rows without ids are numbered; ids: names of the rows in order."""
    found = split.registered(spark).read.format("vector_matrix").options(path=path, rows=rows, numbered=ids is not None).load()
    if ids is None:
        return found
    named = spark.createDataFrame([(str(i), n) for i, n in enumerate(ids)], "at string, name string")
    return found.withColumnRenamed("gene_id", "at").join(named, "at").select(F.col("name").alias("gene_id"), "emb")


def embeddings_h5(spark: SparkSession, path: str, rows: int = split.ROWS) -> DataFrame:
    """(gene_id, emb) of protein_ids and embeddings of an HDF5 file (needs h5py); the tasks read ranges of rows."""
    split.Matrix(path)  # an error here, where h5py is absent
    return split.registered(spark).read.format("vector_matrix").options(path=path, rows=rows).load()


def half_float_output(df: DataFrame, path: str) -> None:
    """Parquet at path (which the executors reach) whose float columns are half floats; half_float_parquet reads it."""
    split.registered(df.sparkSession)
    df.write.format("half_float_parquet").mode("append").options(path=path).save()


def merge_config(base: dict, over: dict) -> dict:
    """Deep merge; the second wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str, *more: str) -> dict:
    def one(p: str) -> dict:
        with open(p) as f:
            text = f.read()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text) or {}

    out = one(path)
    for p in more:
        out = merge_config(out, one(p))
    return out
