"""Sources that split one file over tasks, and the half-float writer."""

import json
import os

import duckdb
import numpy as np
import pytest

from locusweave.sources import files, split


def test_matrices_in_row_ranges(spark, tmp_path):
    x = np.arange(46, dtype=np.float64).reshape(23, 2)
    np.save(tmp_path / "a.npy", x)
    np.savez_compressed(tmp_path / "b.npz", other=np.arange(23), emb=x.astype(np.float32), ids=np.array([f"g{i}" for i in range(23)]))
    plain = files.vectors_npy(spark, str(tmp_path / "a.npy"), rows=5)
    assert plain.rdd.getNumPartitions() == 5 and {r.gene_id: list(r.emb) for r in plain.collect()} == {str(i): v for i, v in enumerate(x.tolist())}
    held = files.vectors_npy(spark, str(tmp_path / "b.npz"), rows=10)
    assert held.rdd.getNumPartitions() == 3 and {r.gene_id: list(r.emb) for r in held.collect()} == {f"g{i}": v for i, v in enumerate(x.tolist())}
    named = files.vectors_npy(spark, str(tmp_path / "b.npz"), [f"n{i}" for i in range(23)], rows=10)
    assert {r.gene_id: list(r.emb) for r in named.collect()} == {f"n{i}": v for i, v in enumerate(x.tolist())}
    np.save(tmp_path / "none.npy", np.empty((0, 4)))
    assert files.vectors_npy(spark, str(tmp_path / "none.npy")).count() == 0
    np.savez(tmp_path / "odd.npz", a=np.arange(3))
    with pytest.raises(ValueError):
        split.Matrix(str(tmp_path / "odd.npz"))


def test_tables_in_ranges_of_rows(spark, tmp_path):
    path = str(tmp_path / "p.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE proteins AS SELECT 'p' || i AS protein_id, 'c' AS contig_id, 'b' AS bin_id, i::INTEGER AS start, i::INTEGER + 9 AS end_coord, CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand FROM range(250) t(i)")
        con.execute("DELETE FROM proteins WHERE start % 10 = 3")
        con.execute("CREATE VIEW annotations AS SELECT protein_id, 'pfam' AS source, 'PF' || start AS accession FROM proteins")
    columns = "protein_id AS gene_id, start"
    found = files._duckdb(spark, path, "proteins", columns, "gene_id string, start bigint", rows=60)
    assert found.rdd.getNumPartitions() == 5 and sorted(r.start for r in found.collect()) == [i for i in range(250) if i % 10 != 3]
    assert {(r.gene_id, r.strand) for r in files.duckdb_proteins(spark, path).filter("start < 2").collect()} == {("p0", 1), ("p1", -1)}
    assert files.duckdb_annotations(spark, path, "pfam").count() == 225


def test_objects_of_a_document(spark, tmp_path):
    rng = np.random.default_rng(2)
    odd = ['"', "\\", "}{", "]},", "é中", '\\"', "plain"]
    blocks = [{"id": i, "text": "".join(rng.choice(odd, 4)), "inner": {"blocks": [{"id": -1}, [1, 2]], "landscape": {"blocks": []}}, "n": [1.5] * int(rng.integers(0, 4))} for i in range(300)]
    for indent, ascii_ in ((None, True), (2, False)):
        path = str(tmp_path / f"l{indent}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"a": {"blocks": [{"id": 99}]}, "landscape": {"x": [[{"id": 98}]], "blocks": blocks, "y": {"blocks": [{"id": 97}]}}, "blocks": [{"id": 96}]}, f, indent=indent, ensure_ascii=ascii_)
        found = split.object_spans(path, ("landscape", "blocks"), 2_000)
        assert len(found) > 10
        reader = split.ObjectReader(path, ("landscape", "blocks"), 2_000)
        assert [json.loads(v) for p in reader.partitions() for (v,) in reader.read(p)] == blocks
        assert sorted((r.id, r.text) for r in files.landscape(spark, path, size=2_000).collect()) == [(b["id"], b["text"]) for b in blocks]
    (tmp_path / "none.json").write_text('{"landscape": {"blocks": []}}')
    assert split.object_spans(str(tmp_path / "none.json"), ("landscape", "blocks"), 10) == []


def test_alignments_split(spark, tmp_path):
    lines = ["# header", "## not a block"]
    for i in range(40):
        lines += [f"## Alignment {i}: score=1 e_value=0 N=2 c{i}&d{i} {'minus' if i % 3 else 'plus'}", f" {i}-  0:\ta{i}\tb{i}\t  1e-5", f" {i}-  1:\tx{i}\ty{i}\t  0"]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    got = files.collinearity(spark, str(tmp_path / "m.txt")).orderBy("alignment", "row").collect()
    assert [(r.alignment, r.gene_a, r.gene_b) for r in got] == [t for i in range(40) for t in ((i, f"a{i}", f"b{i}"), (i, f"x{i}", f"y{i}"))]
    assert {(r.alignment, r.contig_a, r.orientation) for r in got} == {(i, f"c{i}", -1 if i % 3 else 1) for i in range(40)}
    (tmp_path / "n.txt").write_text("\n".join(lines[2:]))  # begins with a block
    assert files.collinearity(spark, str(tmp_path / "n.txt")).count() == 80


def test_half_floats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"g{i}", [i / 4, -1.5], i / 8) for i in range(30)], "gene_id string, emb array<float>, x double").repartition(3)
    path = str(tmp_path / "h")
    files.half_float_output(df, path)
    import pyarrow.parquet as pq

    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    assert sorted(os.listdir(path)) == sorted([*parts, "_SUCCESS"]) and len(parts) == 3
    told = {r["gene_id"]: (r["emb"], r["x"]) for n in parts for r in pq.read_table(f"{path}/{n}").to_pylist()}
    assert told == {f"g{i}": ([i / 4, -1.5], i / 8) for i in range(30)} and str(pq.read_schema(f"{path}/{parts[0]}").field("x").type) == "halffloat"
    wide = files.half_float_parquet(spark, [f"{path}/{n}" for n in parts], ["x"])
    assert {r.gene_id: list(r.emb) for r in wide.collect()} == {f"g{i}": [i / 8] for i in range(30)}


def test_a_lost_task_leaves_nothing(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"gene_id": ["a"], "x": pa.array([0.5], pa.float64())})
    path = str(tmp_path / "h")
    writer = split.HalfFloatWriter(path)
    kept, _ = writer.write(iter([batch])), writer.write(iter([batch]))  # the second attempt is never reported
    writer.commit([kept, None])
    assert sorted(os.listdir(path)) == sorted([*kept.names, "_SUCCESS"])
    again = split.HalfFloatWriter(str(tmp_path / "n"))
    again.write(iter([batch]))
    again.abort([None])
    assert os.listdir(tmp_path / "n") == []
