"""The store: commits, writers that meet, and the index that follows additions."""

import numpy as np
import pytest

from locusweave.operators import nearest
from locusweave.operators.store import GeneStore


def genes(spark, ids, dim=8, seed=0, centres=6):
    """Vectors around some centres; a gene has the same vector whatever table it is in."""
    at = np.random.default_rng(seed).standard_normal((centres, dim))
    rows = [(f"g{i}", "s", [float(x) for x in at[i % centres] + 0.2 * np.random.default_rng(1000 + i).standard_normal(dim)]) for i in ids]
    return spark.createDataFrame(rows, "gene_id string, sample_id string, emb array<float>")


def asked(table):
    return table.selectExpr("xxhash64(gene_id) AS id", "emb AS v")


def told(df):
    return sorted((r.i, r["rank"], r.gene_id, r.sim) for r in df.collect())


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    first = GeneStore.create(genes(spark, range(3)), path)
    other = GeneStore.load(spark, path)
    first.add(genes(spark, range(2, 6)))
    last = other.add(genes(spark, range(4, 8)))  # begun on the older commit
    assert last.version == 2 and sorted(r.gene_id for r in GeneStore.load(spark, path).genes.collect()) == [f"g{i}" for i in range(8)]


def test_a_broken_commit_is_passed_over(spark, tmp_path):
    path = tmp_path / "s"
    GeneStore.create(genes(spark, range(3)), str(path))
    (path / "commits" / "00000001.json").write_text('{"parts": [')
    store = GeneStore.load(spark, str(path))
    assert store.version == 0 and store.add(genes(spark, range(5))).version == 2
    assert GeneStore.load(spark, str(path)).genes.count() == 5


def test_an_empty_store(spark, tmp_path):
    store = GeneStore.load(spark, str(tmp_path / "none"))
    assert store.parts == [] and store.genes.count() == 0
    with pytest.raises(ValueError):
        store.search(asked(genes(spark, [1])), 2)
    grown = GeneStore.create(genes(spark, []), str(tmp_path / "s")).build_index()
    assert grown.search(asked(genes(spark, [1])), 2).count() == 0
    assert grown.add(genes(spark, range(40))).search(asked(genes(spark, [1])), 1).first().gene_id == "g1"


def test_the_index_follows_additions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 30)
    monkeypatch.setattr("locusweave.operators.store.CELL_TIMES", 1)
    first, more = genes(spark, range(0, 300)), genes(spark, range(250, 700))
    store = GeneStore.create(first, str(tmp_path / "s")).build_index()
    before = store.cells()
    grown = store.add(more)
    fresh = GeneStore.create(genes(spark, range(700)), str(tmp_path / "f")).build_index()
    queries = asked(genes(spark, range(0, 800, 7)))
    told_cells = []
    got = told(grown.search(queries, 6, told_cells))
    assert got == told(fresh.search(queries, 6)) == told(GeneStore.load(spark, str(tmp_path / "s")).search(queries, 6))
    plain = nearest.nearest_exact(queries.selectExpr("id", "CAST(v AS array<double>) AS v"), asked(genes(spark, range(700))).selectExpr("id", "CAST(v AS array<double>) AS v"), 6)
    assert [(i, r, s) for i, r, _, s in got] == sorted((r.i, r["rank"], r.sim) for r in plain.collect())
    after = grown.cells()
    assert len(after.centre) > len(before.centre) and after.rows.sum() == 700  # overfull cells were split
    assert told_cells[0]["spared"] > 0
    kept = [n for n in store.state["index"]["files"] if n in grown.state["index"]["files"]]
    assert kept == store.state["index"]["files"]  # files of other cells stay as they are
    small = grown.compact()
    assert len(small.parts) == 1 == len(small.state["index"]["files"]) and told(small.search(queries, 6)) == got
    assert small.vacuum() and told(GeneStore.load(spark, str(tmp_path / "s")).search(queries, 6)) == got and small.vacuum() == []


def test_additions_read_keys_alone(spark, tmp_path):
    """An addition does not read the rows of the store: they may be out of reach."""
    import shutil

    store = GeneStore.create(genes(spark, range(20)), str(tmp_path / "s"))
    shutil.move(str(tmp_path / "s" / store.parts[0]), str(tmp_path / "away"))
    grown = store.add(genes(spark, range(15, 25)))
    shutil.move(str(tmp_path / "away"), str(tmp_path / "s" / store.parts[0]))
    assert grown.genes.count() == 25


def test_unstructured_vectors_are_searched_by_tiles(spark, tmp_path, monkeypatch):
    """Every query moved to nearly every cell, a copy of its vector for each: disk grew with the square of the store."""
    rng = np.random.default_rng(4)
    rows = [(f"g{i}", [float(x) for x in rng.standard_normal(24)]) for i in range(400)]
    table = spark.createDataFrame(rows, "gene_id string, emb array<float>")
    monkeypatch.setattr(nearest, "CELL_ROWS", 30)
    store = GeneStore.create(table, str(tmp_path / "s")).build_index()
    queries = asked(table)
    as_double = queries.selectExpr("id", "CAST(v AS array<double>) AS v")
    want = sorted((r.i, r["rank"], r.sim) for r in nearest.nearest_exact(as_double, as_double, 5).collect())
    moved = []
    meet, nearest_exact = nearest.meet_cells, nearest.nearest_exact
    monkeypatch.setattr(nearest, "meet_cells", lambda asked, *rest, **more: moved.append(sum(nearest.visits(asked).values())) or meet(asked, *rest, **more))
    monkeypatch.setattr(nearest, "nearest_exact", lambda *a, **b: moved.append(0) or nearest_exact(*a, **b))
    for rows_of_tiles in (50_000, 100):  # the first round goes to cells; or nothing does
        monkeypatch.setattr(nearest, "TILED_ROWS", rows_of_tiles)
        moved.clear()
        assert [(i, r, s) for i, r, _, s in told(store.search(queries, 5))] == want
        live = int((store.cells().rows > 0).sum())
        assert 0 in moved and sum(moved) < 0.7 * 400 * live
    assert not any(moved)
