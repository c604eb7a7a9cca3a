"""Operators and sources that no query reaches, against small references of their own."""

import json
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.functions import align
from locusweave.operators import communities, evaluation, explorer, genes, graph, regions, shingles, statistics, store, tokens
from locusweave.sources import files


def vectors(spark, x):
    return spark.createDataFrame([(f"g{i}", [float(v) for v in r]) for i, r in enumerate(x)], "gene_id string, emb array<float>")


def direct_modularity(edges, label):
    m = sum(w for *_, w in edges)
    k = {}
    for u, v, w in edges:
        k[u], k[v] = k.get(u, 0) + w, k.get(v, 0) + w
    return sum(w / m for u, v, w in edges if label[u] == label[v]) - sum((sum(k[n] for n in k if label[n] == c) / (2 * m)) ** 2 for c in set(label.values()))


def test_communities_of_a_ring_of_cliques(spark):
    edges = [(8 * c + i, 8 * c + j, 1.0) for c in range(6) for i, j in combinations(range(8), 2)] + [(8 * c + 7, 8 * ((c + 1) % 6), 1.0) for c in range(6)]
    edges = [(min(u, v), max(u, v), w) for u, v, w in edges]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    found = graph.modularity_communities(df)
    label = {r.node: r.community for r in found.collect()}
    assert label == {n: n // 8 * 8 for n in range(48)}
    assert abs(graph.modularity(df, found) - direct_modularity(edges, label)) < 1e-9
    assert len({r.root for r in graph.connected_components(df).collect()}) == 1


def test_communities_are_near_the_best_partition(spark):
    """All partitions of a small graph are tried."""
    rng = random.Random(1)
    edges = [(i, j, float(rng.randint(1, 3))) for i, j in combinations(range(8), 2) if rng.random() < (0.8 if i // 4 == j // 4 else 0.15)]

    def partitions(n):
        def grow(i, groups):
            if i == n:
                yield dict(enumerate(groups))
                return
            for g in range(max(groups, default=-1) + 2):
                yield from grow(i + 1, [*groups, g])

        return grow(0, [])

    best = max(direct_modularity(edges, p) for p in partitions(8))
    found = graph.modularity_communities(spark.createDataFrame(edges, "u long, v long, w double"))
    label = {r.node: r.community for r in found.collect()}
    assert direct_modularity(edges, label) >= best - 0.03
    assert all(min(n for n in label if label[n] == c) == c for c in set(label.values()))


def test_shrinkage_follows_its_formula(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((60, 10)) * np.linspace(0.5, 2, 10)).astype(np.float32).astype(float)
    y = x - x.mean(axis=0)
    s = y.T @ y / len(y)
    mu = np.trace(s) / 10
    gap = ((s - mu * np.eye(10)) ** 2).sum() / 10
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in y) / 10 / len(y) ** 2
    got = shingles.ledoit_wolf(vectors(spark, x))
    assert abs(got - min(noise, gap) / gap) < 1e-6 and 0 < got < 1
    shrunk = (1 - got) * s + got * mu * np.eye(10)
    share = shingles.pca(vectors(spark, x), 3, shrink="auto")[2]
    assert np.allclose(share, np.sort(np.linalg.eigvalsh(shrunk))[::-1][:3] / np.trace(shrunk), atol=1e-6)


def test_rotation_lowers_the_error_of_codes(spark):
    from locusweave.operators.nearest import ProductCode

    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 2)) @ rng.standard_normal((2, 16))  # all dimensions depend on two
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    turn = shingles.optimised_rotation(vectors(spark, x), 4)
    assert np.allclose(turn @ turn.T, np.eye(16), atol=1e-6)

    def error(v):
        code = ProductCode(v.astype(float))
        return float(((code.decode(code.encode(v.astype(float))) - v) ** 2).sum())

    assert error(x @ turn.T) <= 1.02 * error(x)


def test_mutual_information_against_all_permutations(spark):
    a, b = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]

    def mutual(x, y):
        n = len(x)
        return sum(x.count(i) and y.count(j) and (k := sum(p == i and q == j for p, q in zip(x, y))) and k / n * math.log(n * k / (x.count(i) * y.count(j))) or 0 for i in set(x) for j in set(y))

    from itertools import permutations

    every = [mutual(a, list(p)) for p in permutations(b)]
    entropy = lambda x: -sum(x.count(i) / len(x) * math.log(x.count(i) / len(x)) for i in set(x))
    expected = sum(every) / len(every)
    want = (mutual(a, b) - expected) / ((entropy(a) + entropy(b)) / 2 - expected)
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert abs(evaluation.adjusted_mutual_information(df, "a", "b") - want) < 1e-9


def all_alignments(a, b):
    if not a and not b:
        yield []
    if a and b:
        for rest in all_alignments(a[1:], b[1:]):
            yield [(a[0], b[0]), *rest]
    if a:
        for rest in all_alignments(a[1:], b):
            yield [(a[0], None), *rest]
    if b:
        for rest in all_alignments(a, b[1:]):
            yield [(None, b[0]), *rest]


def test_identity_against_all_alignments(spark):
    rng = random.Random(7)

    def score(columns):
        total, before = 0.0, None
        for x, y in columns:
            gap = "a" if x is None else "b" if y is None else None
            total += (x == y) if gap is None else -0.5 if gap == before else -1.0
            before = gap
        return total

    pairs = [("".join(rng.choices("ACD", k=rng.randint(1, 5))), "".join(rng.choices("ACD", k=rng.randint(1, 5)))) for _ in range(40)]
    df = spark.createDataFrame([*pairs, ("", "A"), (None, "A")], "a string, b string")
    for r in align.with_identity(df, "a", "b").collect():
        if not r.a:
            assert r.identity == 0
            continue
        every = [(score(c), sum(x == y for x, y in c) / len(c)) for c in all_alignments(r.a, r.b)]
        best = max(s for s, _ in every)
        assert any(abs(s - best) < 1e-9 and abs(i - r.identity) < 1e-9 for s, i in every), (r.a, r.b, r.identity)


def test_cluster_consensus(spark):
    rows = [(1, b, i, s, t) for b in range(4) for i, (t, s) in enumerate([("x", 1), ("x", 1), ("Ribosomal_L5_C", -1), ("y", 1)])] + [(1, 0, 9, 1, "rare"), (2, 7, 0, None, "z")]
    told, pairs = tokens.cluster_consensus(spark.createDataFrame(rows, "c int, b int, i int, s int, token string"), "c", "b", "i", "s")
    got = {(r.c, r.token): (r.df, r.n_occ, round(r.mean_pos, 4), r.fwd_frac, r.coverage) for r in told.collect()}
    assert got == {(1, "x"): (4, 4, 0.0, 1.0, 1.0), (1, "Ribosomal_L5"): (4, 4, 0.4583, 0.0, 1.0), (1, "y"): (4, 4, 0.9167, 1.0, 1.0), (2, "z"): (1, 1, 0.0, 1.0, 1.0)}
    assert sorted((r.token, r.next_token, r.support, r.same_frac) for r in pairs.collect()) == [("Ribosomal_L5", "y", 4, 0.0), ("x", "Ribosomal_L5", 4, 0.0)]


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", other=np.zeros(2), emb=x, protein_ids=np.array(["p", "q", "r", "s"]))
    assert files.vector_files(str(tmp_path)) == [str(tmp_path / "a.npy"), str(tmp_path / "b.npz")]
    plain = files.vectors_npy(spark, str(tmp_path / "a.npy"), rows=3).collect()
    assert [(r.gene_id, list(r.emb)) for r in plain] == [(str(i), v.tolist()) for i, v in enumerate(x)]
    assert {r.gene_id: list(r.emb) for r in files.vectors_npy(spark, str(tmp_path / "b.npz")).collect()} == dict(zip("pqrs", x.tolist()))


def test_h5_needs_its_library(spark, tmp_path):
    try:
        import h5py
    except ImportError:
        with pytest.raises(RuntimeError):
            files.embeddings_h5(spark, str(tmp_path / "x.h5"))
        return
    with h5py.File(tmp_path / "x.h5", "w") as f:
        f["protein_ids"], f["embeddings"] = np.array([b"a", b"b"]), np.ones((2, 3))
    assert files.embeddings_h5(spark, str(tmp_path / "x.h5")).count() == 2


def test_raw_columns_are_folded(spark, tmp_path):
    spark.createDataFrame([("g", 1.0, 2.0)], "gene_id string, raw_000 double, raw_001 double").write.parquet(str(tmp_path / "r"))
    assert list(files.raw_embeddings(spark, str(tmp_path / "r")).first().raw) == [1.0, 2.0]


def test_block_and_cluster_csv(spark, tmp_path):
    layouts = {
        "chain": ("block_id,cluster_id,query_anchor_genes,target_anchor_genes", '1,4,"[""a"",""b""]","[""c""]"'),
        "windows": ("block_id,cluster_id,query_windows_json", "1,4,w1;w2"), "locus": ("block_id,cluster_id,query_locus", "1,4,g:c:1-2"),
    }
    for name, lines in layouts.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        rows = files.block_csv(spark, str(tmp_path / f"{name}.csv"))
        assert rows.first().layout == name
    assert files.block_csv(spark, str(tmp_path / "chain.csv")).first().query_anchor_genes == ["a", "b"]
    assert files.block_csv(spark, str(tmp_path / "windows.csv")).first().query_window_list == ["w1", "w2"]
    (tmp_path / "clusters.csv").write_text("cluster_id,size\n4,2\n5,9\n")
    assert [r.cluster_id for r in files.cluster_csv(spark, str(tmp_path / "clusters.csv"), rows).collect()] == [4]


def test_settings_merge(tmp_path):
    assert files.merge_config({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 5}, "e": 6}) == {"a": {"b": 1, "c": 5}, "d": 3, "e": 6}
    (tmp_path / "x.json").write_text(json.dumps({"a": {"b": 1}}))
    (tmp_path / "y.yaml").write_text("a:\n  c: 2\n")
    assert files.load_config(str(tmp_path / "x.json"), str(tmp_path / "y.yaml")) == {"a": {"b": 1, "c": 2}}


def test_exports(spark):
    rows = spark.createDataFrame([(i, float(i % 7), i / 100, 100 * i) for i in range(100)], "block_id int, score double, identity double, length int")
    out = explorer.export_best(rows, "score", "identity", "length", 5)
    assert sorted(r.block_id for r in out["high_identity"].collect()) == list(range(91, 100))
    assert sorted(r.block_id for r in out["longest"].collect()) == list(range(95, 100))
    assert sorted(r.block_id for r in out["top_score"].collect()) == [6, 13, 20, 27, 34]


def test_vectors_join_their_proteins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "gene_id string, start int")
    assert [r.gene_id for r in genes.join_embeddings(a, vectors(spark, np.ones((1, 2))).withColumn("gene_id", F.lit("y"))).collect()] == ["y"]


def test_best_cluster_and_search_recall(spark):
    s = spark.createDataFrame([("t", 1, 0.5, 1.0), ("t", 2, 0.8, 0.3), ("u", 3, 0.1, 0.1), ("u", 4, 0.1, 0.1)], "gt string, cluster int, j_og double, j_genome double")
    best = {r.gt: r.cluster for r in evaluation.best_cluster(s).collect()}
    assert best == {"t": max((1, 2), key=lambda c: {1: 0.7 * 0.5 + 0.3, 2: 0.7 * 0.8 + 0.09}[c]), "u": 3}
    found = spark.createDataFrame([("q", 1, "g1"), ("q", 3, "g2"), ("r", 2, "g1")], "query string, rank int, genome string")
    truth = spark.createDataFrame([("q", "g1"), ("q", "g2"), ("r", "g1"), ("r", "g9")], "query string, genome string")
    r = evaluation.search_recall(found, truth, [1, 2, 3]).first()
    assert (r.recall_1, r.recall_2, r.recall_3) == (0.25, 0.5, 0.75)


def test_pair_counts_densities_and_reassignment(spark):
    pairs = spark.createDataFrame([(1, "a", "c1", "b", "c2"), (1, "a", "c1", "b", "c3"), (2, "x", "c", "x", "d")], "cluster_id int, query_genome_id string, query_contig_id string, target_genome_id string, target_contig_id string")
    assert {r.cluster_id: (r.n_genomes, r.n_contigs) for r in explorer.pair_genome_counts(pairs).collect()} == {1: (2, 3), 2: (1, 2)}
    row = spark.createDataFrame([(6, 3, 12)], "n int, a int, b int").select(statistics.density("n", F.col("a"), F.col("b")).alias("two"), statistics.density("n", F.col("a")).alias("one")).first()
    assert (row.two, row.one) == (0.5, 2.0)
    blocks = spark.createDataFrame([(1, 5), (2, 6)], "block_id int, cluster_id int")
    moved = explorer.reassign(blocks, spark.createDataFrame([(2, 9)], "block_id int, new_cluster int"))
    assert {r.block_id: r.cluster_id for r in moved.collect()} == {1: 5, 2: 9}


def test_first_places_groups_and_diagonals(spark):
    seq = spark.createDataFrame([("k", 3, "x"), ("k", 1, "x"), ("k", 2, "y")], "key string, at int, token string")
    assert {r.token: r.at for r in tokens.first_occurrence(seq, "key", "at").collect()} == {"x": 1, "y": 2}
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {r.node: r.root for r in regions.view_groups(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    rng = random.Random(4)
    rows = [("line", i, i + 2) for i in range(8)] + [("noise", i, rng.randint(0, 200)) for i in range(8)] + [("two", 0, 0), ("two", 1, 1)]
    got = communities.robust_blocks(spark.createDataFrame(rows, "b string, q int, t int"), "b", "q", "t")
    assert [r.b for r in got.collect()] == ["line"]


def test_store_keeps_its_parts(spark, tmp_path):
    made = lambda *ids: spark.createDataFrame([(i, len(i)) for i in ids], "gene_id string, n int")
    s = store.GeneStore.create(made("a", "b"), str(tmp_path / "s"))
    part = tmp_path / "s" / s.parts[0]
    before = sorted(str(p) for p in part.iterdir())
    s = s.add(made("b", "cc"), "batch0").add(made("zz"), "batch0")
    assert s.version == 1 and sorted(str(p) for p in part.iterdir()) == before
    wider = s.add(spark.createDataFrame([("d", 1, "x")], "gene_id string, n int, more string"))
    rows = {r.gene_id: (r.n, r.more) for r in store.GeneStore.load(spark, str(tmp_path / "s")).genes.collect()}
    assert rows == {"a": (1, None), "b": (1, None), "cc": (2, None), "d": (1, "x")} and wider.version == 2


def test_stages_follow_their_key(spark, tmp_path):
    one, two = spark.range(3), spark.range(4)
    for df, key in ((one, "x"), (two, "y"), (two, "x")):
        got = store.stage(spark, str(tmp_path / "st"), lambda df=df: df, key=key)
    assert got.count() == 3
    one.write.parquet(str(tmp_path / "p"))
    first = store.input_digest(spark.read.parquet(str(tmp_path / "p")))
    assert first == store.input_digest(spark.read.parquet(str(tmp_path / "p"))) != store.input_digest(spark.read.parquet(str(tmp_path / "p")).filter("id > 0"))
    two.write.mode("overwrite").parquet(str(tmp_path / "p"))
    assert store.input_digest(spark.read.parquet(str(tmp_path / "p"))) != first


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    df = spark.createDataFrame([(1, "a", [1, 2], 0.5), (2, None, None, None)], "id int, name string, items array<int>, x double")
    for _ in range(2):
        store.write_sqlite({"t": df}, str(tmp_path / "x.db"), {"t": ["id"]}, batch=1)
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert db.execute("SELECT * FROM t ORDER BY id").fetchall() == [(1, "a", "[1,2]", 0.5), (2, None, None, None)]


def test_ordinal_ranges(spark):
    g = spark.createDataFrame([("s", "c", f"g{i}", 10 * i) for i in range(6)], "sample_id string, contig_id string, gene_id string, start int")
    r = spark.createDataFrame([(1, "s", "c", 2, 3), (2, "s", "c", 5, 4), (3, "s", "x", 0, 2), (4, "s", "c", 0, 0)], "range_id int, sample_id string, contig_id string, offset int, size int")
    got = {}
    for x in genes.genes_by_ordinal(g, r).collect():
        got.setdefault(x.range_id, []).append(x.gene_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["g2", "g3", "g4"], 2: ["g5"]}
