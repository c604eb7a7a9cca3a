import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from locusweave.operators import communities, evaluation, explorer, genes, intervals, regions, shingles


def test_trimmed_ids(spark):
    wanted = spark.createDataFrame([(1, "x_a_1"), (1, "a_1"), (2, "q")], "block_id int, name string")
    known = spark.createDataFrame([("a_1",), ("1",)], "gene_id string")
    assert {(r.name, r.gene_id, r.trim) for r in regions.match_trimmed_ids(wanted, known).collect()} == {("x_a_1", "a_1", 1), ("a_1", "a_1", 0)}


def test_stitching(spark):
    names = "block_id int, q_key string, q_start int, q_end int, t_key string, t_start int, t_end int"
    sink = spark.createDataFrame([(1, "a", 10, 12, "b", 5, 6)], names)
    held = spark.createDataFrame([(2, "a", 14, 20, "b", 8, 9), (3, "a", 15, 20, "b", 8, 9), (4, "a", 1, 9, "b", 5, 5), (5, "a", 11, 12, "c", 5, 6)], names)
    assert {(r.block_id, r.neighbour) for r in regions.stitch_sinks(sink, held).collect()} == {(1, 2), (1, 4)}


def test_locus_counts(spark):
    loci = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 50, 60)], "locus_id int, contig string, start int, end int")
    g = spark.createDataFrame([("a", "c", 5, 7), ("b", "c", 10, 30)], "gene_id string, contig string, start int, end int")
    assert {(r.locus_id, r.n_genes) for r in regions.locus_gene_counts(loci, g, 16).collect()} == {(1, 2), (2, 0)}


def test_comparative_edges(spark):
    names = "view int, id string, idx int, emb array<double>, domains array<string>"
    left = spark.createDataFrame([(1, "a", 0, [1.0, 0.0], ["x"]), (1, "b", 1, [0.0, 1.0], ["y"]), (2, "c", 0, [1.0, 0.0], [])], names)
    right = spark.createDataFrame([(1, "p", 0, [1.0, 0.1], ["x", "y"]), (1, "q", 1, [-1.0, 0.0], ["y"]), (2, "r", 0, [0.0, 1.0], [])], names)
    got = {(r.a, r.b): r.kind for r in regions.comparative_edges(left, right).collect()}
    assert got == {("a", "p"): "both", ("b", "q"): "pfam", ("c", "r"): "fallback"}


def test_best_hits_and_track_order(spark):
    names = "view int, id string, emb array<double>"
    up = spark.createDataFrame([(1, "a", [1.0, 0.0])], names)
    low = spark.createDataFrame([(1, "p", [1.0, 1.0]), (1, "q", [1.0, 0.1])], names)
    assert regions.best_hit_edges(up, low).first().b == "q"
    assert regions.track_order({("x", "y"): 0.9, ("y", "z"): 0.8, ("x", "z"): 0.1}, ["x", "y", "z"]) == ["y", "x", "z"]
    assert regions.track_order({}, []) == []


def test_joined_sets(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "z")], "set_id long, item string")
    assert {r.set_id: r.root for r in regions.sets_joined(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.set_id: r.root for r in regions.sets_joined(rows, 0.5, 2).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_token_clusters(spark):
    rows = [(d, t) for d, ts in {1: "abc", 2: "abd", 3: "xyz", 4: "xyw", 5: "q"}.items() for t in ts]
    df = spark.createDataFrame(rows, "doc long, token string")
    for how in ({}, {"communities": True}, {"min_shared": 2}):
        got = {r.doc: r.cluster_id for r in communities.token_clusters(df, 0.2, ban=None, **how).collect()}
        assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 0}


def test_mutual_information(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("b", "y"), ("c", "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    same = spark.createDataFrame([(x, x) for x, _ in rows], "a string, b string")
    assert math.isclose(evaluation.adjusted_mutual_information(same, "a", "b"), 1.0) and evaluation.adjusted_mutual_information(df, "a", "b") < 1
    assert math.isclose(evaluation.adjusted_rand(same, "a", "b").first().ari, 1.0)


def test_ranking_metrics(spark):
    scored = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 1), (0.1, 0)]
    r = evaluation.pair_metrics(spark.createDataFrame(scored, "score double, label int")).first()
    pos, neg = [s for s, y in scored if y], [s for s, y in scored if not y]
    assert math.isclose(r.roc_auc, sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_species(spark):
    blocks = spark.createDataFrame([(1, "g1", "g2"), (2, "g1", "g3")], "block_id int, query_genome string, target_genome string")
    samples = spark.createDataFrame([("g1", "E coli"), ("g2", "E fergusonii"), ("g3", "S enterica")], "sample_id string, species string")
    got = {r.block_id: (r.species_pair, r.is_cross_genus) for r in explorer.with_species(blocks, samples).collect()}
    assert got == {1: ("E coli-E fergusonii", False), 2: ("E coli-S enterica", True)}
    told = evaluation.pair_count_check(explorer.with_species(blocks, samples), {"E coli-E fergusonii": 1, "x": 2})
    assert Counter(r.ok for r in told.collect()) == {True: 1, False: 2}
    import pytest

    with pytest.raises(ValueError):
        explorer.with_species(blocks, samples.limit(1))


def test_star_schema(spark, sf_dir):
    from locusweave.plans.catalogue import genes_view

    g = genes_view(spark, sf_dir)
    blocks = spark.createDataFrame([(0, 1, 3, 2.5)], "block_id long, cluster_id int, n_anchors int, chain_score double")
    clusters = spark.createDataFrame([(1, 3.0)], "cluster_id int, mean_chain_length double")
    tables = explorer.star_schema(g, blocks, clusters, spark.createDataFrame([("v1", 0)], "gene_id string, block_id long"))
    explorer.register_views(tables)
    assert spark.sql("SELECT count(*) FROM genes JOIN genomes USING (genome_id)").first()[0] == g.count()
    assert tables["syntenic_blocks"].first().block_type == "small"
    assert genes.contig_rollup(g).agg({"gene_count": "sum"}).first()[0] == g.count()


def test_reciprocal_graph(spark):
    near = spark.createDataFrame([(1, 2, 0.9, 2), (2, 1, 0.9, 2), (1, 3, 0.8, 3), (3, 2, 0.7, 2)], "i long, j long, sim double, rank int")
    assert [(r.u, r.v, r.w) for r in communities.reciprocal_graph(near, 2).collect()] == [(1, 2, 0.9)]
    costs = spark.createDataFrame([(1, 2, 0.0)], "a long, b long, cost double")
    assert math.isclose(communities.reciprocal_graph(near, 2, costs=costs).first().w, 0.95)


def test_standardised_vectors(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((50, 4)) * [1, 10, 100, 1000]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, emb array<double>")
    got = np.array([r.emb for r in shingles.standardised(df.select("id", df.emb.cast("array<float>").alias("emb"))).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(got, z / np.linalg.norm(z, axis=1, keepdims=True), atol=1e-3)


def test_markers_and_coverage(spark):
    rows = [(1, "g1", "Ribosomal L2"), (1, "g2", None), (2, "g1", "x")]
    got = {r.cluster_id: (r.coverage, r.ribosomal_share, r.is_best) for r in evaluation.cluster_coverage(spark.createDataFrame(rows, "cluster_id int, genome string, annotation string"), ["g1", "g2"]).collect()}
    assert got == {1: (1.0, 0.5, True), 2: (0.5, 0.0, False)}


def test_overlaps_of_mixed_lengths(spark):
    """Rows of bins grow with the levels, not with the length; the pairs are those of a comparison of all."""
    rng = np.random.default_rng(5)
    made = lambda n, top: [("c", int(s), int(s + rng.integers(0, 8 ** rng.integers(0, 6)))) for s in rng.integers(-500, top, n)]
    left, right = made(120, 40_000) + [("c", 0, 10**8), ("d", 5, 4)], made(150, 40_000) + [("c", -(10**8), 10**8), ("d", 0, 9)]
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "a int, k string, l_start long, l_end long")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "b int, k string, r_start long, r_end long")
    got = sorted((r.a, r.b) for r in intervals.overlap_join(a, b, ["k"], 4).collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    level = F.array(F.struct(intervals._level("l_start", "l_end", 16).alias("m"), F.lit(0).alias("side")))
    assert intervals._placed(a.filter("l_end > 1000000"), "l_start", "l_end", 16, level).count() <= 2


def test_greedy_pairs_equal_the_walk_over_all_pairs():
    rng = random.Random(5)
    for _ in range(60):
        side = lambda p, n: [(f"{p}{k}", rng.randrange(12), frozenset(rng.sample("vwxyz", rng.randrange(1, 4)))) for k in range(n)]  # noqa: E731, B023
        a, b = side("a", rng.randrange(0, 14)), side("b", rng.randrange(0, 14))
        walk = sorted((-len(d & e), abs(i - j), g, h) for g, i, d in a for h, j, e in b if d & e)
        met, taken = {}, set()
        for _, _, g, h in walk:
            if g not in met and h not in taken:
                met[g] = h
                taken.add(h)
        assert dict(regions.greedy_pairs(a, b)) == met


def test_comparative_edges_keep_to_their_pieces(spark, monkeypatch):
    """Neither all pairs of a view nor all pairs with a shared domain are listed; pieces of a view give what the whole gives."""
    rng = np.random.default_rng(2)
    side = lambda p, n: [(1, f"{p}{k}", k, [float(x) for x in rng.standard_normal(4)], ["x"]) for k in range(n)]
    names = "view int, id string, idx int, emb array<double>, domains array<string>"
    a, b = side("a", 60), side("b", 50)
    want = {(g[1], h[1]) for g in a for h in b if np.dot(g[3], h[3]) / (np.linalg.norm(g[3]) * np.linalg.norm(h[3])) >= 0.5}
    monkeypatch.setattr(regions, "PIECE_ROWS", 16)
    found = regions.comparative_edges(spark.createDataFrame(a, names), spark.createDataFrame(b, names), 0.5).collect()
    assert {(r.a, r.b) for r in found if r.kind != "pfam"} == want
    assert {(r.a, r.b) for r in found if r.kind != "cos"} == {(f"a{k}", f"b{k}") for k in range(50)}
    sent, plain = [], regions.graph.written
    monkeypatch.setattr(regions.graph, "written", lambda df: sent.append(df) or plain(df))
    regions.comparative_edges(spark.createDataFrame(a, names), spark.createDataFrame(b, names), 0.5)
    assert "CartesianProduct" not in (plan := sent[0]._jdf.queryExecution().toString()) and plan.count("FlatMapCoGroupsInPandas") >= 2
