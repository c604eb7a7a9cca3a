import random

import pytest

from locusweave.operators import clusters, graph, intervals, numbering

NAMES = "block_id long, query_genome string, target_genome string, query_contig string, target_contig string, query_start int, query_end int, target_start int, target_end int, n_anchors int, orientation int"


def blocks(spark, rows):
    return spark.createDataFrame([(i, a, b, "c1", "c2", s, e, u, v, e - s + 1, 1) for i, a, s, e, b, u, v in rows], NAMES)


def drawn(seed, n=60, genomes=4, places=40):
    rng = random.Random(seed)
    side = lambda g: (f"{g}{rng.randint(1, genomes)}", s := rng.randint(0, places), s + rng.randint(1, 9))
    return [(i, *side("x"), *side("y")) for i in range(n)]


def by_sets(rows, tau, k, support):
    """Clusters from the sets of places that blocks cover, all pairs compared."""
    cover = {i: {(a, p) for p in range(s, e + 1)} | {(b, p) for p in range(u, v + 1)} for i, a, s, e, b, u, v in rows}
    near = {i: sorted(((-len(x & y) / len(x | y), j) for j, y in cover.items() if j != i and len(x & y) >= tau * len(x | y) and x & y))[:k] for i, x in cover.items()}
    ahead = {i: {j for _, j in v} for i, v in near.items()}
    group = {i: i for i in cover}
    for i in cover:
        for j in ahead[i]:
            if i in ahead[j] and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {x: low if g == high else g for x, g in group.items()}
    wide = sorted(g for g in set(group.values()) if len({name for x in cover if group[x] == g for name, _ in cover[x]}) >= support)
    return {x: wide.index(g) + 1 if g in wide else 0 for x, g in group.items()}


@pytest.mark.parametrize("seed,tau,k,support", [(1, 0.3, 5, 2), (2, 0.1, 2, 3), (3, 0.2, 1, 2), (4, 0.25, 4, 4)])
def test_clusters_against_sets(spark, seed, tau, k, support):
    rows = drawn(seed)
    got = {r.block_id: r.cluster_id for r in clusters.cluster_blocks(blocks(spark, rows), tau, k, support).collect()}
    want = by_sets(rows, tau, k, support)
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_jaccard_against_gene_sets(spark):
    rng = random.Random(5)
    rows = [(i, f"g{rng.randint(1, 3)}", s := rng.randint(0, 30), s + rng.randint(0, 9), f"h{rng.randint(1, 3)}", u := rng.randint(0, 30), u + rng.randint(0, 9)) for i in range(40)]
    sides = intervals.block_sides(blocks(spark, rows)).withColumnRenamed("block_id", "id")
    got = {(r.u, r.v): r.w for r in intervals.jaccard_edges(sides, ["genome", "contig"], 0.0001, 4).collect()}
    sets = {i: {(a, "c1", p) for p in range(s, e + 1)} | {(b, "c2", p) for p in range(u, v + 1)} for i, a, s, e, b, u, v in rows}
    want = {(i, j): len(x & y) / len(x | y) for i, x in sets.items() for j, y in sets.items() if i < j and x & y}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}


def one_by_one(candidates, sizes):
    """The merge rule, step by step, on lists."""
    order, best = [], {}
    for small, large, shared in sorted(candidates, key=lambda c: (min(c[:2]), max(c[:2]), c[0])):
        if small not in best:
            order.append(small)
            best[small] = (large, shared)
        elif shared > best[small][1]:
            best[small] = (large, shared)
    name = {c: c for c in sizes}
    for small in order:
        a, b = name[small], name[best[small][0]]
        if a != b:
            gone, kept = (a, b) if sizes[a] <= sizes[b] else (b, a)
            name = {c: kept if n == gone else n for c, n in name.items()}
    return {c: n for c, n in name.items() if c != n}


@pytest.mark.parametrize("seed", range(4))
def test_merge_rule_against_steps(spark, seed):
    rng = random.Random(seed)
    sizes = {c: rng.randint(1, 6) for c in range(1, 31)}
    pairs = {(a, b) if (sizes[a], a) <= (sizes[b], b) else (b, a) for a, b in (rng.sample(range(1, 31), 2) for _ in range(25))}
    rows = [(a, b, rng.randint(1, 4)) for a, b in pairs]
    got = clusters.resolve_merges(spark.createDataFrame(rows, "small int, large int, large_shared long"), spark.createDataFrame(list(sizes.items()), "cluster int, n long"))
    assert {r.child: r.parent for r in got.collect()} == one_by_one(rows, sizes)


def test_no_candidates_no_merges(spark):
    none = clusters.resolve_merges(spark.createDataFrame([], "small int, large int, large_shared long"), spark.createDataFrame([], "cluster int, n long"))
    assert none.count() == 0


def test_contained_cluster_merges(spark):
    rows = [(i, "g1", 0, 9, f"g{i + 2}", 0, 9) for i in range(2)] + [(i + 2, "g1", 1, 9, f"g{i + 2}", 1, 9) for i in range(2)]
    named = blocks(spark, rows).join(spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "block_id long, cluster_id int"), "block_id")
    out, merged = clusters.merge_contained(named)
    assert [tuple(r) for r in merged.collect()] == [(2, 1)] and {r.cluster_id for r in out.collect()} == {1}


def test_merge_chains_and_cycles(spark):
    rows = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001)]
    got = {r.child: (r.parent, r.root, r.depth) for r in clusters.merge_hierarchy(spark.createDataFrame(rows, "child int, parent int")).collect()}
    assert got == {i: (i + 1, 300, 300 - i) for i in range(1, 300)} | {1000: (1001, 1001, 1)}
    with pytest.raises(ValueError):
        clusters.merge_hierarchy(spark.createDataFrame([(1, 2), (2, 1)], "child int, parent int"), rounds=4)


def test_numbers_follow_a_global_order(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(7)
    got = sorted(tuple(r) for r in numbering.running_total(numbering.numbered_rows(df, ["a", "b"], "n", 5), ["a", "b"], "v", "t").collect())
    total = 0
    for n, ((a, b, v), r) in enumerate(zip(sorted(rows), got)):
        assert r == (a, b, v, 5 + n, total)
        total += v


def test_summary(spark):
    named = blocks(spark, [(0, "g1", 0, 1, "g2", 3, 4)]).join(spark.createDataFrame([(0, 1)], "block_id long, cluster_id int"), "block_id")
    r = clusters.cluster_summary(named).first()
    assert (r.size, r.genome_support, r.genes) == (1, 2, {"g1": ["c1:0", "c1:1"], "g2": ["c2:3", "c2:4"]})


def test_core_and_triangles(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)], "u long, v long, w double")
    assert {(r.u, r.v): r.triangles for r in graph.triangle_support(e).collect()} == {(1, 2): 1, (2, 3): 1, (1, 3): 1, (3, 4): 0}
    assert {(r.u, r.v) for r in graph.k_core(e, 2).collect()} == {(1, 2), (2, 3), (1, 3)}
    labels = {r.node: r.label for r in graph.label_propagation(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "node long"), e).collect()}
    assert len(set(labels.values())) == 1
