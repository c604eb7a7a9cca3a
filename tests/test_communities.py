"""Caps of degrees against the sequential rules, and the composed clustering of blocks."""

import random

import pytest

from locusweave.operators import communities, evaluation, explorer, graph
from locusweave.sources import files


def walked(edges, cap):
    degree, kept = {}, set()
    for u, v, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if degree.get(u, 0) < cap and degree.get(v, 0) < cap:
            degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
            kept.add((u, v))
    return kept


def of_either(edges, cap):
    kept = set()
    for node in {x for e in edges for x in e[:2]}:
        own = sorted((e for e in edges if node in e[:2]), key=lambda e: (-e[2], e[1] if e[0] == node else e[0]))
        kept |= {e[:2] for e in own[:cap]}
    return kept


@pytest.mark.parametrize("kind,cap", [("random", 3), ("ties", 2), ("chain", 1)])
def test_caps_equal_the_sequential_rules(spark, kind, cap):
    rng = random.Random(3)
    edges = {
        "random": [(u, v, rng.random()) for u in range(14) for v in range(u + 1, 14) if rng.random() < 0.5],
        "ties": [(u, v, float(rng.randint(1, 2))) for u in range(8) for v in range(u + 1, 8)],
        "chain": [(i, i + 1, float(i)) for i in range(5)],  # each edge waits for the next one
    }[kind]
    df = spark.createDataFrame(edges, "u long, v long, w double").repartition(3)
    assert {(r.u, r.v) for r in graph.greedy_cap(df, cap).collect()} == walked(edges, cap)
    assert {(r.u, r.v) for r in graph.either_cap(df, cap).collect()} == of_either(edges, cap)
    assert graph.greedy_cap(df.limit(0), 2).count() == 0


def test_block_communities(spark):
    rng = random.Random(5)
    anchors, rows = [], []
    for b in range(24):
        group = b // 8
        n = 8 if b % 8 < 6 or b == 7 else 4
        anchors += [(b, i, i + (rng.randint(0, 200) if b == 7 else 0)) for i in range(n)]  # block 7 keeps to no diagonal
        rows += [(b, f"{group}-{i}") for i in rng.sample(range(12), 9)] + [(b, "common"), (b, f"own{b}")]
    told = communities.block_communities(spark.createDataFrame(anchors, "doc long, q int, t int"), spark.createDataFrame(rows, "doc long, token string"), tau=0.1, k=6)
    found = {r.doc: r.cluster_id for r in told.collect()}
    assert len(found) == 24 and found[7] == 0
    ids = [{found[b] for b in range(8 * g, 8 * g + 8) if b != 7} - {0} for g in range(3)]
    assert all(ids) and not any(a & b for i, a in enumerate(ids) for b in ids[i + 1 :])
    sizes = [sum(c == n for c in found.values()) for n in range(1, max(found.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True)


def test_communities_that_need_more_sweeps(spark):
    """A long path with weights that rise: labels travel far, the result is a fixed point of label propagation."""
    n = 12
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "u long, v long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "node long")
    with pytest.raises(RuntimeError):
        graph.label_propagation(nodes, edges, rounds=2)
    with pytest.raises(RuntimeError):
        graph.modularity_communities(edges, sweeps=1)


def test_match_rates(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "gt long, pred string")
    told = evaluation.match_rates(found, 5, 4).first()
    assert (told.recall, told.precision, told.fragmentation_rate, told.merge_rate) == (3 / 5, 3 / 4, 1 / 3, 1 / 3)


def test_degree_cap(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (1, 3, 2.0), (2, 3, 1.0)], "u long, v long, w double")
    assert {(r.u, r.v) for r in graph.degree_cap(edges, 1).collect()} == {(1, 2)}


def test_cluster_types(spark):
    rows = spark.createDataFrame([(2.0, 50), (7.0, 500), (20.0, 5000)], "mean double, n int")
    got = rows.select(explorer.cluster_type("mean").alias("a"), explorer.cluster_type(size="n").alias("b")).collect()
    assert [r.a for r in got] == ["small", "medium", "large"] == [r.b for r in got]


def test_contig_stats(spark):
    contigs = spark.createDataFrame([("s", "c", "GGCCAT"), ("s", "d", "AT")], "sample_id string, contig_id string, seq string")
    assert [(r.contig_id, r.length, round(r.gc, 3)) for r in files.contig_stats(contigs).orderBy("contig_id").collect()] == [("c", 6, 0.667), ("d", 2, 0.0)]


def test_similarity_packs_its_tables(spark, monkeypatch):
    """Checkpoints are not packed and took several times the input on disk."""
    from locusweave.operators import tokens

    rows = spark.createDataFrame([(d, t) for d, ts in ((1, "abcde"), (2, "abcde"), (3, "xyz")) for t in ts], "doc long, token string")
    monkeypatch.setattr(tokens, "cut", None)
    assert [(r.a, r.b, round(r.jaccard, 9)) for r in tokens.weighted_jaccard(rows, tau=0.8).collect()] == [(1, 2, 1.0)]


@pytest.mark.parametrize("common, pairs, candidates", [(200_000, 1 << 16, 1_000_000), (12, 3, 0), (0, 1, 10)])
def test_similar_sets_against_all_pairs(spark, monkeypatch, common, pairs, candidates):
    """A row for each token of each document, and for each token of each candidate pair, was written or shuffled: several times the input on disk."""
    import math
    import random

    from locusweave.operators import tokens

    rng = random.Random(3)
    docs = {}
    for d in range(0, 240, 4):
        base = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(3, 30))]
        for e in range(4):  # near copies; a token of its own now and then
            docs[d + e] = frozenset(["all", *rng.sample(base, max(1, len(base) - rng.randint(0, 2))), *([f"own{d + e}"] if e == 3 else [])])
    docs |= dict.fromkeys(range(240, 250), frozenset(["all"]))
    df = {}
    for ts in docs.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + len(docs) / n) for t, n in df.items()}
    some = [d for d in docs if d % 7]
    weight = lambda ts: sum(idf[t] for t in ts)
    want = {(a, b): round(weight(docs[a] & docs[b]) / weight(docs[a] | docs[b]), 9) for a in some for b in some if a < b}
    want = {k: w for k, w in want.items() if w >= 0.8}
    sizes, put = [], tokens.written
    monkeypatch.setattr(tokens, "written", lambda *a, **b: (made := put(*a, **b), sizes.append(made.count()))[0])
    monkeypatch.setattr(tokens, "COMMON", common, raising=False)
    monkeypatch.setattr(tokens, "PAIRS", pairs, raising=False)
    monkeypatch.setattr(tokens, "CANDIDATES", candidates, raising=False)
    rows = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, token string")
    found = tokens.weighted_jaccard(rows, tau=0.8, among=spark.createDataFrame([(d,) for d in some], "doc long"))
    assert {(r.a, r.b): round(r.jaccard, 9) for r in found.collect()} == want and len(want) > 100
    assert max(sizes) < sum(map(len, docs.values()))


def test_classes_of_equal_sets(spark):
    """Rows of one document are one set; rows of single documents stay as they are."""
    from locusweave.operators import tokens

    for rows in ([(1, ["b", "a"]), (2, ["a", "b"]), (5, ["c"])], [(1, ["b"]), (1, ["a"]), (2, ["a", "b"]), (5, ["c"])]):
        listed = tokens.single_lists(spark.createDataFrame(rows, "doc long, tokens array<string>"))
        assert {tuple(r) for r in tokens.set_classes(listed).collect()} == {(1, 1, 2), (2, 1, 2), (5, 5, 1)}


def test_most_alike_lists_no_pairs(spark, monkeypatch):
    """All documents with a token in common were joined: a table of all pairs.  Tiles send k rows a document and the best are those of all pairs."""
    import math
    import random

    from locusweave.operators import graph, tokens

    rng = random.Random(5)
    docs = {d: frozenset(["all", *(f"t{rng.randrange(40)}" for _ in range(rng.randint(1, 9)))]) for d in range(150)} | dict.fromkeys(range(150, 260), frozenset("xyz"))
    rows = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, token string")
    df = {}
    for ts in docs.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + len(docs) / n) for t, n in df.items()}
    monkeypatch.setattr(tokens, "TILE_DOCS", 64)
    monkeypatch.setattr(tokens, "MEETINGS", 500)
    for size, least in ((8 << 20, 1), (150, 1), (320, 2)):
        monkeypatch.setattr(tokens, "TILE_TOKENS", size)
        sets, n, entries = tokens.token_sets(tokens.token_lists(rows))
        found = tokens.most_alike(sets, n, entries, 3, 0.3, least).cache()
        tiles = max(math.ceil(entries / size), 4)
        assert n == len(docs) and found.count() <= 3 * n * (tiles // 2 + 2) < n * (n - 1) // 2
        want = {}
        for a, x in docs.items():
            near = [(round(sum(idf[t] for t in x & y) / sum(idf[t] for t in x | y), 9), b) for b, y in docs.items() if a != b and len(x & y) >= least]
            want[a] = sorted(((-w, b) for w, b in near if w >= 0.3))[:3]
        edges = {(a, b): -w for a in want for w, b in want[a] if a < b and any(c == a for _, c in want[b])}
        got = {(r.u, r.v): round(r.w, 9) for r in graph.mutual_best(found, 3).collect()}
        assert got == edges
        found.unpersist()


def test_token_lists(spark):
    from locusweave.operators import tokens

    want = {1: ["a", "b", "c"], 2: ["c"]}
    one = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (1, "c"), (2, "c")], "doc long, token string")
    many = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["c", "b"]), (2, ["c"])], "doc long, tokens array<string>")
    for rows in (one, many):
        assert {r.doc: sorted(r.tokens) for r in tokens.token_lists(rows).collect()} == want
