import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusweave.operators import chains


def program(pairs, max_gap=2, min_size=2, scale=0.0, rev=False, sims=None):
    pairs = sorted(pairs)
    q, t = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    return chains.chain_program(q, t, np.array(sims or [0.95] * len(pairs)), rev, max_gap, min_size, scale)


def definition(q, t, sim, rev, max_gap, scale):
    """Length and score of the best chain that ends in each anchor, by the definition."""
    best = []
    for i in range(len(q)):
        options = [(1, sim[i])]
        for j in range(i):
            gq, gt = q[i] - q[j] - 1, (t[j] - t[i] if rev else t[i] - t[j]) - 1
            if gt >= 0 and (max_gap is None or max(gq, gt) <= max_gap):
                options.append((best[j][0] + 1, best[j][1] + sim[i] - scale * np.log2(max(gq, gt) + 1)))
        best.append(max(options))
    return best


@settings(max_examples=80, deadline=None)
@given(st.data(), st.integers(0, 16), st.booleans(), st.sampled_from([None, 0, 1, 2, 5]), st.sampled_from([0.0, 0.3]))
def test_program_follows_the_definition(data, n, rev, max_gap, scale):
    q = np.cumsum(data.draw(st.lists(st.integers(1, 3), min_size=n, max_size=n))).astype(int)
    t = np.array(data.draw(st.lists(st.integers(0, 15), min_size=n, max_size=n)), int)
    sim = np.array(data.draw(st.lists(st.sampled_from([0.5, 0.75, 1.0]), min_size=n, max_size=n)), float)
    length, score, before = chains._longest(q, -t if rev else t, sim, max_gap, scale)
    want = definition(q, t, sim, rev, max_gap, scale)
    assert length.tolist() == [w[0] for w in want] and np.allclose(score, [w[1] for w in want])
    found = chains.chain_program(q, t, sim, rev, max_gap, 1, scale)
    assert sorted(i for c in found for i in c) == list(range(n))
    for c in found:
        assert all(before[b] == a for a, b in zip(c, c[1:]))
        step = np.diff(-t[c] if rev else t[c])
        assert (step > 0).all() and (max_gap is None or (step <= max_gap + 1).all() and (np.diff(q[c]) <= max_gap + 1).all())
    assert [len(c) >= 3 for c in chains.chain_program(q, t, sim, rev, max_gap, 3, scale)] == [True] * sum(len(c) >= 3 for c in found)


def test_discarded_chain_takes_its_anchors():
    # the longest chain shares its head; what is left of the second is too short, yet taken
    pairs = [(0, 0), (1, 1), (2, 2), (3, 2)]
    found = program(pairs)
    assert [len(c) for c in found] == [3]


def longest(q, t, rev, max_gap):
    """Length of the longest chain, by trying all predecessors."""
    n, best = len(q), [1] * len(q)
    for i in range(n):
        for j in range(i):
            step = (t[j] - t[i] if rev else t[i] - t[j]) - 1
            if q[i] - q[j] - 1 <= max_gap and 0 <= step <= max_gap:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=14), st.booleans(), st.integers(0, 4))
def test_against_brute_force(targets, rev, max_gap):
    q, t = np.arange(len(targets)), np.array(targets)
    found = chains.chain_program(q, t, np.ones(len(t)), rev, max_gap, 1, 0.0)
    assert max(map(len, found)) == longest(q, t, rev, max_gap)
    assert sorted(i for c in found for i in c) == list(range(len(t)))


def anchors(spark, rows):
    names = "query_idx int, target_idx int, query_genome string, target_genome string, query_contig string, target_contig string, query_gene_id string, target_gene_id string, similarity double, orientation int"
    return spark.createDataFrame([(q, t, "g1", "g2", "c1", "c2", f"a{q}", f"b{t}", s, o) for q, t, s, o in rows], names)


@pytest.mark.parametrize("seed", range(4))
def test_accepted_blocks_of_a_pair_are_disjoint(spark, seed):
    """Random anchors with planted runs: accepted blocks never meet on either side, come by score, and count from first_id;
    every rejected one meets an accepted one with at least its score."""
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), 0.8, int(rng.choice([1, -1]))) for a, b in rng.integers(0, 60, (80, 2))]
    for _ in range(6):
        q, t, turn = *rng.integers(0, 50, 2), rng.choice([1, -1])
        rows += [(int(q + i), int(t + turn * i) if turn > 0 else int(t + 8 - i), float(rng.uniform(0.85, 1)), int(turn)) for i in range(rng.integers(2, 9))]
    table = anchors(spark, rows)
    got = chains.blocks(table, first_id=7).orderBy("block_id").collect()
    every = chains.blocks(table, select=False).collect()
    meets = lambda x, y: (x.query_start <= y.query_end and y.query_start <= x.query_end) or (x.target_start <= y.target_end and y.target_start <= x.target_end)
    assert [r.block_id for r in got] == list(range(7, 7 + len(got))) and len(got) > 3
    assert not any(meets(x, y) for i, x in enumerate(got) for y in got[:i])
    assert all(x.chain_score >= y.chain_score for x, y in zip(got, got[1:]))
    assert all(any(meets(x, y) and y.chain_score >= x.chain_score for y in got) for x in every)


def test_blocks_of_many_pairs_are_numbered_in_order(spark):
    rng = np.random.default_rng(5)
    table = None
    for g in range(12):
        part = anchors(spark, [(i, i, 0.9, 1) for i in range(int(rng.integers(2, 40)))]).withColumn("target_genome", F.lit(f"t{g:02d}"))
        table = part if table is None else table.unionByName(part)
    got = chains.blocks(table, first_id=100).orderBy("block_id").collect()
    assert [r.block_id for r in got] == list(range(100, 112)) and [r.target_genome for r in got] == [f"t{g:02d}" for g in range(12)]


def test_without_strands_directions_compete(spark):
    rows = [(0, 2, 0.9, 0), (1, 1, 0.9, 0), (2, 0, 0.9, 0)]
    got = chains.blocks(anchors(spark, rows)).collect()
    assert [(r.n_anchors, r.orientation) for r in got] == [(3, -1)]


def test_repeated_places_keep_the_best(spark):
    got = chains.prepared(anchors(spark, [(0, 0, 0.8, 1), (0, 0, 0.9, 1), (0, 3, 0.85, 1), (1, 1, 0.9, 1)])).collect()
    assert sorted((r.query_idx, r.target_idx, r.similarity) for r in got) == [(0, 0, 0.9), (1, 1, 0.9)]


def test_permuted_input_gives_the_same_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(q), int(t), float(s), int(o)) for q, t, s, o in zip(rng.integers(0, 20, 60), rng.integers(0, 20, 60), rng.random(60), rng.choice([1, -1], 60))]
    a = chains.blocks(anchors(spark, rows)).orderBy("block_id").collect()
    b = chains.blocks(anchors(spark, rows[::-1]).repartition(3)).orderBy("block_id").collect()
    assert a == b


def test_ground_truth_chains_may_share_anchors():
    q, t = np.array([0, 1, 2, 3, 3]), np.array([0, 1, 2, 3, 1])
    found = chains.gt_chain_program(q, t, 2, 2)
    assert [0, 1, 2, 3] in found
    assert any(q[c[0]] < q[c[-1]] and t[c[0]] > t[c[-1]] for c in found)  # an inverted one through a used anchor


def test_greedy_selection_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        rows = [(float(rng.integers(0, 9)), *(int(x) for p in ((a, a + rng.integers(0, 5)), (b, b + rng.integers(0, 5))) for x in p)) for a, b in rng.integers(0, 20, (12, 2))]
        kept: list[int] = []
        for i in sorted(range(12), key=lambda i: -rows[i][0]):
            meets = lambda k, lo, hi: rows[k][lo] <= rows[i][hi] and rows[i][lo] <= rows[k][hi]  # noqa: E731, B023
            if not any(meets(k, 1, 2) or meets(k, 3, 4) for k in kept):
                kept.append(i)
        assert chains.select_chains(rows) == kept
