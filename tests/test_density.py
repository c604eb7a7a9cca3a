"""Density clusters against a plain implementation on small sets."""

import numpy as np
import pytest

from locusweave.operators import density


def neighbours(spark, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = []
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (j != i, d[i, j], j))[:k]
        rows += [(i, j, float(d[i, j]), r + 1) for r, j in enumerate(order)]
    return spark.createDataFrame(rows, "i long, j long, distance double, rank int")


def plain_edges(x, k, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = [sorted(range(len(x)), key=lambda j: (j != i, d[i, j], j))[:k] for i in range(len(x))]
    core = [max(d[i, j] for j in near[i][:samples]) for i in range(len(x))]
    return sorted({(max(d[i, j], core[i], core[j]), min(i, j), max(i, j)) for i in range(len(x)) for j in near[i] if i != j})


def plain_forest(n, edges):
    up, kept = list(range(n)), []
    find = lambda i: i if up[i] == i else find(up[i])
    for w, u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            up[a] = b
            kept.append((w, u, v))
    return kept


def plain_labels(n, forest, least, single):
    """Top down: condense, weigh, select."""
    node = {i: ([i], None, 0.0) for i in range(n)}
    up = list(range(n))
    find = lambda i: i if up[i] == i else find(up[i])
    at = {i: ([i], None, 0.0) for i in range(n)}
    for w, u, v in sorted(forest):
        a, b = find(u), find(v)
        at[a] = (at[a][0] + at[b][0], (at[a], at[b]), w)
        up[b] = a
    roots = [at[i] for i in range(n) if find(i) == i and len(at[i][0]) >= least]
    del node
    clusters = []  # [birth, events of points, children, members]

    def grow(tree, birth):
        me = {"birth": birth, "points": {}, "children": []}
        clusters.append(me)
        while tree is not None:
            members, children, w = tree
            lam = 1 / max(w, density.LEAST)
            if children is None:
                me["points"][members[0]] = 1 / density.LEAST
                break
            big = [c for c in children if len(c[0]) >= least]
            if len(big) == 2:
                me["children"] = [(grow(c, lam), len(c[0]), lam) for c in children]
                break
            for c in children:
                if len(c[0]) < least:
                    me["points"] |= {p: lam for p in c[0]}
            tree = big[0] if big else None
        return me

    tops = [grow(t, 0.0) for t in roots]
    selectable = len(roots) > 1 or single

    def weigh(c):
        stable = sum(v - c["birth"] for v in c["points"].values()) + sum(s * (lam - c["birth"]) for _, s, lam in c["children"])
        below = sum(weigh(k) for k, _, _ in c["children"])
        c["kept"] = stable >= below and (selectable or not any(c is t for t in tops))
        return max(stable, below) if c["kept"] else below

    label = {}

    def name(c, into):
        into = into if into is not None else c if c["kept"] else None
        for p in c["points"]:
            label[p] = id(into) if into is not None else -1
        for k, _, _ in c["children"]:
            name(k, into)

    for t in tops:
        weigh(t)
        name(t, None)
    groups = {}
    for p, g in label.items():
        groups.setdefault(g, []).append(p)
    return {p: -1 if label.get(p, -1) == -1 else min(groups[label[p]]) for p in range(n)}


def made(kind):
    rng = np.random.default_rng(7)
    if kind == "clouds":
        at = rng.standard_normal((5, 3)) * 6
        return np.concatenate([rng.standard_normal((22, 3)) * (0.3 + 0.2 * i) + c for i, c in enumerate(at)] + [rng.uniform(-12, 12, (25, 3))])
    if kind == "nested":
        return np.concatenate([rng.normal(0, 0.1, (15, 2)), rng.normal(0.8, 0.1, (15, 2)), rng.normal(8, 0.5, (20, 2)), rng.normal(-8, 2, (12, 2))])
    if kind == "copies":
        return np.concatenate([np.repeat([[0.0, 0.0], [5.0, 5.0]], 9, axis=0), rng.uniform(-9, 9, (14, 2))])
    return rng.uniform(0, 1, (70, 2))


@pytest.mark.parametrize("kind,k,least,samples,single", [
    ("clouds", 6, 5, 3, False), ("nested", 62, 10, 2, True), ("copies", 32, 4, 2, False), ("noise", 8, 12, 3, False),
])
def test_density_clusters_equal_plain(spark, kind, k, least, samples, single):
    x = made(kind)
    forest = plain_forest(len(x), plain_edges(x, k, samples))
    near = neighbours(spark, x, k)
    got = density.spanning_forest(density.mutual_reachability(near, samples))
    assert sorted((r.w, r.u, r.v) for r in got.collect()) == sorted(forest)
    found = {r.point: r.label for r in density.hdbscan(near, least, samples, single).collect()}
    assert found == plain_labels(len(x), forest, least, single)


def test_defined_cases(spark):
    none = spark.createDataFrame([], "i long, j long, distance double, rank int")
    assert density.hdbscan(none).count() == 0
    alone = spark.createDataFrame([(5, 5, 0.0, 1), (6, 6, 0.0, 1)], none.schema)
    assert {r.point: r.label for r in density.hdbscan(alone).collect()} == {5: -1, 6: -1}
    with pytest.raises(ValueError):
        density.hdbscan(none, 1)


def test_itself_first_without_a_union(spark):
    """A point's own row is its first, wherever copies put it; where copies fill the list, the others begin at rank 2.  A union of own
    rows and others failed on tables of many parts."""
    near = spark.createDataFrame([(1, 2, 0.0, 1), (1, 1, 0.1, 2), (1, 3, 0.5, 3), (4, 2, 0.0, 1), (4, 3, 0.2, 2)], "i long, j long, distance double, rank int")
    told = density.itself_first(near)
    assert sorted((r.i, r["rank"], r.j, r.distance) for r in told.collect()) == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 3, 0.5), (4, 2, 2, 0.0), (4, 3, 3, 0.2)]
    assert "Union" not in told._jdf.queryExecution().toString()
