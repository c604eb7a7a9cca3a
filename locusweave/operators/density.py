"""Density clusters (HDBSCAN) over a neighbour graph, as joins and groupings.

* Core distances and mutual reachability: edges (u, v, w) with w the largest of both core distances and the distance.
* Minimum spanning forest by Boruvka rounds: each tree takes its least edge out, the chosen edges join trees (pointers to the other end,
  halved until they rest), edges inside a tree go and of several between two trees the least stays.
* Condensed tree, bottom up: a group of fewer than min_cluster_size points is dust.  Dust whose least edge leads to a cluster falls
  out of it at that weight, all such at once; dust and dust that are each other's least join, and become a cluster when they are
  many enough.  So the rounds are about as many as the size asked for, not as the points.
* What is left is the tree of clusters alone (at most one leaf for each min_cluster_size points): its merges are put in order in one
  task for each connected part, and a second such task weighs stabilities.  Points find their cluster in between by doubling steps up
  the tree.

All orders are total: edges by (w, u, v).  Two tables that differ in ties of weight alone may have different, equally good trees.
Defined cases: parts of the graph with fewer points than min_cluster_size are noise (label -1), as are points without an edge; a part with no
split is one cluster if there are several parts or allow_single_cluster is set, else noise; points of equal place have the greatest
density a weight of LEAST allows; repeated edges count once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.graph import components_of, written

LEAST = 1e-9  # weight below which density does not grow
ROUNDS = 10_000  # more are an error
_FIRST = -(1 << 63)  # stands before all merges


def itself_first(neighbours: DataFrame) -> DataFrame:
    """neighbours(i, j, distance, rank) with each point its own first, at distance 0, and the others from rank 2 on: copies of a point may
    stand before it, or fill its list.

    One window, not a union of both kinds: Spark zips the parts of a union whose sides it takes for equally partitioned, and fails where one of
    them was split."""
    own = (F.col("i") == F.col("j")).cast("int")
    every, order = Window.partitionBy("i"), Window.partitionBy("i").orderBy(own.desc(), "rank")
    rank = F.row_number().over(order) + 1 - F.max(own).over(every)
    return neighbours.select("i", "j", F.when(own == 1, 0.0).otherwise(F.col("distance")).alias("distance"), rank.alias("rank"))


def mutual_reachability(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """(u < v, w) of neighbours(i, j, distance, rank), each point its own first: core distance is that of rank min_samples (or the last)."""
    core = neighbours.filter(F.col("rank") <= min_samples).groupBy("i").agg(F.max("distance").alias("core"))
    pairs = neighbours.filter("i <> j").groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.min("distance").alias("d"))
    both = pairs.join(core.withColumnsRenamed({"i": "u", "core": "cu"}), "u").join(core.withColumnsRenamed({"i": "v", "core": "cv"}), "v")
    return both.select("u", "v", F.greatest("d", "cu", "cv").alias("w"))


def _rooted(pointers: DataFrame) -> DataFrame:
    """(c, root) of pointers(c, p) whose every path ends in a pair that points at each other; the lesser of the pair is the root."""
    back = pointers.select(F.col("c").alias("p"), F.col("p").alias("c"), F.lit(True).alias("pair"))
    now = written(pointers.join(back, ["c", "p"], "left").select("c", F.when(F.col("pair") & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
    while True:
        after = written(now.join(now.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", "q", (F.col("p") != F.col("q")).alias("moved")))
        now = after.select("c", F.col("q").alias("p"))
        if after.filter("moved").isEmpty():
            return now.withColumnRenamed("p", "root")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (u, v, w) of the minimum spanning forest of edges(u < v, w), by (w, u, v)."""
    now = written(edges.filter("u < v").groupBy("u", "v").agg(F.min("w").alias("w")).select(F.col("u").alias("a"), F.col("v").alias("b"), "w", F.col("u").alias("eu"), F.col("v").alias("ev")))
    taken = None
    while not now.isEmpty():
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "eu", "ev"))
        best = written(ends.groupBy(F.col("a").alias("c")).agg(F.min_by(F.struct(F.col("b").alias("p"), "w", "eu", "ev"), F.struct("w", "eu", "ev")).alias("x")).select("c", "x.*"))
        chosen = best.select(F.col("eu").alias("u"), F.col("ev").alias("v"), "w").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        roots = _rooted(best.select("c", "p"))
        side = lambda s: roots.select(F.col("c").alias(s), F.col("root").alias(f"r{s}"))
        moved = now.join(side("a"), "a").join(side("b"), "b").filter("ra <> rb")
        pair = moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        now = written(pair.agg(F.min(F.struct("w", "eu", "ev")).alias("x")).select("a", "b", "x.*"))
    return written(taken) if taken is not None else edges.select("u", "v", "w").limit(0)


def _settled_dust(points: DataFrame, forest: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(falls (point, leaf, w, eu, ev): where each point leaves the cluster that leaf is in; edges (a, b, w, eu, ev) between leaves)."""
    now = written(forest.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", F.col("u").alias("eu"), F.col("v").alias("ev")))
    held = written(points.select("point", F.col("point").alias("node")))  # points of dust
    falls: DataFrame | None = None
    for _ in range(ROUNDS):
        dust = held.groupBy("node").agg(F.count("*").alias("n"))
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "eu", "ev")).withColumnRenamed("a", "node")
        best = ends.join(dust, "node").groupBy("node", "n").agg(F.min_by(F.struct(F.col("b").alias("to"), "w", "eu", "ev"), F.struct("w", "eu", "ev")).alias("x")).select("node", "n", "x.*")
        best = written(best)
        if best.isEmpty():
            break
        other = best.select(F.col("node").alias("to"), F.col("n").alias("m"), F.col("to").alias("back"))
        met = best.join(other, "to", "left")
        joins = F.col("m").isNull() | (F.col("back") == F.col("node"))  # a cluster at the other end, or dust that wants this one
        whole = F.when(F.col("m").isNull(), F.col("to")).otherwise(F.least("node", "to"))
        many = F.col("m").isNull() | (F.col("n") + F.col("m") >= size)
        moves = written(met.filter(joins).select("node", whole.alias("into"), many.alias("falls"), "w", "eu", "ev"))
        moved = written(held.join(moves, "node", "left"))
        fallen = moved.filter("falls").select("point", F.col("into").alias("leaf"), "w", "eu", "ev")
        falls = fallen if falls is None else falls.unionByName(fallen)
        held = moved.filter("falls IS NULL OR NOT falls").select("point", F.coalesce("into", "node").alias("node"))
        side = lambda s: moves.select(F.col("node").alias(s), F.col("into").alias(f"i{s}"))
        shifted = now.join(side("a"), "a", "left").join(side("b"), "b", "left")
        shifted = shifted.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"), "w", "eu", "ev")
        now = written(shifted.filter("a <> b"))
        held = written(held)
    else:
        raise RuntimeError(f"dust did not settle in {ROUNDS} rounds")
    if falls is None:
        falls = held.select("point", F.col("node").alias("leaf"), F.lit(0.0).alias("w"), F.lit(0).cast("bigint").alias("eu"), F.lit(0).cast("bigint").alias("ev")).limit(0)
    return written(falls), now


_TREE = "part bigint, x bigint, parent bigint, w double, eu bigint, ev bigint, top double"


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The clusters of a part: leaves (a, no b) and the merges along its edges in order; top: weight of the merge that ends a cluster."""
    part = rows["part"].iloc[0]
    leaves = rows.loc[rows["b"].isna(), "a"].astype("int64").tolist()
    edges = rows[~rows["b"].isna()].sort_values(["w", "eu", "ev"])
    up: dict[int, int] = {}

    def find(i: int) -> int:
        path = []
        while i in up:
            path.append(i)
            i = up[i]
        for j in path:
            up[j] = i
        return i

    told = {x: [x, -1, 0.0, _FIRST, _FIRST, float("inf")] for x in leaves}
    new = -2  # merges are numbered downwards; points are not negative or their numbers are hashes: (part, x) names a cluster
    taken = set(leaves)
    for a, b, w, eu, ev in zip(edges["a"].astype("int64"), edges["b"].astype("int64"), edges["w"], edges["eu"], edges["ev"]):
        while new in taken:
            new -= 1
        for side in (find(a), find(b)):
            told[side][1], told[side][5], up[side] = new, w, new
        told[new] = [new, -1, w, eu, ev, float("inf")]
        new -= 1
    out = pd.DataFrame(list(told.values()), columns=["x", "parent", "w", "eu", "ev", "top"])
    out["parent"] = out["parent"].astype("Int64").where(out["top"] != float("inf"))
    return out.assign(part=part)[["part", "x", "parent", "w", "eu", "ev", "top"]]


def _chosen(roots: bool):
    """Which clusters of a part are selected: rows (x, parent, w, top, n, direct) to (part, x, label)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        density = lambda w: 0.0 if w == float("inf") else 1 / max(w, LEAST)
        at = {int(x): i for i, x in enumerate(rows["x"])}
        parent = [None if pd.isna(p) else int(p) for p in rows["parent"]]
        birth = [density(t) for t in rows["top"]]
        n, direct = rows["n"].tolist(), rows["direct"].tolist()
        order = rows.assign(i=range(len(rows))).sort_values(["w", "eu", "ev"], kind="stable")["i"].tolist()  # leaves first, then merges
        size, stable, below, kept = list(n), [d - c * b for d, c, b in zip(direct, n, birth)], [0.0] * len(n), [False] * len(n)
        split = [density(w) for w in rows["w"]]
        for i in order:
            is_root = parent[i] is None
            if (not is_root or roots) and stable[i] >= below[i]:
                kept[i], best = True, stable[i]
            else:
                best = below[i]
            if not is_root:
                p = at[parent[i]]
                size[p] += size[i]
                stable[p] += size[i] * (split[p] - birth[p])
                below[p] += best
        label: list[int | None] = [None] * len(n)
        for i in reversed(order):  # parents before their children
            above = label[at[parent[i]]] if parent[i] is not None else None
            label[i] = above if above is not None else int(rows["x"].iloc[i]) if kept[i] else None
        return pd.DataFrame({"part": rows["part"], "x": rows["x"], "label": pd.array(label, "Int64")})

    return run


def density_clusters(points: DataFrame, forest: DataFrame, min_cluster_size: int = 5, allow_single_cluster: bool = False) -> DataFrame:
    """(point, label) of points(point: bigint) under the spanning forest (u, v, w): label is the least point of the cluster, -1 for noise."""
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points or more")
    falls, between = _settled_dust(points, forest, min_cluster_size)
    leaves = falls.select(F.col("leaf").alias("node")).distinct()
    parts = written(components_of(leaves, between.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    rows = parts.select(F.col("root").alias("part"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0.0).alias("w"), F.lit(0).cast("bigint").alias("eu"), F.lit(0).cast("bigint").alias("ev"))
    edges = between.join(parts.select(F.col("node").alias("a"), F.col("root").alias("part")), "a").select("part", "a", "b", "w", "eu", "ev")
    tree = written(rows.unionByName(edges).groupBy("part").applyInPandas(_merged, _TREE))
    placed = _climbed(falls.join(parts.select(F.col("node").alias("leaf"), F.col("root").alias("part")), "leaf").withColumnRenamed("leaf", "x"), tree)
    density = 1 / F.greatest(F.col("w"), F.lit(LEAST))
    told = placed.groupBy("part", "x").agg(F.count("*").alias("n"), F.sum(density).alias("direct"))
    weighed = tree.join(told, ["part", "x"], "left").fillna({"n": 0, "direct": 0.0})
    several = parts.select("root").distinct().limit(2).count() > 1
    labels = weighed.groupBy("part").applyInPandas(_chosen(several or allow_single_cluster), "part bigint, x bigint, label bigint")
    named = placed.select("point", "part", "x").join(labels.filter("label IS NOT NULL"), ["part", "x"]).select("point", "part", "label")
    first = named.groupBy("part", "label").agg(F.min("point").alias("first"))
    found = named.join(first, ["part", "label"]).select("point", F.col("first").alias("label"))
    return points.select("point").join(found, "point", "left").select("point", F.coalesce("label", F.lit(-1)).alias("label"))


def _climbed(falls: DataFrame, tree: DataFrame) -> DataFrame:
    """falls with x the cluster that the point leaves: of its leaf's ancestors the last one that was merged before (w, eu, ev)."""
    made = F.struct("w", "eu", "ev")
    steps = [written(tree.filter("parent IS NOT NULL").select("part", "x", F.col("parent").alias("up")))]
    while not steps[-1].isEmpty():
        last = steps[-1]
        steps.append(written(last.join(last.select("part", F.col("x").alias("up"), F.col("up").alias("upper")), ["part", "up"]).select("part", "x", F.col("upper").alias("up"))))
    when = tree.select("part", F.col("x").alias("up"), made.alias("made"))
    now = falls
    for step in reversed(steps[:-1]):
        reach = now.join(step.join(when, ["part", "up"]), ["part", "x"], "left")
        goes = F.col("up").isNotNull() & (F.col("made") < made)
        now = reach.withColumn("x", F.when(goes, F.col("up")).otherwise(F.col("x"))).drop("up", "made")
    return written(now)


def hdbscan(neighbours: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, allow_single_cluster: bool = False) -> DataFrame:
    """(point, label) of neighbours(i, j, distance, rank), each point its own first neighbour."""
    forest = spanning_forest(mutual_reachability(neighbours, min_samples or max(1, min_cluster_size // 2)))
    return density_clusters(neighbours.select(F.col("i").alias("point")).distinct(), forest, min_cluster_size, allow_single_cluster)
