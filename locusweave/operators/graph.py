"""Graphs as edge tables: mutual top-k, components, cores, triangles."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder, which a cluster must name in spark.checkpoint.dir; in local mode one is made where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^,]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusweave-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the session's shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the session's shared folder: unlike after cut(), the planner knows its real size, so loops of joins do not
    multiply estimates.  options: of the Parquet writer."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame, extra: list[str | Column] = ()) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *extra)
    return edges.select("u", "v", *extra).unionByName(back)


def mutual_top_k(edges: DataFrame, k: int) -> DataFrame:
    """edges(u < v, w) that are among the k heaviest of both their nodes (ties to the smaller id)."""
    return mutual_best(both_ways(edges, ["w"]), k)


def mutual_best(directed: DataFrame, k: int) -> DataFrame:
    """(u < v, w) of the rows of directed(u, v, w) that are among the k heaviest of their u and whose opposite is too."""
    order = Window.partitionBy("u").orderBy(F.col("w").desc(), "v")
    top = directed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    pair = top.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    return pair.groupBy("u", "v").agg(F.count("*").alias("n"), F.max("w").alias("w")).filter("n = 2").select("u", "v", "w")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node reachable.

    Alternating large and small stars: a minimum per node (partially aggregated), then an
    equi-join, so that a hub's rows can be split; lineage is cut each round."""
    now, mark = cut(edges.select("u", "v").filter("u <> v").distinct()), None
    for _ in range(rounds):
        both = both_ways(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        near = down.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(near.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every row of nodes(node); a node without an edge is its own root."""
    roots = connected_components(edges)
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def triangle_support(edges: DataFrame) -> DataFrame:
    """edges(u < v) with the number of triangles each is in; wedges are built from the end
    that comes first by (degree, id), so a hub opens few."""
    degree = both_ways(edges).groupBy("u").agg(F.count("*").alias("d"))
    a, b = degree.withColumnsRenamed({"d": "du"}), degree.withColumnsRenamed({"u": "v", "d": "dv"})
    known = edges.select("u", "v").join(a, "u").join(b, "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    aimed = known.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedge = aimed.alias("x").join(aimed.alias("y"), F.expr("x.s = y.s AND x.t < y.t")).select(F.col("x.s").alias("s"), F.col("x.t").alias("a"), F.col("y.t").alias("b"))
    closed = wedge.join(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"])
    side = lambda p, q: closed.select(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    counts = side("s", "a").unionByName(side("s", "b")).unionByName(side("a", "b")).groupBy("u", "v").agg(F.count("*").alias("triangles"))
    return edges.join(counts, ["u", "v"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))


def k_core(edges: DataFrame, k: int, rounds: int = 100) -> DataFrame:
    """Edges of the k-core: nodes of lower degree go until none is left."""
    now = cut(edges.select("u", "v").distinct())
    size = now.count()
    for _ in range(rounds):
        stay = both_ways(now).groupBy("u").count().filter(F.col("count") >= k).select(F.col("u").alias("node"))
        left = now.join(stay.withColumnRenamed("node", "u"), "u", "left_semi").join(stay.withColumnRenamed("node", "v"), "v", "left_semi")
        now = cut(left.select("u", "v"))
        if (new := now.count()) == size:
            return now
        size = new
    raise RuntimeError(f"core did not settle in {rounds} rounds")


def degree_cap(edges: DataFrame, cap: int) -> DataFrame:
    """Edges that are among the cap heaviest of both their ends (w desc, then id)."""
    return mutual_top_k(edges, cap)


def either_cap(edges: DataFrame, cap: int) -> DataFrame:
    """edges(u < v, w) that are among the cap heaviest of one of their ends (w desc, then id)."""
    order = Window.partitionBy("u").orderBy(F.col("w").desc(), "v")
    top = both_ways(edges, ["w"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap)
    return top.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.max("w").alias("w"))


def greedy_cap(edges: DataFrame, cap: int, rounds: int = 1000) -> DataFrame:
    """The edges (u < v, w) that one keeps who walks them from the heaviest on (ties by u, then v) and takes each whose ends both have
    fewer than cap edges so far.

    In rounds: an edge that stands, among the edges left at both its ends, within the room there is taken by that walk whatever
    becomes of the others, so all such edges are taken at once; edges of an end without room go.  The heaviest edge left is always taken."""
    now = written(edges.filter("u < v").groupBy("u", "v").agg(F.max("w").alias("w")))
    room = written(both_ways(now).select(F.col("u").alias("node")).distinct().withColumn("room", F.lit(cap)))
    taken: DataFrame | None = None
    for _ in range(rounds):
        if now.isEmpty():
            return now if taken is None else taken
        order = Window.partitionBy("node").orderBy(F.col("w").desc(), "u", "v")
        ends = now.select("u", "v", "w", F.explode(F.array("u", "v")).alias("node")).withColumn("rank", F.row_number().over(order)).join(room, "node")
        fits = ends.groupBy("u", "v", "w").agg(F.bool_and(F.col("rank") <= F.col("room")).alias("fits"))
        judged = written(fits)
        won = judged.filter("fits").select("u", "v", "w")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        room = written(room.join(used, "node", "left").select("node", (F.col("room") - F.coalesce("used", F.lit(0))).cast("int").alias("room")))
        free = room.filter("room > 0").select("node")
        left = judged.filter("NOT fits").select("u", "v", "w")
        now = written(left.join(free.withColumnRenamed("node", "u"), "u", "left_semi").join(free.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v", "w"))
    raise RuntimeError(f"the walk did not end in {rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels(node, community) over edges(u < v, w)."""
    named = edges.join(labels.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(labels.withColumnsRenamed({"node": "v", "community": "cv"}), "v")
    degree = both_ways(edges, ["w"]).groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).join(labels, "node")
    m, inside = named.agg(F.sum("w"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0))).first()
    if not m:
        return 0.0
    squares = degree.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / m - resolution * squares / (4 * m * m)


PATIENCE = 6  # sweeps after which fewer nodes move at once


def _moved(both: DataFrame, degree: DataFrame, labels: DataFrame, m: float, resolution: float, sweep: int, turn: int, turns: int) -> DataFrame:
    """One turn of local moves: nodes of this turn's share go to the neighbouring community of greatest gain, if that is more than
    where they are gains."""
    held = labels.join(degree, "node")
    total = held.groupBy("community").agg(F.sum("k").alias("all"), F.count("*").alias("n"))
    met = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
    own = held.select("node", "community", F.lit(0.0).alias("w"))
    options = met.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
    options = options.join(held.select("node", "k", F.col("community").alias("own")), "node").join(total, "community")
    rest = F.col("all") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    options = options.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / (2 * m), 9))
    best = options.groupBy("node").agg(
        F.max_by(F.struct("community", "n"), F.struct("gain", -F.col("community"))).alias("best"), F.max("gain").alias("most"),
        F.max(F.when(F.col("community") == F.col("own"), F.struct("gain", "n"))).alias("now"),
    )
    mine = F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(turns)) == turn
    swap = (F.col("best.n") == 1) & (F.col("now.n") == 1) & (F.col("best.community") > F.col("community"))  # of two single nodes the larger moves
    goes = mine & (F.col("most") > F.col("now.gain")) & ~swap
    return labels.join(best, "node").select("node", F.when(goes, F.col("best.community")).otherwise(F.col("community")).alias("community"), goes.alias("moved"))


def modularity_communities(edges: DataFrame, resolution: float = 1.0, sweeps: int = 200, levels: int = 50) -> DataFrame:
    """(node, community) of edges(u < v, w) with bigint nodes: greedy modularity by local moves and aggregation, communities kept connected,
    each named by its least node.

    A sweep has two turns: in each, half of the nodes (by a hash of the sweep) may move at once, so neighbours seldom swap places; every
    PATIENCE sweeps a turn more, so that moves get rarer until each gains by itself.  Moves of a level end with a sweep without one.  What a
    level finds is split into its connected parts, which are the nodes of the next one.  A level that needs more than so many sweeps, or a
    graph that needs more levels, is an error: nothing unfinished is returned."""
    m = edges.agg(F.sum("w")).first()[0]
    if m is None:  # no edge
        return edges.select(F.col("u").alias("node"), F.col("u").alias("community")).limit(0)
    now = cut(edges.select("u", "v", F.col("w").cast("double").alias("w")))
    named = cut(both_ways(now).select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")))
    degree = cut(both_ways(now, ["w"]).groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
    for _ in range(levels):
        both, labels = both_ways(now, ["w"]), degree.select("node", F.col("node").alias("community"))
        for sweep in range(sweeps):
            turns, moved = 2 + sweep // PATIENCE, False
            for turn in range(turns):
                step = cut(_moved(both, degree, labels, m, resolution, sweep, turn, turns))
                labels = step.drop("moved")
                moved = not step.filter("moved").isEmpty() or moved
            if not moved:
                break
        else:
            raise RuntimeError(f"moves did not settle in {sweeps} sweeps")
        side = lambda s: labels.withColumnsRenamed({"node": s, "community": f"c{s}"})  # noqa: E731, B023
        inside = now.join(side("u"), "u").join(side("v"), "v").filter("cu = cv").select("u", "v")
        parts = cut(components_of(labels.select("node"), inside).withColumnRenamed("root", "part"))
        if parts.filter("node <> part").isEmpty():
            break
        named = cut(named.join(parts.withColumnRenamed("node", "community"), "community").select("node", F.col("part").alias("community")))
        degree = cut(degree.join(parts, "node").groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k")))
        ends = now.join(parts.withColumnsRenamed({"node": "u", "part": "pu"}), "u").join(parts.withColumnsRenamed({"node": "v", "part": "pv"}), "v").filter("pu <> pv")
        now = cut(ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("w")))
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"communities did not settle in {levels} levels")
    return named


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, label) by weighted label propagation with ties to the smaller label.  Labels only fall, so a fixed point is reached; a graph
    that needs more rounds is an error."""
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    both = both_ways(edges, ["w"])
    for _ in range(rounds):
        votes = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy("u", "label").agg(F.sum("w").alias("s"))
        best = votes.groupBy("u").agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("best")).withColumnRenamed("u", "node")
        new = cut(labels.join(best, "node", "left").select("node", F.least("label", F.coalesce("best", "label")).alias("label")))
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
