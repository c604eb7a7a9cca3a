"""Region joins beside plain overlap: id trimming, coordinate matches, coverage, operon runs,
fragmentation, stitching, comparative edges and multi-locus views."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.expr import cosine, overlap_fraction
from locusweave.operators import graph
from locusweave.operators.intervals import RANGE, both_directions, merge_islands, overlap_join

PIECE_ROWS = 4096  # genes of a side of a view that one task compares


def match_trimmed_ids(wanted: DataFrame, known: DataFrame, steps: int = 4, sep: str = "_") -> DataFrame:
    """wanted(block_id, name) to known(gene_id): the name itself, else with leading parts dropped one by
    one; the least trimmed match counts."""
    parts = F.split("name", sep)
    tries = F.transform(F.sequence(F.lit(0), F.least(F.lit(steps), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), sep))
    rows = wanted.select("block_id", "name", F.posexplode(tries).alias("trim", "gene_id"))
    met = rows.join(known.select("gene_id").distinct(), "gene_id")
    return met.groupBy("block_id", "name").agg(F.min_by("gene_id", "trim").alias("gene_id"), F.min("trim").alias("trim"))


def match_coordinates(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left(id, key, start, end) to right(other_id, key, start, end): by both coordinates, else by start
    alone (the smallest id of several)."""
    exact = right.groupBy(*key, "start", "end").agg(F.min("other_id").alias("_exact"))
    loose = right.groupBy(*key, "start").agg(F.min("other_id").alias("_loose"))
    met = left.join(exact, [*key, "start", "end"], "left").join(loose, [*key, "start"], "left")
    return met.select("id", F.coalesce("_exact", "_loose").alias("other_id"))


def match_overlap(left: DataFrame, right: DataFrame, key: list[str], width: int, share: float = 0.5) -> DataFrame:
    """(id, other_id) of genes that overlap (sharing more than an end point) by at least share of the shorter."""
    a = left.select("id", *key, F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = right.select("other_id", *key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    strict = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    common = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    shorter = F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start"))
    return overlap_join(a, b, key, width).filter(strict & (common >= share * shorter)).select("id", "other_id")


def coverage_of_sides(truth: DataFrame, blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """Per truth row: each side covered by any block of that genome and contig, whatever the block's
    partner, and strictly by one block of the genome pair (contigs not looked at)."""
    side = lambda s: blocks.select(F.col(f"genome_{s}").alias("genome"), F.col(f"contig_{s}").alias("contig"), F.col(f"{s}_start").alias("p_start"), F.col(f"{s}_end").alias("p_end"))
    every = side("a").unionByName(side("b"))
    out = truth.select("gt_id")
    for s in ("a", "b"):
        mine = truth.select("gt_id", F.col(f"genome_{s}").alias("genome"), F.col(f"contig_{s}").alias("contig"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"))
        hit = mine.join(every, ["genome", "contig"]).filter(overlap_fraction("start", "end", "p_start", "p_end") >= share).select("gt_id").distinct()
        out = out.join(hit.withColumn(f"covered_{s}", F.lit(True)), "gt_id", "left")
    found = both_directions(blocks).withColumnsRenamed({c: f"p_{c}" for c in RANGE})
    same = (F.col("genome_a") == F.col("p_genome_a")) & (F.col("genome_b") == F.col("p_genome_b"))
    both = (overlap_fraction("a_start", "a_end", "p_a_start", "p_a_end") >= share) & (overlap_fraction("b_start", "b_end", "p_b_start", "p_b_end") >= share)
    strict = truth.join(found, same).filter(both).select("gt_id").distinct().withColumn("strict", F.lit(True))
    return out.join(strict, "gt_id", "left").na.fill(False)


def cross_genus_coverage(operons: DataFrame, genomes: DataFrame, hits: DataFrame) -> DataFrame:
    """Per operon(operon_id, genus): genomes(genome, genus) of other genera, how many of them a
    hit(operon_id, genome) reaches, and the share."""
    other = operons.select("operon_id", F.col("genus").alias("_genus")).join(genomes, F.col("genus") != F.col("_genus"))
    reached = hits.select("operon_id", "genome").distinct().withColumn("_hit", F.lit(1))
    told = other.join(reached, ["operon_id", "genome"], "left").groupBy("operon_id").agg(F.count("*").alias("n_genomes"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("n_reached"))
    return told.withColumn("share", F.col("n_reached") / F.col("n_genomes"))


def locus_gene_counts(loci: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """Genes that overlap each locus(locus_id, contig, start, end); the genome is not looked at."""
    a = loci.select("locus_id", "contig", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = genes.select("gene_id", "contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    counts = overlap_join(a, b, ["contig"], width).groupBy("locus_id").agg(F.count("*").alias("n_genes"))
    return loci.select("locus_id").join(counts, "locus_id", "left").na.fill(0)


def fragmentation_types(parts: DataFrame, container: str, gap: int = 10) -> DataFrame:
    """parts(container, a_start, a_end, b_start, n, orientation): why a container broke into its parts."""
    w = Window.partitionBy(container).orderBy("a_start", "a_end")
    step = parts.withColumn("_gap", F.col("a_start") - F.lag("a_end").over(w) - 1)
    told = step.groupBy(container).agg(F.count("*").alias("n_parts"), F.countDistinct("orientation").alias("_turns"), F.max("_gap").alias("max_gap"), F.avg("n").alias("mean_size"))
    kind = F.when(F.col("_turns") > 1, "inversion").when(F.col("max_gap") > gap, "insertion").when(F.col("mean_size") < 2, "over_fragmentation").otherwise("moderate_gap")
    return told.select(container, "n_parts", "max_gap", kind.alias("kind"))


def best_runs(genes: DataFrame, key: list[str], at: str, name: str, max_gap: int) -> DataFrame:
    """Per key the contiguous run (steps of at most max_gap + 1) with most distinct names, the first of equals."""
    rows = genes.select(*key, F.col(at).alias("start"), F.col(at).alias("end"), F.col(name).alias("_name"))
    runs = merge_islands(rows, key, max_gap + 1, [F.countDistinct("_name").alias("n_names")])
    order = Window.partitionBy(*key).orderBy(F.col("n_names").desc(), "start")
    return runs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def stitch_sinks(sinks: DataFrame, clustered: DataFrame, gap: int = 2, most: int = 2, width: int = 32) -> DataFrame:
    """(block_id, neighbour): unclustered blocks and clustered ones within gap on both loci, the closest `most`.

    Both: (block_id, q_key, q_start, q_end, t_key, t_start, t_end)."""
    a = sinks.select("block_id", "q_key", "t_key", "t_start", "t_end", (F.col("q_start") - gap).alias("l_start"), (F.col("q_end") + gap).alias("l_end"))
    b = clustered.select(F.col("block_id").alias("neighbour"), "q_key", "t_key", F.col("t_start").alias("u_start"), F.col("t_end").alias("u_end"), F.col("q_start").alias("r_start"), F.col("q_end").alias("r_end"))
    distance = F.greatest(F.lit(0), F.greatest("t_start", "u_start") - F.least("t_end", "u_end"))
    met = overlap_join(a, b, ["q_key", "t_key"], width).withColumn("d", distance).filter(F.col("d") <= gap)
    order = Window.partitionBy("block_id").orderBy("d", "neighbour")
    return met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select("block_id", "neighbour", "d")


class _Free:
    """The genes (idx, id) of one kind that are not taken yet, in that order."""

    def __init__(self, genes: list[tuple[int, str]]):
        self.genes = sorted(genes)
        self.at = [i for i, _ in self.genes]
        self.after, self.before = list(range(len(genes) + 1)), list(range(len(genes) + 1))  # before is shifted by one: 0 is none

    @staticmethod
    def _end(way: list[int], p: int) -> int:
        while way[p] != p:
            way[p] = way[way[p]]
            p = way[p]
        return p

    def take(self, p: int) -> None:
        self.after[p], self.before[p + 1] = p + 1, p

    def nearest(self, i: int) -> tuple[int, str] | None:
        """(distance, id) of the free gene closest to place i, the smaller id among equals."""
        p = bisect_left(self.at, i)
        right, left = self._end(self.after, p), self._end(self.before, p) - 1
        found = []
        if right < len(self.at):
            found.append((self.at[right] - i, self.genes[right][1]))
        if left >= 0:
            first = self._end(self.after, bisect_left(self.at, self.at[left]))
            found.append((i - self.at[left], self.genes[first][1]))
        return min(found, default=None)


def greedy_pairs(a: list[tuple[str, int, frozenset]], b: list[tuple[str, int, frozenset]]) -> list[tuple[str, str]]:
    """One-to-one pairs of genes (id, idx, domains) that one takes who walks all pairs with a shared domain by (most shared, distance, a, b).

    No list of pairs is made: each gene of a waits with the best partner it had when it was last looked at.  Partners only go, so a gene
    whose partner is still free when its turn comes has the best pair left."""
    kinds: dict[frozenset, list[tuple[int, str]]] = {}
    for g, i, d in b:
        kinds.setdefault(d, []).append((i, g))
    free = {d: _Free(genes) for d, genes in kinds.items()}
    spots: dict[str, list[tuple[frozenset, int]]] = {}
    for d, f in free.items():
        for p, (_, g) in enumerate(f.genes):
            spots.setdefault(g, []).append((d, p))
    having: dict[str | None, list[frozenset]] = {}
    for d in kinds:
        for x in d:
            having.setdefault(x, []).append(d)
    levels: dict[frozenset, list[tuple[int, list[frozenset]]]] = {}
    for d in {d for _, _, d in a}:
        shared = Counter(k for x in d for k in having.get(x, ()))
        by: dict[int, list[frozenset]] = {}
        for k, n in shared.items():
            by.setdefault(n, []).append(k)
        levels[d] = sorted(by.items(), reverse=True)

    def best(g: str, i: int, d: frozenset) -> tuple | None:
        for n, some in levels[d]:
            if found := min((near for k in some if (near := free[k].nearest(i))), default=None):
                return -n, found[0], g, found[1], next(number), i, d
        return None

    number = count()  # sets have no order
    heap = [e for g, i, d in a if (e := best(g, i, d))]
    heapify(heap)
    kept: dict[str, str] = {}
    while heap:
        _, _, g, h, _, i, d = heappop(heap)
        if g in kept:
            continue
        if h in spots:
            kept[g] = h
            for k, p in spots.pop(h):
                free[k].take(p)
        elif e := best(g, i, d):
            heappush(heap, e)
    return list(kept.items())


def _close_pairs(a: DataFrame, b: DataFrame, tau: float) -> DataFrame:
    """(view, a, b) with a cosine of tau or more of a(view, a, va) and b(view, b, vb): pieces of both sides of a view meet as matrices."""
    pieces = lambda df, n: df.groupBy("view").agg(F.ceil(F.count("*") / PIECE_ROWS).alias(n))
    both = pieces(a, "na").join(pieces(b, "nb"), "view")
    deal = lambda g, n: F.pmod(F.xxhash64(g), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = a.join(both, "view").withColumns({"pa": deal("a", "na"), "pb": each("nb")}).select("view", "pa", "pb", "a", "va")
    right = b.join(both, "view").withColumns({"pb": deal("b", "nb"), "pa": each("na")}).select("view", "pa", "pb", "b", "vb")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"view": x["view"][:0], "a": x["a"][:0], "b": y["b"][:0]})
        if x.empty or y.empty:
            return out
        u, v = (np.vstack(m.to_numpy()).astype(np.float64) for m in (x["va"], y["vb"]))
        with np.errstate(all="ignore"):
            u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (u, v))
        thin, slack = v.astype(np.float32).T, 2.4e-7 * (u.shape[1] + 8)  # of products of single precision
        found = [out]
        for i in range(0, len(u), 512):
            r, c = np.nonzero(u[i : i + 512].astype(np.float32) @ thin >= tau - slack)
            keep = np.einsum("nd,nd->n", u[i + r], v[c]) >= tau
            r, c = i + r[keep], c[keep]
            found.append(pd.DataFrame({"view": x["view"].to_numpy()[r], "a": x["a"].to_numpy()[r], "b": y["b"].to_numpy()[c]}))
        return pd.concat(found)

    kinds = dict(a.dtypes) | dict(b.dtypes)
    key = ("view", "pa", "pb")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, ", ".join(f"{c} {kinds[c]}" for c in ("view", "a", "b")))


def comparative_edges(left: DataFrame, right: DataFrame, tau: float = 0.8) -> DataFrame:
    """Edges between two loci of a view: (view, a, b, kind) for genes (view, id, idx, emb, domains array).

    cos: cosine at least tau; pfam: greedy one-to-one by shared domains, then index distance; both where they
    agree; a view without either is paired by rank (fallback).  Neither kind lists the pairs that it does not keep."""
    a = left.select("view", F.col("id").alias("a"), F.col("idx").alias("i"), F.col("emb").alias("va"), F.col("domains").alias("da"))
    b = right.select("view", F.col("id").alias("b"), F.col("idx").alias("j"), F.col("emb").alias("vb"), F.col("domains").alias("db"))
    cos = _close_pairs(a.filter("va IS NOT NULL").select("view", "a", "va"), b.filter("vb IS NOT NULL").select("view", "b", "vb"), tau).withColumn("cos", F.lit(1))
    kinds = dict(a.dtypes) | dict(b.dtypes)

    def greedy(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = lambda t: [(g, int(i), frozenset(d)) for g, i, d in t.itertuples(index=False)]
        kept = greedy_pairs(rows(x[["a", "i", "da"]]), rows(y[["b", "j", "db"]]))
        view = x["view"].iloc[:1].tolist() * len(kept)
        return pd.DataFrame({"view": pd.Series(view, dtype=x["view"].dtype), "a": pd.Series([g for g, _ in kept], dtype=x["a"].dtype), "b": pd.Series([h for _, h in kept], dtype=y["b"].dtype)})

    some = a.filter("size(da) > 0").select("view", "a", "i", "da").groupBy("view").cogroup(b.filter("size(db) > 0").select("view", "b", "j", "db").groupBy("view"))
    pf = some.applyInPandas(greedy, ", ".join(f"{c} {kinds[c]}" for c in ("view", "a", "b"))).withColumn("pfam", F.lit(1))
    both = cos.join(pf, ["view", "a", "b"], "full").withColumn("kind", F.when(F.col("cos").isNotNull() & F.col("pfam").isNotNull(), "both").when(F.col("cos").isNotNull(), "cos").otherwise("pfam"))
    both = graph.written(both.select("view", "a", "b", "kind"))  # read twice
    ranked = a.select("view", "a", "i").join(b.select("view", "b", F.col("j").alias("i")), ["view", "i"])
    rank = ranked.join(both.select("view").distinct(), "view", "left_anti").select("view", "a", "b", F.lit("fallback").alias("kind"))
    return both.unionByName(rank)


def track_order(similarity: dict[tuple[str, str], float], tracks: list[str]) -> list[str]:
    """Order of a view's tracks along a maximum spanning tree (a view holds a few tracks): from the
    track of greatest total similarity, each next one is the most similar to any placed one."""
    weight = lambda x, y: similarity.get((x, y), similarity.get((y, x), 0.0))
    if not tracks:
        return []
    order = [max(tracks, key=lambda x: (sum(weight(x, y) for y in tracks if y != x), -tracks.index(x)))]
    while len(order) < len(tracks):
        rest = [t for t in tracks if t not in order]
        order.append(max(rest, key=lambda x: (max(weight(x, y) for y in order), -tracks.index(x))))
    return order


def best_hit_edges(upper: DataFrame, lower: DataFrame, least: float = 0.5) -> DataFrame:
    """Per gene of a track its most similar gene on the next one: (view, a, b, sim)."""
    a = upper.select("view", F.col("id").alias("a"), F.col("emb").alias("va"))
    b = lower.select("view", F.col("id").alias("b"), F.col("emb").alias("vb"))
    met = a.join(b, "view").withColumn("sim", cosine("va", "vb"))
    return met.groupBy("view", "a").agg(F.max_by("b", F.struct("sim", "b")).alias("b"), F.max("sim").alias("sim")).filter(F.col("sim") >= least)


def view_groups(edges: DataFrame) -> DataFrame:
    """(node, root): gene groups of views by components of their edges(a, b as bigint ids)."""
    return graph.connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def sets_joined(sets: DataFrame, tau: float = 0.5, shared: int = 1) -> DataFrame:
    """(set_id, root): sets(set_id, item) merged when their Jaccard reaches tau or they share `shared` items.

    Sets meet through items: linking each to the least set of an item keeps the components when one
    shared item is enough; otherwise pairs come from the inverted index."""
    rows = sets.select("set_id", "item").distinct()
    if shared <= 1:
        least = rows.groupBy("item").agg(F.min("set_id").alias("v"))
        edges = rows.join(least, "item").select(F.col("set_id").alias("u"), "v").filter("u <> v").distinct()
    else:
        n = rows.groupBy("set_id").agg(F.count("*").alias("n"))
        met = rows.select("item", F.col("set_id").alias("u")).join(rows.select("item", F.col("set_id").alias("v")), "item").filter("u < v").groupBy("u", "v").agg(F.count("*").alias("s"))
        both = met.join(n.withColumnsRenamed({"set_id": "u", "n": "nu"}), "u").join(n.withColumnsRenamed({"set_id": "v", "n": "nv"}), "v")
        edges = both.filter((F.col("s") >= shared) | (F.col("s") / (F.col("nu") + F.col("nv") - F.col("s")) >= tau)).select("u", "v")
    return graph.components_of(rows.select(F.col("set_id").alias("node")).distinct(), edges).withColumnRenamed("node", "set_id")


def orthogroup_blocks(pairs: DataFrame, species: DataFrame, least: int = 2) -> DataFrame:
    """Neighbouring orthogroup pairs(a, b, genome) seen in at least `least` species -> components with their
    species coverage: (root, size, n_species, orthogroups), root being the least orthogroup."""
    named = pairs.join(species.select("genome", "species"), "genome")
    kept = named.groupBy("a", "b").agg(F.countDistinct("species").alias("n")).filter(F.col("n") >= least)
    ids = kept.select(F.explode(F.array("a", "b")).alias("og")).distinct().withColumn("node", F.xxhash64("og"))
    edges = kept.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    roots = ids.join(graph.connected_components(edges), "node").select("og", "root")
    cover = named.join(kept.select("a", "b"), ["a", "b"], "left_semi").select(F.explode(F.array("a", "b")).alias("og"), "species").distinct()
    told = roots.join(cover, "og").groupBy("root").agg(
        F.min("og").alias("_least"), F.countDistinct("og").alias("size"), F.countDistinct("species").alias("n_species"), F.array_sort(F.collect_set("og")).alias("orthogroups")
    )
    return told.select(F.col("_least").alias("root"), "size", "n_species", "orthogroups")


