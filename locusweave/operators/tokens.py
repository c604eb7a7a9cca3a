"""Token lists along contigs: domain counts, document frequency, consensus, k-mers, neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.expr import fixed
from locusweave.operators.graph import cut, written


PREFIX_FROM = 0.5  # similarity from which on documents meet by prefixes
TILE_TOKENS = 8 << 20  # tokens of the documents of a tile
TILE_DOCS = 512  # documents that a tile has at least, if that makes fewer tiles than there are cores
MEETINGS = 2 << 20  # tokens in common that a tile counts at a time
BANNED = 500_000  # banned tokens that are broadcast
COMMON = 200_000  # most frequent tokens, which each task looks up for itself
COMMON_IDS = 1 << 62  # their ids are from here on, above those of the others
CANDIDATES = 1_000_000  # documents of candidate pairs that are broadcast
PAIRS = 1 << 16  # candidate pairs of a group that one tile takes


def explode_list(df: DataFrame, column: str, sep: str, to: str = "token") -> DataFrame:
    """A row per non-empty trimmed entry of a separated list."""
    return df.withColumn(to, F.explode(F.split(column, sep))).withColumn(to, F.trim(to)).filter(F.col(to) != "")


def domain_counts(df: DataFrame, column: str, sep: str = ";", distinct_of: str | None = None) -> DataFrame:
    """(token, n) over all rows, distinct `distinct_of` values, or (the column itself) distinct lists."""
    rows = df.select(distinct_of, column).distinct() if distinct_of and distinct_of != column else df.select(column).distinct() if distinct_of else df
    return explode_list(rows, column, sep).groupBy("token").agg(F.count("*").alias("n"))


def gene_domains(hits: DataFrame, gene: str = "sequence_id", name: str = "hmm_name") -> DataFrame:
    """Sorted distinct names per gene as a ; list, with count and first."""
    names = hits.groupBy(gene).agg(F.array_sort(F.collect_set(name)).alias("_names"))
    return names.select(gene, F.array_join("_names", ";").alias("pfam_domains"), F.size("_names").alias("pfam_count"), F.get("_names", F.lit(0)).alias("primary_pfam"))


def gene_domains_in_order(hits: DataFrame, gene: str = "sequence_id", name: str = "hmm_name", at: str = "env_from") -> DataFrame:
    """Names per gene in order along the protein, repeats kept."""
    placed = F.transform(F.array_sort(F.collect_list(F.struct(at, name))), lambda x: x[name])
    return hits.groupBy(gene).agg(F.array_join(placed, ";").alias("pfam_domains"))


def token_intersection(query: DataFrame, target: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks(block_id) with the number of distinct tokens on both sides."""
    both = query.select("block_id", "token").distinct().join(target.select("block_id", "token").distinct(), ["block_id", "token"])
    counts = both.groupBy("block_id").agg(F.count("*").alias("n_shared"))
    return blocks.join(counts, "block_id", "left").select("block_id", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def document_frequency(tokens: DataFrame, doc: str = "doc") -> DataFrame:
    return tokens.select(doc, "token").distinct().groupBy("token").agg(F.count("*").alias("df"))


def percentile_ban(df: DataFrame, p: float) -> DataFrame:
    """Tokens whose document frequency reaches the value at rank floor(p * (n - 1)): the cutoff is
    read off a histogram of frequencies, not off a sort of all tokens in one task."""
    hist = df.groupBy("df").agg(F.count("*").alias("c"))
    upto = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    ranked = hist.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(every))
    cutoff = ranked.filter(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1))).agg(F.min("df").alias("cutoff"))
    return df.join(F.broadcast(cutoff), F.col("df") >= F.col("cutoff")).select("token", "df", "cutoff")


def set_classes(listed: DataFrame) -> DataFrame:
    """(doc, rep, size) of token_lists: documents with equal token sets, their least one and their number."""
    told = written(listed.select("doc", F.unhex(F.sha2(F.to_json(F.sort_array("tokens")), 256)).alias("_set")))
    same = told.groupBy("_set").agg(F.min("doc").alias("rep"), F.count("*").alias("size"))
    return told.join(same, "_set").select("doc", "rep", "size")


def token_lists(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, tokens): the distinct tokens of each document, as a table in the shared folder; rows hold a token or an array of tokens."""
    every = F.array_distinct(F.flatten(F.collect_list("tokens"))) if "tokens" in rows.columns else F.collect_set("token")
    return written(rows.groupBy(F.col(doc).alias("doc")).agg(every.alias("tokens")))


def single_lists(rows: DataFrame) -> DataFrame:
    """token_lists of rows(doc, tokens), tokens distinct; where no document has a second row, no row moves."""
    return written(rows, compression="zstd") if rows.groupBy("doc").count().filter("count > 1").isEmpty() else token_lists(rows)


def token_sets(listed: DataFrame, ban: float | None = None) -> tuple[DataFrame, int, int]:
    """((doc, total, ids, dfs), documents, entries) of token_lists: ids and document frequencies of the tokens that another document has
    too, total the IDF weight of all.  Tokens of more than one document at or above the frequency percentile ban are left out, and documents of none."""
    each = listed.select("doc", F.explode("tokens").alias("token"))
    known = written(each.groupBy("token").agg(F.count("*").alias("df")).withColumn("id", F.monotonically_increasing_id()))
    kept = known
    if ban is not None:
        banned = percentile_ban(known.select("token", "df"), ban).filter("df > 1").select("token")
        few = banned.limit(BANNED + 1).count() <= BANNED
        each = each.join(F.broadcast(banned) if few else banned, "token", "left_anti")  # most entries, before they move
        kept = known.join(banned, "token", "left_anti")
    held = each.join(kept, "token").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "df"))).alias("held"))
    held = written(held.select("doc", F.filter("held", lambda x: x["df"] > 1).alias("held"), F.transform("held", lambda x: x["df"]).alias("every")))
    n, entries = held.agg(F.count("*"), F.coalesce(F.sum(F.size("held")), F.lit(0))).first()
    total = F.aggregate("every", F.lit(0.0), lambda t, df: t + F.log(1 + F.lit(n) / df))
    return held.select("doc", total.alias("total"), F.col("held.id").alias("ids"), F.col("held.df").alias("dfs")), n, entries


class _SetTile:
    """Token sets of the documents of a tile, by token.  Other documents stream past; of both sides each keeps its k best."""

    def __init__(self, held: pd.DataFrame, n: int, k: int, tau: float, least: int):
        self.docs, self.total, self.k, self.tau, self.least = held["doc"].to_numpy(np.int64), held["total"].to_numpy(float), k, tau, least
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held["ids"]])
        ids, dfs = np.concatenate(held["ids"].to_list()), np.concatenate(held["dfs"].to_list())
        order = np.argsort(ids, kind="stable")
        self.owner = owner[order]
        self.token, self.start = np.unique(ids[order], return_index=True)
        self.size = np.diff(np.append(self.start, len(ids)))
        self.idf = np.log(1 + n / dfs[order][self.start])
        self.shared, self.common = np.zeros(0), np.zeros(0, np.int64)
        self.found, self.waiting = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0

    def meet(self, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = np.concatenate(part["ids"].to_list())
        row = np.repeat(np.arange(len(part)), [len(x) for x in part["ids"]])
        if not len(self.token) or not len(ids):
            return
        at = np.minimum(np.searchsorted(self.token, ids), len(self.token) - 1)
        hit = self.token[at] == ids
        row, at = row[hit], at[hit]
        docs, total, own = part["doc"].to_numpy(np.int64), part["total"].to_numpy(float), part["own"].to_numpy(bool)
        upto = np.cumsum(np.bincount(row, self.size[at], minlength=len(part)))
        a = 0
        while a < len(part):  # as many documents as have so many tokens in common with the tile, one at least
            b = max(a + 1, min(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MEETINGS, "right")), a + max(1, MEETINGS * 4 // len(self.docs))))
            lo, hi = np.searchsorted(row, (a, b))
            yield self._alike(row[lo:hi] - a, at[lo:hi], docs[a:b], total[a:b], own[a:b])
            a = b

    def _alike(self, row: np.ndarray, at: np.ndarray, docs: np.ndarray, total: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        size, width = self.size[at], len(self.docs)
        if len(self.shared) < len(docs) * width:
            self.shared, self.common = np.zeros(len(docs) * width), np.zeros(len(docs) * width if self.least > 1 else 0, np.int64)
        place = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = np.repeat(row * width, size) + self.owner[place]
        np.add.at(self.shared, key, np.repeat(self.idf[at], size))
        shared = self.shared[key]
        r, c = np.divmod(key, width)
        near = shared >= (self.tau - 1e-9) * (total[r] + self.total[c] - shared)
        if self.least > 1:
            np.add.at(self.common, key, 1)
            near &= self.common[key] >= self.least
            self.common[key] = 0
        near &= ~own[r] | (self.docs[c] < docs[r])
        _, one = np.unique(key[near], return_index=True)
        r, c, shared = r[near][one], c[near][one], shared[near][one]
        self.shared[key] = 0
        w = np.round(shared / (total[r] + self.total[c] - shared), 9)
        good = w >= self.tau
        r, c, w = r[good], c[good], w[good]
        self.found.append((c, docs[r], w))
        self.waiting += len(c)
        if self.waiting > 2 * self.k * width:
            self._settle()
        r, v, w = self._best(r, self.docs[c], w)
        return pd.DataFrame({"u": docs[r], "v": v, "w": w})

    def _best(self, x: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((v, -w, x))
        x, v, w = x[order], v[order], w[order]
        keep = np.arange(len(x)) - np.searchsorted(x, x, "left") < self.k
        return x[keep], v[keep], w[keep]

    def _settle(self) -> None:
        self.found, self.waiting = [self._best(*(np.concatenate(p) for p in zip(*self.found)))], 0

    def hits(self) -> pd.DataFrame:
        self._settle()
        c, v, w = self.found[0]
        return pd.DataFrame({"u": self.docs[c], "v": v, "w": w})


def most_alike(sets: DataFrame, n: int, entries: int, k: int, tau: float, min_shared: int = 1) -> DataFrame:
    """(u, v, w) in both directions, among them the k best of each document u (w desc, then v) of token_sets: IDF-weighted Jaccard, to nine
    places, of tau or more, with min_shared tokens in common.

    The documents are dealt into tiles; each pair of tiles meets once, in the one of them that holds its documents by token.  What documents
    have in common is counted there, so no table of pairs arises; a tile sends k rows of each document it has met."""
    spark = sets.sparkSession
    tiles = max(1, math.ceil(entries / TILE_TOKENS), min(spark.sparkContext.defaultParallelism, math.ceil(n / TILE_DOCS)))
    own = sets.withColumn("p", F.pmod(F.xxhash64("doc"), F.lit(tiles)).cast("int"))
    left = own.withColumnRenamed("p", "q").withColumns({"side": F.lit(0), "own": F.lit(True)})
    right = own.drop("dfs").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(tiles // 2)))).filter((F.col("d") * 2 != tiles) | (F.col("p") * 2 < tiles))  # opposite tiles meet once
    right = right.withColumns({"q": ((F.col("p") + F.col("d")) % tiles).cast("int"), "side": F.lit(1), "own": F.col("d") == 0}).drop("p", "d")
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(tiles, "q").sortWithinPartitions("q", "side", "doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, tile = None, [], None
        for batch in batches:
            for (q, side), part in batch.groupby(["q", "side"], sort=True):
                if q != now:
                    if tile is not None:
                        yield tile.hits()
                    now, held, tile = q, [], None
                if side == 0:
                    held.append(part)
                    continue
                if tile is None and held:
                    tile, held = _SetTile(pd.concat(held), n, k, tau, min_shared), []
                if tile is not None:
                    yield from tile.meet(part)
        if tile is not None:
            yield tile.hits()

    return dealt.mapInPandas(run, "u bigint, v bigint, w double")


class _CommonTokens:
    """The most frequent tokens, most frequent first, with their document frequencies; n: documents."""

    def __init__(self, words: list[str], dfs: np.ndarray, n: int, df_min: int, df_max: int | None):
        self.words, self.dfs = words, dfs
        known = np.ones(len(dfs), bool) if df_max is None else dfs <= df_max
        self.idf = np.where(known, np.log(1 + n / np.maximum(dfs, 1)), 0.0)
        self.shareable = known & (dfs >= df_min)

    def places(self, lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(tokens, the list of each, its place among the common tokens or -1)"""
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        return flat, row, pc.fill_null(pc.index_in(flat, value_set=pa.array(self.words, flat.type)), -1).to_numpy()

    def ordered(self, row: np.ndarray, at: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """The common tokens of each list in the order of their places, from the last on if sign is -1."""
        n = len(self.words)
        key = np.sort(row[at >= 0] * n + (at[at >= 0] if sign > 0 else n - 1 - at[at >= 0]))
        row, at = np.divmod(key, max(1, n))
        return row, at if sign > 0 else n - 1 - at

    def lead(self, batches: Iterator[pa.RecordBatch], spare: float) -> Iterator[pa.RecordBatch]:
        """(doc, weight, ids, dfs, rare): the weight of a document's common tokens, the rarest of them, up to the share spare of that weight, and its other tokens."""
        for batch in batches:
            n = batch.num_rows
            flat, row, at = self.places(batch.column("tokens"))
            rare = flat.filter(pa.array(at < 0))
            of_rare = np.bincount(row[at < 0], minlength=n)
            row, at = self.ordered(row, at, -1)
            weight = np.bincount(row, self.idf[at], minlength=n).astype(float)  # whole numbers if there are none
            upto = np.cumsum(self.idf[at]) - self.idf[at]
            start = np.searchsorted(row, np.arange(n))
            before = upto - np.append(upto, 0)[start][row]
            keep = self.shareable[at] & (before <= spare * weight[row] + 1e-6)
            row, at = row[keep], at[keep]
            ends = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            of_lead = ends(np.bincount(row, minlength=n))
            ids, dfs = pa.array(COMMON_IDS + len(self.words) - 1 - at.astype(np.int64)), pa.array(self.dfs[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(weight), pa.ListArray.from_arrays(of_lead, ids), pa.ListArray.from_arrays(of_lead, dfs), pa.ListArray.from_arrays(ends(of_rare), rare)], ["doc", "weight", "ids", "dfs", "rare"]
            )

    def common(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of a document's common tokens instead of its tokens."""
        for batch in batches:
            _, row, at = self.places(batch.column("tokens"))
            row, at = self.ordered(row, at, 1)
            row, at = row[self.shareable[at]], at[self.shareable[at]].astype(np.int32)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
            rest = [c for c in batch.schema.names if c != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], [*rest, "common"])

    def verified(self, batches: Iterator[pd.DataFrame], n: int, tau: float) -> Iterator[pd.DataFrame]:
        """(a, b, jaccard) of the pairs of each tile, whose documents' common tokens (side 0) and other ones (side 1) come before them."""
        now, common, other = None, {}, {}
        for batch in batches:
            found = []
            for (*key, side), part in batch.groupby(["home", "x", "y", "side"], sort=False):
                if key != now:
                    now, common, other = key, {}, {}
                if side == 0:
                    common |= dict(zip(part["a"], part["common"]))
                elif side == 1:
                    other |= {d: (t, i, np.log(1 + n / f)) for d, t, i, f in zip(part["a"], part["total"], part["ids"], part["dfs"])}
                else:
                    for a, b in zip(part["a"], part["b"]):
                        (ta, ia, wa), (tb, ib, _) = other[a], other[b]
                        shared = self.idf[np.intersect1d(common[a], common[b], True)].sum() + wa[np.isin(ia, ib)].sum()
                        found.append((a, b, shared / (ta + tb - shared)))
            yield pd.DataFrame([x for x in found if x[2] >= tau], columns=["a", "b", "jaccard"])


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, tau: float) -> Iterator[pa.RecordBatch]:
    """(token, doc, total, rest) of similar_sets' sets: a document's rarest tokens, as long as the rest of them, themselves included, weighs tau of its total."""
    for batch in batches:
        lists = {c: batch.column(c) for c in ("ids", "rare_ids", "dfs", "rare_dfs")}
        row = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(lists[c].offsets.to_numpy())) for c in ("ids", "rare_ids")])
        token, df = (np.concatenate([lists[c].flatten().to_numpy() for c in pair]) for pair in (("ids", "rare_ids"), ("dfs", "rare_dfs")))
        order = np.lexsort((token, df, row))
        row, token, weight = row[order], token[order], np.log(1 + n / df[order])
        upto = np.cumsum(weight) - weight
        before = upto - np.append(upto, 0)[np.searchsorted(row, np.arange(batch.num_rows))][row]
        total, ones = batch.column("total").to_numpy(), batch.column("ones").to_numpy()
        rest = (total - ones)[row] - before
        keep = rest >= tau * total[row] - 1e-6
        row = row[keep]
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column("doc").take(pa.array(row)), pa.array(total[row]), pa.array(rest[keep])], ["token", "doc", "total", "rest"])


def similar_sets(listed: DataFrame, tau: float, among: DataFrame | None = None, df_min: int = 2, df_max: int | None = None) -> DataFrame:
    """(a < b, jaccard) of token_lists: IDF-weighted Jaccard of tau or more; see weighted_jaccard.  tau must not be 0.

    The COMMON most frequent tokens are looked up by each task, so that just the rare ones move to
    learn their frequencies.  Documents meet by their prefixes; the sets of those that meet are read again and go once to each group of documents (all that have the
    same least candidate) that needs them, where pairs are verified.  No pair carries tokens."""
    spark = listed.sparkSession
    listed = listed.select("doc", "tokens")
    n = listed.agg(F.count("doc")).first()[0]
    each = listed.select("doc", F.explode("tokens").alias("token"))
    known = written(each.groupBy("token").agg(F.count("*").cast("int").alias("df")).filter("df > 1").withColumn("id", F.monotonically_increasing_id()))
    often = known.orderBy(F.col("df").desc(), "id").select("token", "df").limit(COMMON).toPandas()
    held = spark.sparkContext.broadcast(_CommonTokens(often["token"].to_list(), often["df"].to_numpy(np.int32), n, df_min, df_max))
    first = written(listed.mapInArrow(lambda batches: held.value.lead(batches, 1 - tau), f"doc {dict(listed.dtypes)['doc']}, weight double, ids array<bigint>, dfs array<int>, rare array<string>"))
    first = first.join(among.select("doc"), "doc", "left_semi") if among is not None else first
    idf = F.log(1 + F.lit(n) / F.coalesce("df", F.lit(1)))
    rare = first.select("doc", F.explode("rare").alias("token")).join(known, "token", "left")
    rare = rare if df_max is None else rare.filter(F.coalesce("df", F.lit(1)) <= df_max)
    can = F.col("df") >= max(2, df_min)
    rare = rare.groupBy("doc").agg(F.sum(idf).alias("more"), F.sum(F.when(can, 0.0).otherwise(idf)).alias("ones"), F.collect_list(F.when(can, F.col("id"))).alias("rare_ids"), F.collect_list(F.when(can, F.col("df"))).alias("rare_dfs"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    sets = first.drop("rare").join(rare, "doc", "left").withColumn("total", F.col("weight") + F.coalesce("more", F.lit(0.0)))
    sets = written(sets.select("doc", "total", F.coalesce("ones", F.lit(0.0)).alias("ones"), "ids", "dfs", empty("rare_ids", "bigint"), empty("rare_dfs", "int")))

    # Rarest first, a document's prefix ends where what is left weighs less than a pair must share.
    lead = sets.mapInArrow(lambda batches: _prefixes(batches, n, tau), f"token bigint, doc {dict(listed.dtypes)['doc']}, total double, rest double")
    # The lighter of two documents shares 2 tau / (1 + tau) of its weight or more, the heavier one tau; weights differ by tau at most.
    light = lead.filter(F.col("rest") >= 2 * tau / (1 + tau) * F.col("total") - 1e-6).select("token", F.col("doc").alias("b"), F.col("total").alias("tb"))
    met = lead.select("token", F.col("doc").alias("a"), F.col("total").alias("ta")).join(light, "token")
    met = met.filter((F.col("a") != F.col("b")) & (F.col("tb") <= F.col("ta")) & (F.col("tb") >= tau * F.col("ta") - 1e-6))
    near = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    # A pair belongs to the least candidate of either document; large groups are cut into tiles.
    least = near.select(F.col("b").alias("doc"), "a").groupBy("doc").agg(F.min("a").alias("least"))
    of = lambda side: least.select(F.col("doc").alias(side), F.col("least").alias(f"_{side}"))
    homed = near.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.least("a", "_a", "_b").alias("home"))
    cuts = homed.groupBy("home").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).cast("int").alias("cuts"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("cuts")).cast("int")
    pairs = written(homed.join(cuts, "home").select("a", "b", "home", tile("a").alias("x"), tile("b").alias("y")))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc"), "home", "x", "y").distinct()
    few = asked.limit(CANDIDATES + 1).count() <= CANDIDATES
    key = f"doc {dict(listed.dtypes)['doc']}"
    if few:
        texts = listed.join(F.broadcast(asked), "doc").mapInArrow(lambda batches: held.value.common(batches), f"{key}, home {dict(pairs.dtypes)['home']}, x int, y int, common array<int>")
    else:
        texts = listed.mapInArrow(lambda batches: held.value.common(batches), f"{key}, common array<int>").join(asked, "doc")
    others = sets.join(F.broadcast(asked) if few else asked, "doc").select(F.col("doc").alias("a"), "home", "x", "y", F.lit(1).alias("side"), "total", F.col("rare_ids").alias("ids"), F.col("rare_dfs").alias("dfs"))
    dealt = texts.select(F.col("doc").alias("a"), "home", "x", "y", F.lit(0).alias("side"), "common").unionByName(others, allowMissingColumns=True)
    dealt = dealt.unionByName(pairs.withColumn("side", F.lit(2)), allowMissingColumns=True)
    dealt = dealt.repartition(spark.sparkContext.defaultParallelism * 4, "home", "x", "y").sortWithinPartitions("home", "x", "y", "side")
    return dealt.mapInPandas(lambda batches: held.value.verified(batches, n, tau), f"a {key[4:]}, b {key[4:]}, jaccard double")


def weighted_jaccard(tokens: DataFrame, doc: str = "doc", df_min: int = 2, df_max: int | None = None, tau: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """(a < b, jaccard): IDF-weighted Jaccard of documents by an inverted index, tau or more; tokens of one document can't
    join anything and weigh only in the totals, df_max leaves out frequent ones.  among(doc) names the documents to compare, all count for
    the frequencies.

    From PREFIX_FROM on (below, the prefix is most of a document) only tokens of a document's prefix are joined: rarest first, up to the point from which on the rest
    weighs less than a pair must share.  Pairs of similarity tau share one of them, so none is lost; the higher tau, the rarer the tokens
    that are joined at all; the shared weight of candidates is then summed exactly (similar_sets)."""
    if tau >= PREFIX_FROM:
        return similar_sets(token_lists(tokens, doc), tau, among, df_min, df_max)
    rows = written(tokens.select(F.col(doc).alias("doc"), "token").distinct())  # read four times below; as Parquet, as checkpoints are not packed
    n = rows.agg(F.countDistinct("doc").alias("n"))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    df = df.filter(F.col("df") <= df_max) if df_max else df
    rows = rows.join(among.select("doc"), "doc", "left_semi") if among is not None else rows
    weighed = rows.join(df, "token").crossJoin(F.broadcast(n)).withColumn("idf", F.log(1 + F.col("n") / F.col("df")))
    total = weighed.groupBy("doc").agg(F.sum("idf").alias("total"))
    index = weighed.filter(F.col("df") >= df_min)
    met = index.select("token", F.col("doc").alias("a"), "idf").join(index.select("token", F.col("doc").alias("b")), "token").filter("a < b")
    shared = met.groupBy("a", "b").agg(F.sum("idf").alias("shared"))
    both = shared.join(total.withColumnsRenamed({"doc": "a", "total": "ta"}), "a").join(total.withColumnsRenamed({"doc": "b", "total": "tb"}), "b")
    j = F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared"))
    return both.withColumn("jaccard", j).filter(F.col("jaccard") >= tau).select("a", "b", "jaccard")


def compact_runs(seq: DataFrame, key: str, order: list[str], token: str = "token") -> DataFrame:
    """Rows whose token differs from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return seq.withColumn("_before", F.lag(token).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(token))).drop("_before")


def first_occurrence(seq: DataFrame, key: str, at: str, token: str = "token") -> DataFrame:
    return seq.groupBy(key, token).agg(F.min(at).alias(at))


def consensus(seq: DataFrame, block: str, at: str, strand: str, token: str = "token", min_coverage: float = 0.5) -> DataFrame:
    """Per token: coverage over blocks, mean relative place, forward share, df, occurrences, colour.

    seq: (block, at, strand, token); runs of a token are one occurrence, each block counts
    the token's first place."""
    runs = compact_runs(seq, block, [at], token)
    order = Window.partitionBy(block).orderBy(at)
    n = F.count("*").over(Window.partitionBy(block))
    placed = runs.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", n)
    placed = placed.withColumn("_place", F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(0.0))
    first = placed.groupBy(block, token).agg(F.min_by("_place", "_i").alias("_place"), F.min_by(strand, "_i").alias("_strand"), F.count("*").alias("_occ"))
    blocks = seq.agg(F.countDistinct(block).alias("n_blocks"))
    told = first.groupBy(token).agg(
        F.count("*").alias("df"), F.sum("_occ").alias("n_occ"), F.avg("_place").alias("mean_pos"), F.avg((F.col("_strand") > 0).cast("int")).alias("fwd_frac")
    )
    told = told.crossJoin(F.broadcast(blocks)).withColumn("coverage", F.col("df") / F.col("n_blocks"))
    return told.filter(F.col("coverage") >= min_coverage).withColumn("color", F.concat(F.lit("#"), F.substring(F.md5(F.col(token)), 1, 6))).drop("n_blocks")


def family(token: str) -> Column:
    """The family of a ribosomal subunit name (Ribosomal_L5_C counts as Ribosomal_L5); other names stay."""
    found = F.regexp_extract(token, r"(?i)^(Ribosomal_[LS][0-9]+)", 1)
    return F.when(found != "", found).otherwise(F.col(token))


def cluster_consensus(seq: DataFrame, cluster: str, block: str, at: str, strand: str, token: str = "token", min_coverage: float = 0.7, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Consensus of each cluster over all domains of its genes: (tokens, neighbouring pairs).

    seq: (cluster, block, at, strand, token).  Runs of a token are one occurrence; places and strands are averaged over all of them;
    tokens in at least min_coverage of the cluster's blocks stay, the first `most` by mean place; pairs follow that order, with the
    blocks that hold both and the share of those in which the first places have the same strand."""
    rows = seq.withColumn(token, family(token)).filter(F.col(token) != "").withColumn(strand, F.coalesce(strand, F.lit(1)))
    order = Window.partitionBy(cluster, block).orderBy(at, token)
    runs = rows.withColumn("_before", F.lag(token).over(order)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(token)))
    n = F.count("*").over(Window.partitionBy(cluster, block))
    placed = runs.withColumn("_i", F.row_number().over(order) - 1).withColumn("_place", F.when(n > 1, F.col("_i") / (n - 1)).otherwise(0.0))
    placed = cut(placed.select(cluster, block, token, strand, "_i", "_place"))
    blocks = placed.groupBy(cluster).agg(F.countDistinct(block).alias("n_blocks"))
    told = placed.groupBy(cluster, token).agg(
        F.countDistinct(block).alias("df"), F.count("*").alias("n_occ"), F.avg("_place").alias("mean_pos"), F.avg((F.col(strand) >= 0).cast("int")).alias("fwd_frac")
    )
    told = told.join(blocks, cluster).withColumn("coverage", F.col("df") / F.col("n_blocks")).filter(F.col("coverage") >= min_coverage).drop("n_blocks")
    by_place = Window.partitionBy(cluster).orderBy("mean_pos", token)
    told = told.withColumn("rank", F.row_number().over(by_place)).filter(F.col("rank") <= most)
    told = cut(told.withColumn("color", F.concat(F.lit("#"), F.substring(F.md5(F.col(token)), 1, 6))))
    pairs = told.select(cluster, "rank", token, F.lead(token).over(Window.partitionBy(cluster).orderBy("rank")).alias("next_token")).filter("next_token IS NOT NULL")
    first = placed.groupBy(cluster, block, token).agg((F.min_by(strand, "_i") >= 0).alias("_s"))
    met = pairs.join(first, [cluster, token]).join(first.withColumnsRenamed({token: "next_token", "_s": "_next_s"}), [cluster, block, "next_token"])
    held = met.groupBy(cluster, "rank", token, "next_token").agg(F.count("*").alias("support"), F.avg((F.col("_s") == F.col("_next_s")).cast("int")).alias("same_frac"))
    return told, held


def adjacent_pairs(seq: DataFrame, block: str, at: str, strand: str, token: str = "token") -> DataFrame:
    """Neighbouring tokens: support and share on the same strand."""
    order = Window.partitionBy(block).orderBy(at)
    runs = compact_runs(seq, block, [at], token)
    pair = runs.withColumn("next_token", F.lead(token).over(order)).withColumn("_s", F.lead(strand).over(order)).filter("next_token IS NOT NULL")
    return pair.groupBy(token, "next_token").agg(F.count("*").alias("support"), F.avg((F.col(strand) == F.col("_s")).cast("int")).alias("same_frac"))


def canonical_kmers(seq: DataFrame, key: str, order: list[str], k: int, token: str = "token") -> DataFrame:
    """(key, pos, kmer array): windows of k tokens, the smaller of the window and its reverse."""
    w = Window.partitionBy(key).orderBy(*order)
    kmer = F.array(*[F.lead(token, i).over(w) for i in range(k)])
    rows = seq.select(key, (F.row_number().over(w) - 1).alias("pos"), kmer.alias("kmer")).filter(F.get("kmer", F.lit(k - 1)).isNotNull())
    return rows.withColumn("kmer", F.least("kmer", F.reverse("kmer")))


def kmer_support(kmers: DataFrame, key: str, least: int) -> DataFrame:
    rows = kmers.withColumn("kmer", F.array_join("kmer", "|"))
    return rows.groupBy("kmer").agg(F.countDistinct(key).alias("support"), F.count("*").alias("n")).filter(F.col("support") >= least)


def conserved_runs(kmers: DataFrame, key: str, k: int, least: int) -> DataFrame:
    """(key, start, end): maximal runs of places that conserved k-mers cover."""
    from locusweave.operators.intervals import merge_islands

    named = kmers.withColumn("kmer", F.array_join("kmer", "|"))
    good = kmer_support(kmers, key, least).select("kmer")
    held = named.join(good, "kmer", "left_semi").select(key, F.col("pos").alias("start"), (F.col("pos") + (k - 1)).alias("end"))
    return merge_islands(held, [key], 1)


def neighbour_pairs(seq: DataFrame, key: str, at: str, distance: int = 5, token: str = "token") -> DataFrame:
    """(a <= b, n_keys, min_distance): different tokens within distance on a key, by shifted windows
    instead of a range self-join."""
    w = Window.partitionBy(key).orderBy(at)
    near = F.array(*[F.struct(F.lead(token, d).over(w).alias("t"), F.lit(d).alias("d")) for d in range(1, distance + 1)])
    seen = seq.select(key, F.col(token).alias("x"), near.alias("near"))
    rows = seen.select(key, "x", F.explode(F.filter("near", lambda y: y["t"] != F.col("x"))).alias("y"))
    least = rows.groupBy(key, F.least("x", "y.t").alias("a"), F.greatest("x", "y.t").alias("b")).agg(F.min("y.d").alias("d"))
    return least.groupBy("a", "b").agg(F.count("*").alias("n_keys"), F.min("d").alias("min_distance"))


def sub_blocks(anchors: DataFrame, block: str, q: str, t: str, gap: int = 10) -> DataFrame:
    """(block, sub, n, q_start, q_end): cut where either side jumps by more than gap."""
    w = Window.partitionBy(block).orderBy(q, t)
    jump = (F.col(q) - F.lag(q).over(w) > gap) | (F.abs(F.col(t) - F.lag(t).over(w)) > gap)
    cuts = anchors.withColumn("_cut", F.coalesce(jump.cast("int"), F.lit(0))).withColumn("sub", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cuts.groupBy(block, "sub").agg(F.count("*").alias("n"), F.min(q).alias("q_start"), F.max(q).alias("q_end"))


def coherence(anchors: DataFrame, block: str, q: str, t: str) -> DataFrame:
    """Diagonal coherence: order violations, largest gaps, median absolute deviation of t - q and t + q.

    A block's anchors are one sorted array (a contig bounds them), so one shuffle serves all measures."""

    def median(x):
        s = F.array_sort(x)
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    def bound(x, f):
        """f of x, x computed once."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def deviation(a, sign):
        line = F.transform(a, lambda x: (x["t"] + sign * x["q"]).cast("double"))
        return bound(line, lambda v: bound(median(v), lambda m: median(F.transform(v, lambda x: F.abs(x - m)))))

    held = anchors.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(F.col(q).alias("q"), F.col(t).alias("t")))).alias("a")).withColumn("n", F.size("a").cast("bigint"))
    steps = F.zip_with(F.slice("a", F.lit(2), F.size("a")), F.col("a"), lambda x, y: F.struct((x["t"] - y["t"]).alias("t"), (x["q"] - y["q"]).alias("q")))
    held = held.withColumn("d", F.filter(steps, lambda x: x["t"].isNotNull()))
    count = lambda test: F.size(F.filter("d", test)).cast("bigint")
    out = held.select(
        block, "n", F.array_max(F.transform("d", lambda x: F.abs(x["t"]))).alias("max_gap_t"), F.array_max(F.transform("d", lambda x: x["q"])).alias("max_gap_q"),
        F.least(count(lambda x: x["t"] > 0), count(lambda x: x["t"] < 0)).alias("violations"), F.least(deviation(F.col("a"), -1), deviation(F.col("a"), 1)).alias("mad"),
    )
    return out.withColumn("coherent", (F.col("violations") <= 0.1 * F.col("n")) & (F.col("mad") < 3))


def explorer_summary(pairs: DataFrame, consensus_rows: DataFrame, size: int) -> DataFrame:
    """Directional agreement of well-supported pairs and a quality score, as one row."""
    agree = pairs.filter("support >= 3").agg(F.coalesce(F.avg("same_frac"), F.lit(0.0)).alias("agree"))
    cover = consensus_rows.agg(F.coalesce(F.median("coverage"), F.lit(0.0)).alias("median_coverage"))
    row = agree.crossJoin(cover)  # two single rows
    label = F.when(F.col("agree") >= 0.6, "strong").when(F.col("agree") >= 0.4, "mixed").otherwise("weak")
    quality = 0.5 * F.col("median_coverage") + 0.3 * F.col("agree") + 0.2 * F.least(F.lit(1.0), F.log1p(F.lit(float(size))) / 5)
    return row.withColumn("direction", label).withColumn("quality", fixed(quality))


def block_consensus(seq: DataFrame, block: str, role: str, at: str, strand: str, token: str = "token") -> DataFrame:
    """Per block the tokens that both sides hold: mean place on each side and whether strands agree."""
    order = Window.partitionBy(block, role).orderBy(at)
    n = F.count("*").over(Window.partitionBy(block, role))
    placed = seq.withColumn("_i", F.row_number().over(order) - 1).withColumn("_p", F.when(n > 1, F.col("_i") / (n - 1)).otherwise(0.0))
    first = placed.groupBy(block, role, token).agg(F.min_by("_p", "_i").alias("p"), F.min_by(strand, "_i").alias("s"))
    side = lambda r: F.max(F.when(F.col(role) == r, F.struct("p", "s")))
    both = first.groupBy(block, token).agg(side("query").alias("q"), side("target").alias("t")).filter("q IS NOT NULL AND t IS NOT NULL")
    return both.select(block, token, F.col("q.p").alias("query_pos"), F.col("t.p").alias("target_pos"), (F.col("q.s") == F.col("t.s")).alias("same_strand"))
