"""Benchmark decontamination by SimHash of item-sized windows (DataFrame only).

Texts are lower-cased words of letters and digits; shingles are five words (an item with fewer words is one shingle of
them all).  Repeated shingles are numbered, so that multiplicities count in sets of (shingle, number).  Similarity is the sum of
the smaller over the sum of the larger multiplicities.

1. Which texts and items can meet at all: of an item's numbered shingles, sorted by how many items hold them, a window of
   similarity 0.8 holds one of the first fifth or so (prefix filter); only those few shingles are looked up in the texts.
2. Windows as long as the item are set at the item's shingles in such a text: of any other window the next one of these
   holds as many.  Running sums of the hits leave those that hold enough of them to reach the similarity.
3. Each window and item gets a 64-bit SimHash of its numbered shingles.  A window and its item meet over radius+1 bit blocks:
   any pair within the radius agrees on at least one, so none is missed.
4. Pairs within it are verified by their exact weighted-shingle similarity.

The radius of 24 bits is five standard deviations above the distance expected at similarity 0.8.  (Blocks alone, without the item,
would be two or three bits each: at a radius that 0.8 needs, no index.)

Defined cases: null or wordless texts match nothing; a document shorter than an item is one window as long as it is; rows with equal
id and text count once, as do equal rows of the benchmark; extra columns are ignored; an empty benchmark or table gives no rows; a
very long text is one array of its shingles (8 bytes a word), its windows are as many as its hits.  The looked-up shingles
of the benchmark are broadcast up to SHINGLES_BROADCAST rows, the names of candidate texts up to TEXTS_BROADCAST (16 bytes
each, both counted first); beyond that the joins shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import materialize

SHINGLES_BROADCAST = 500_000
TEXTS_BROADCAST = 200_000
SIMILARITY = 0.8
RADIUS = 24
WIDTH = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(w: Column, k: int) -> Column:
    """Hashes of the runs of k words of the word array w; w is bound once."""

    def runs(a: Column) -> Column:
        def one(i: Column) -> Column:
            return F.xxhash64(*[F.get(a, i + j) for j in range(k)])

        return F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(0), F.size(a) - k), one)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(w), runs), F.lit(0))


def simhash(sh: Column) -> Column:
    """64-bit SimHash of an array of hashes: two 32-bit counters grow in each of 32 sums."""
    lanes = 0x0000000100000001
    n = F.size(sh)

    def counters(j: int) -> Column:
        return F.aggregate(sh, F.lit(0).cast("bigint"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(lanes)))

    def fold(s: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for j in range(32):
            for lane in range(2):
                c = F.shiftrightunsigned(F.get(s, F.lit(j)), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
                out = out.bitwiseOR(F.when(c * 2 > n, F.shiftleft(F.lit(1).cast("bigint"), 32 * lane + j)).otherwise(F.lit(0).cast("bigint")))
        return out

    return F.get(F.transform(F.array(F.array(*[counters(j) for j in range(32)])), fold), F.lit(0))


def _blocks(fp: Column, radius: int) -> Column:
    """radius+1 structs (block, value) that cover the 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(b).alias("b"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
        for b, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(by, h), h repeated -> (by, h, g): g is the hash of h and its number among the equal ones of its group."""
    counted = rows.groupBy(*by, "h").agg(F.count("*").alias("_c"))
    return counted.select(*by, "h", F.explode(F.sequence(F.lit(1).cast("bigint"), "_c")).alias("_o")).select(*by, "h", F.xxhash64("h", "_o").alias("g"))


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(key, item, k, m, sh) of each distinct item with words: m shingles sh of k words."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0).distinct()
    items = items.withColumn("k", F.least(F.size("w"), F.lit(WIDTH)))
    shingled = F.array().cast("array<bigint>")
    for k in range(1, WIDTH + 1):
        shingled = F.when(F.col("k") == k, _shingles(F.col("w"), k)).otherwise(shingled)
    items = items.withColumn("sh", shingled).select(F.monotonically_increasing_id().alias("key"), "item", "k", F.size("sh").alias("m"), "sh")
    return materialize(items, "bench-items")


def _probes(items: DataFrame, similarity: float) -> DataFrame:
    """(k, h, key): shingles of an item of which every window similar to it holds one."""
    tokens = _numbered(items.select("key", "k", "m", F.explode("sh").alias("h")), ["key", "k", "m"])
    held = tokens.groupBy("k", "h").agg(F.count_distinct("key").alias("df"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "h", "g"))
    first = F.col("m") - F.ceil(similarity * F.col("m") - 1e-9) + 1
    return tokens.join(held, ["k", "h"]).withColumn("rank", rank).filter(F.col("rank") <= first).select("k", "h", "key").distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document (id and text) and item that it contains: id_col, item_id, n_windows (similar ones, see 2.), first_word
    (where the first of them starts), similarity (the largest), text_hash (xxhash64 of the text)."""
    items = _items(benchmark, item_col, item_text)
    probes = materialize(_probes(items, similarity), "bench-probes")
    sizes = {r[0]: r[1] for r in probes.groupBy("k").count().collect()}  # at most WIDTH rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    pairs = None
    for k in sorted(sizes) or [WIDTH]:
        asked = probes.filter(F.col("k") == k).select("h", "key")
        asked = F.broadcast(asked) if sum(sizes.values()) <= SHINGLES_BROADCAST else asked
        met = texts.select("_id", "_th", F.explode(_shingles(words(F.col("_text")), k)).alias("h")).join(asked, "h")
        met = met.select("_id", "_th", F.lit(k).alias("k"), "key").distinct()
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = materialize(pairs, "bench-pairs")
    held = _held(texts, pairs.select("_id", "_th", "k").distinct())
    windows = materialize(_windows(pairs, held, items, similarity).withColumn("wid", F.monotonically_increasing_id()), "bench-windows")
    return (
        _verified(windows, held, items, similarity, radius)
        .groupBy("_id", "_th", "item")
        .agg(F.count("*").alias("n_windows"), F.min("s").cast("bigint").alias("first_word"), F.max("similarity").alias("similarity"))
        .select(F.col("_id").alias(id_col), F.col("item").alias(item_col), "n_windows", "first_word", "similarity", F.col("_th").alias("text_hash"))
    )


def _same(a: DataFrame, b: DataFrame, *also: str) -> Column:
    on = a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])
    for c in also:
        on = on & (a[c] == b[c])
    return on


def _held(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(_id, _th, k, sh, size) of the named texts, once each."""
    few = named.limit(TEXTS_BROADCAST + 1).count() <= TEXTS_BROADCAST
    met = texts.join(F.broadcast(named) if few else named, _same(texts, named)).select(texts["_id"], texts["_th"], "k", words(F.col("_text")).alias("w"))
    shingled = _shingles(F.col("w"), WIDTH)
    for k in range(1, WIDTH):
        shingled = F.when(F.col("k") == k, _shingles(F.col("w"), k)).otherwise(shingled)
    met = met.dropDuplicates(["_id", "_th", "k"]).select("_id", "_th", "k", shingled.alias("sh"))
    return materialize(met.withColumn("size", F.size("sh")), "bench-texts")


def _windows(pairs: DataFrame, held: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(_id, _th, k, key, s, span): windows that hold enough of their item's shingles."""
    told = pairs.join(held, _same(pairs, held, "k")).select(pairs["_id"], pairs["_th"], pairs["k"], "key", "size", "sh")
    told = told.join(items.select("key", "m", F.array_distinct("sh").alias("ish")), "key")
    places = F.filter(F.transform("sh", lambda x, i: F.when(F.array_contains("ish", x), i)), lambda x: x.isNotNull())
    hits = told.select("_id", "_th", "k", "key", "m", F.least("m", "size").alias("span"), "size", F.explode(places).alias("pos"))
    s = F.least(F.col("pos"), F.col("size") - F.col("span"))
    point = lambda p, s, ask: F.struct(p.alias("p"), s.alias("s"), F.lit(ask).alias("ask"))  # noqa: E731  ask 0: a hit; -1, 1: hits before p
    points = F.array(point(F.col("pos"), F.lit(None).cast("int"), 0), point(s, s, -1), point(s + F.col("span"), s, 1))
    name = ["_id", "_th", "k", "key", "m", "span"]
    order = Window.partitionBy("_id", "_th", "key").orderBy("p", F.col("ask") == 0).rowsBetween(Window.unboundedPreceding, 0)
    walked = hits.select(*name, F.explode(points).alias("x")).select(*name, "x.*")
    walked = walked.withColumn("before", F.sum((F.col("ask") == 0).cast("bigint")).over(order)).filter("ask <> 0")
    at = lambda ask: F.max(F.when(F.col("ask") == ask, F.col("before")))
    counted = walked.groupBy(*name, "s").agg((at(1) - at(-1)).alias("n"))
    least = F.ceil(similarity / (1 + similarity) * (F.col("m") + F.col("span")) - 1e-9)
    return counted.filter(F.col("n") >= least).select("_id", "_th", "k", "key", "s", "span")


def _verified(windows: DataFrame, held: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """windows with item and similarity, of those that are similar to it."""
    cut = windows.join(held, _same(windows, held, "k")).select("wid", F.explode(F.slice("sh", F.col("s") + 1, F.col("span"))).alias("h"))
    sets = lambda rows, by: _numbered(rows, [by]).groupBy(by).agg(F.collect_list("g").alias("g")).withColumn("fp", simhash(F.col("g")))
    wanted = materialize(sets(cut, "wid"), "bench-prints").join(windows, "wid")
    known = materialize(sets(items.select("key", F.explode("sh").alias("h")), "key"), "bench-item-prints").join(items.select("key", "item"), "key")
    asked = wanted.select("wid", "key", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("x")).select("wid", "key", "fp", "x.*")
    index = known.select("key", F.col("fp").alias("ifp"), F.explode(_blocks(F.col("fp"), radius)).alias("x")).select("key", "ifp", "x.*")
    near = asked.join(index, ["key", "b", "v"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("wid").distinct()
    shared = F.size(F.array_intersect("g", "ig"))
    checked = wanted.join(near, "wid", "left_semi").join(known.select("key", "item", F.col("g").alias("ig")), "key")
    checked = checked.withColumn("similarity", shared / (F.size("g") + F.size("ig") - shared))
    return checked.filter(F.col("similarity") >= similarity).select("_id", "_th", "item", "s", "similarity")
