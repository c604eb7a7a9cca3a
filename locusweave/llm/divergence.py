"""Audit of how the sources of a language differ in their words, by DuckDB over hash shards.

Scan tasks merge the term counts of their documents; (language, term) decides the shard, so every shard has all counts of its terms.
In each shard DuckDB sums them, drops terms of too few documents and writes a row for each kept term with the counts of its
sources.  Spark adds up the sizes of groups from these rows.  A second pass hands each task some rows, with the sizes of the
language's groups, to DuckDB again, which forms the probabilities and sends partial sums for each pair of sources and the best terms
of each source; Spark merges sums and ranks.

    p = 1 + floor(10^9 (count + 2) / (N + 2 V)),  f = floor((p - q)^2 / (p + q)),  in integers throughout.

Defined cases: null text, lang and source count as ''; a document without a term makes its group occur.  Repeated rows count as documents of
their own.  A language without kept terms has value 0 for every pair; a language with one source has no pair rows.  Ties of value go by the item's UTF-8
bytes.  Whole texts are read, long ones in slices that are cut between terms.  An empty table makes an empty result.  Further columns of
the input are not read, whatever their names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import as_bytes, estimated_bytes, give_back, materialize, parts, small_batches

LEAST_DOCS = 10  # documents of the language that a term needs
BEST = 10  # terms told of each group
SHARD_BYTES = 16 << 20  # input for each shard
HELD = 400_000  # terms that a scan task holds before it sends their counts
SLICE = 4 << 20  # bytes of a text cut into terms at once
CELLS = 1_000_000  # pairs of sources times terms that one statement makes
MEMORY = "512MB"  # of DuckDB in a task

#: Bytes that end a term become blanks, capitals small letters; bytes of 0x80 and above belong to terms.
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        end = at + SLICE
        folded = text[at:end].translate(_FOLD)
        if end < len(text) and (cut := folded.rfind(b" ")) >= 0:
            folded, end = folded[:cut], at + cut + 1
        elif end < len(text):  # one term fills the slice: take all of it
            rest = text[end:].translate(_FOLD)
            stop = rest.find(b" ")
            stop = len(rest) if stop < 0 else stop
            folded, end = folded + rest[:stop], end + stop
        yield folded.split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches(lang, source, text) to (lang, source, term, n, docs), merged over what a task has read since it last sent."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(v, pa.string()), len(n)) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=_COUNTS)

    for batch in batches:
        names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for name, text in zip(names, as_bytes(batch.column("text"))):
            n, docs = held.setdefault(name, (Counter(), Counter()))
            size -= len(n)
            found = list(_pieces(text))
            for words in found:
                n.update(words)
            docs.update(set(found[0]) if len(found) == 1 else {w for words in found for w in words})
            size += len(n)
            if size > HELD:
                yield from sent()
                held, size = {}, 0
    yield from sent()
    give_back()


def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})


def _kept(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A shard of term counts to its kept terms: (lang, term, n, of), of the counts of the sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duck()
        db.execute("CREATE TABLE c (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            if batch.num_rows:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO c SELECT lang, source, term, n, docs FROM batch")
                db.unregister("batch")
        out = db.sql(
            f"""WITH s AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM c GROUP BY ALL)
            SELECT lang, term, sum(n)::BIGINT AS n, list({{'source': source, 'n': n}} ORDER BY source) AS of FROM s GROUP BY lang, term HAVING sum(docs) >= {int(least)}"""
        ).to_arrow_table()
        db.close()
        yield from out.cast(_KEPT).to_batches(max_chunksize=10_000)
        give_back()

    return run


_ENTRY = pa.struct([("source", pa.string()), ("n", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("of", pa.list_(_ENTRY))])
_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

_SHARE = "(1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * terms))::BIGINT"
_DISTANCE = "(({0}.{1} - {2}.{3}) * ({0}.{1} - {2}.{3})) // ({0}.{1} + {2}.{3})"
#: p of each group and q of the language, for each term of some rows and all sources of the language.
_SHARES = f"""CREATE OR REPLACE TABLE t AS
    WITH r AS (SELECT row_number() OVER () AS k, * FROM rows),
    g AS (SELECT k, lang, term, n AS all_n, size AS all_size, terms, unnest(groups, recursive := true) FROM r),
    e AS (SELECT k, unnest("of", recursive := true) FROM r)
    SELECT g.k, lang, term, g.source, coalesce(e.n, 0) AS n, {_SHARE.format("coalesce(e.n, 0)", "g.n")} AS p, {_SHARE.format("all_n", "all_size")} AS q
    FROM g LEFT JOIN e ON g.k = e.k AND g.source = e.source"""
_PAIRS = f"""INSERT INTO pairs SELECT a.lang, a.source, b.source, sum({_DISTANCE.format("a", "p", "b", "p")})::BIGINT
    FROM t AS a JOIN t AS b ON a.k = b.k AND a.source < b.source GROUP BY ALL"""
_TERMS = f"""CREATE OR REPLACE TABLE best AS SELECT * FROM (SELECT * FROM best UNION ALL
    SELECT lang, source, term, {_DISTANCE.format("t", "p", "t", "q")} FROM t WHERE n > 0 AND p > q)
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= """


def _compared(best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of kept terms with the groups of their language to partial sums of pairs (source < item) and the best terms of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duck()
        db.execute("CREATE TABLE pairs (lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")
        db.execute("CREATE TABLE best (lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                most = max(len(g) for g in batch.column("groups").slice(at, 1000))
                step = min(1000, max(1, CELLS // max(1, most * most)))
                db.register("rows", pa.Table.from_batches([batch.slice(at, step)]))
                db.execute(_SHARES)
                db.execute(_PAIRS)
                db.execute(_TERMS + str(int(best)))
                db.unregister("rows")
                at += step
        told = db.sql(
            """SELECT lang, source, 'pair' AS part, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL
            UNION ALL SELECT lang, source, 'term', item, value FROM best"""
        ).to_arrow_table()
        db.close()
        yield from told.cast(_PART).to_batches()
        give_back()

    return run


def divergence(documents: DataFrame, least: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one (part `pair`), and the
    terms that it has more of than its language (part `term`, ranks up to best)."""
    named = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shards = parts(estimated_bytes(documents.select("lang", "source", "text")), SHARD_BYTES, 8)
    counted = small_batches(named).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    kept = materialize(counted.repartition(shards, "lang", "term").mapInArrow(_kept(least), "lang string, term string, n bigint, of array<struct<source:string,n:bigint>>"), "kept-terms")

    sizes = kept.select("lang", F.explode("of").alias("o")).groupBy("lang", F.col("o.source").alias("source")).agg(F.sum("o.n").alias("n"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = materialize(groups, "groups")
    # one entry for each source of a language, as the result has one for each pair of them
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    # a language may have most of the terms, so its row is sent once for each salt
    salted = listed.join(whole, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).join(salted, ["lang", "salt"])
    rows = rows.select("lang", "term", "n", "of", "groups", "size", "terms")
    told = materialize(rows.mapInArrow(_compared(best), "lang string, source string, part string, item string, value bigint"), "divergence")

    sums = told.filter("part = 'pair'").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("value"))
    side = groups.select("lang", "source")
    pairs = side.join(side.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    pairs = pairs.withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")}).join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    ranked = pairs.unionByName(told.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return ranked.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= best))
