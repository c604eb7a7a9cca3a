"""Queries opN_<name> over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.llm import (
    ball_kmeans, chat_format, decontaminate, divergence, exact_dedup, language_id, license_scan, pii, simhash_dedup, source_mix, substring_dedup, token_output, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def repeat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat at 20 words, 40, 80, ... until none is left."""
    return substring_dedup.longest_repeats(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of each source, as op5_source_mix takes it."""
    docs = _table(spark, sf_dir, "documents").select("source", source_mix.word_count(F.col("text")).alias("size"))
    found = source_mix.targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    return found.withColumn("target", F.round("target", 3))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    kinds = dict(turns.dtypes)
    forged = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(forged)))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenize(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_language_id, op3_exact_dedup, op4_pii, op5_source_mix, op6_decontaminate,
        op7_license_scan, op8_simhash_dedup, op9_chat_format, op10_token_output, op11_ball_kmeans, op12_toxicity, op13_divergence,
        pii_base_spans, repeat_levels, source_targets,
    )
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_ESCAPED = r"replace(replace(coalesce({}, ''), '\', '\b'), '<', '\l')"

# Base patterns of personal data; between the pieces that a pattern splits a text into stand its matches.
_FOUND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS_OF = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[len(d) + 1 - i] AS INTEGER)
  ELSE CAST(d[len(d) + 1 - i] AS INTEGER) * 2 - 9 * CAST(CAST(d[len(d) + 1 - i] AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0"""
_FITS = {
    "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INTEGER) > 255)) = 0",
    "card": f"len(d) BETWEEN 16 AND 19 AND {_LUHN}", "phone": "len(d) BETWEEN 8 AND 15",
}
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {n} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT *, {_DIGITS_OF} AS d FROM (
      SELECT doc_id, l[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, l, g, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS l, string_split_regex(t, '{p}') AS g FROM d)))) WHERE {_FITS[kind]}"""
    for n, (kind, p) in enumerate(_FOUND.items())
)

# Rounds of k-means: d{i} has the cluster of each vector by the centroids c{i}; a centroid is a list, floored towards minus infinity.
_ROUND = """d{i} AS MATERIALIZED (SELECT r, vec_id, q, a.c AS cluster, a.d AS distance FROM (SELECT r, vec_id, q, min(struct_pack(d := d, c := c)) AS a FROM (
        SELECT r, vec_id, any_value(q) AS q, c, sum((x - y) * (x - y))::BIGINT AS d FROM (SELECT v.r, v.vec_id, v.q, n.c, unnest(v.q) AS x, unnest(n.q) AS y FROM v, c{i} n) GROUP BY r, vec_id, c) GROUP BY ALL))"""
_STEP = """c{j} AS MATERIALIZED (SELECT c, coalesce(m.q, n.q) AS q FROM c{i} n LEFT JOIN (SELECT cluster, list(s ORDER BY k) AS q FROM (
        SELECT cluster, k, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS s FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS k FROM d{i}) GROUP BY ALL) GROUP BY cluster) m ON m.cluster = n.c)"""

ORACLES: dict[str, str] = {
    "op11_ball_kmeans": f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM v ORDER BY sha256('3:' || vec_id), q LIMIT 8),
      {", ".join(_ROUND.format(i=i) + ", " + _STEP.format(i=i, j=i + 1) for i in range(10))}, {_ROUND.format(i=10)}
      SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(n.q, ',')) AS centroid_sha256 FROM d10 JOIN c10 n ON n.c = d10.cluster""",
    "op13_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
      w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
      kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 10),
      v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
      n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
      size AS (SELECT lang, source, sum(n) AS s FROM n GROUP BY ALL), lsize AS (SELECT lang, sum(s) AS s FROM size GROUP BY ALL), ln AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
      p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (coalesce(size.s, 0) + 2 * v.v) AS BIGINT) AS p
        FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
        LEFT JOIN size ON size.lang = g.lang AND size.source = g.source),
      q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (ln.n + 2)) // (lsize.s + 2 * v.v) AS BIGINT) AS q FROM ln JOIN lsize USING (lang) JOIN v USING (lang)),
      sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
      terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
      SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
      QUALIFY part = 'pair' OR rank <= 10""",
    "pii_base_spans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({_SPANS}),
      n AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _FOUND)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS l FROM spans GROUP BY 1)
      SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _FOUND)}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "source_targets": f"""WITH RECURSIVE s AS (SELECT source, CAST(sum(coalesce(len({_WORDS}), 0)) AS BIGINT) AS source_size FROM documents GROUP BY 1),
      o AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER) AS weight FROM s), total AS (SELECT sum(source_size) AS n FROM s),
      fill(k, stopped) AS (SELECT 0, CAST([] AS INTEGER[]) UNION ALL SELECT k + 1, next FROM (
        SELECT k, stopped, (SELECT list(i) FROM (SELECT row_number() OVER (ORDER BY source NULLS LAST) AS i, * FROM o) x
          WHERE 3 * source_size < weight * ((SELECT n FROM total) - coalesce((SELECT sum(3 * source_size) FROM (SELECT row_number() OVER (ORDER BY source NULLS LAST) AS i, * FROM o) WHERE list_contains(stopped, CAST(i AS INTEGER))), 0))
            / (SELECT sum(weight) FROM (SELECT row_number() OVER (ORDER BY source NULLS LAST) AS i, * FROM o) WHERE NOT list_contains(stopped, CAST(i AS INTEGER)))) AS next FROM fill)
        WHERE len(next) > len(stopped)),
      last AS (SELECT stopped FROM fill ORDER BY k DESC LIMIT 1), x AS (SELECT row_number() OVER (ORDER BY source NULLS LAST) AS i, * FROM o),
      level AS (SELECT ((SELECT n FROM total) - coalesce(sum(3 * source_size) FILTER (list_contains(stopped, CAST(i AS INTEGER))), 0)) / sum(weight) FILTER (NOT list_contains(stopped, CAST(i AS INTEGER))) AS l FROM x, last)
      SELECT source, source_size, weight, round(CASE WHEN list_contains(stopped, CAST(i AS INTEGER)) THEN 3.0 * source_size ELSE weight * l END, 3) AS target FROM x, last, level""",
    "op1_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
      win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM starts),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM win WHERE k > 1),
      word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS line, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op3_exact_dedup": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
      SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON g.t = d.t""",
    "op6_decontaminate": r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
      b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
      items AS (SELECT item_id, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m FROM b WHERE len(w) > 0),
      grams AS (SELECT item_id, k, m, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM items) GROUP BY ALL),
      texts AS (SELECT doc_id, k, len(w) - k + 1 AS size, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
      hits AS (SELECT doc_id, item_id, pos, gram, c, m, least(m, size) AS span, size FROM texts JOIN grams USING (k, gram)),
      starts AS (SELECT DISTINCT doc_id, item_id, least(pos, size - span) AS s, span, m FROM hits),
      held AS (SELECT doc_id, item_id, s, starts.m, starts.span, gram, least(count(*), any_value(c)) AS n
        FROM starts JOIN hits USING (doc_id, item_id) WHERE pos BETWEEN s AND s + starts.span - 1 GROUP BY doc_id, item_id, s, starts.m, starts.span, gram),
      win AS (SELECT doc_id, item_id, s, sum(held.n) / (m + span - sum(held.n)) AS similarity FROM held GROUP BY doc_id, item_id, s, m, span)
      SELECT doc_id, item_id, count(*) AS n_windows, min(s) AS first_word, max(similarity) AS similarity FROM win WHERE similarity >= 0.8 GROUP BY doc_id, item_id""",
    "op9_chat_format": rf"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<turn>' || replace({_ESCAPED.format('role')}, chr(10), '\n') || chr(10) || {_ESCAPED.format('text')} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
      FROM c GROUP BY conv_id""",
}
