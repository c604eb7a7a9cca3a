"""SQL of the chain stages for the driver's comparison: CTEs that build on each other, for WITH RECURSIVE.

The dynamic program and the greedy selections walk their rows by recursion and carry what later rows need in lists."""

from __future__ import annotations

_PAIR_KEY = "query_genome || ' ' || target_genome || ' ' || query_contig || ' ' || target_contig"
_GROUP = "query_genome, target_genome, query_contig, target_contig"


def chains_sql(anchors: str, gap: int = 2, scale: float = 0.0) -> str:
    """CTEs prep to chain over a CTE anchors: streams, the chain program, and the owner of each anchor (the first end in reading order
    among its descendants)."""
    cost = f"{scale} * log2(greatest(p.q - x.q, p.t - x.t))"
    return f"""{anchors},
    an AS (SELECT *, {_PAIR_KEY} AS pk, count(*) OVER (PARTITION BY {_GROUP}) AS n1 FROM anchors),
    an2 AS (SELECT *, orientation < 0 AS rev, row_number() OVER (PARTITION BY pk, query_idx, target_idx ORDER BY similarity DESC, query_gene_id, target_gene_id) AS r1 FROM an WHERE n1 >= 2),
    an3 AS (SELECT *, row_number() OVER (PARTITION BY pk, rev, query_idx ORDER BY similarity DESC, target_idx, query_gene_id, target_gene_id) AS r2 FROM an2 WHERE r1 = 1),
    an4 AS (SELECT *, count(*) OVER (PARTITION BY pk, rev) AS n2 FROM an3 WHERE r2 = 1),
    prep AS (SELECT *, query_idx AS q, CASE WHEN rev THEN -target_idx ELSE target_idx END AS t, row_number() OVER (PARTITION BY pk, rev ORDER BY query_idx) AS i FROM an4 WHERE n2 >= 2),
    dp(pk, rev, i, best, held) AS (
      SELECT pk, rev, i, struct_pack(len := 1, score := similarity, i := CAST(0 AS BIGINT)), [struct_pack(q := q, t := t, len := 1, score := similarity, i := i)] FROM prep WHERE i = 1
      UNION ALL
      SELECT pk, rev, i, best, list_append(held, struct_pack(q := q, t := t, len := best.len, score := best.score, i := i))[-{gap + 1}:] FROM (
        SELECT p.pk, p.rev, p.i, p.q, p.t, dp.held, list_sort(list_append(list_transform(list_filter(dp.held, lambda x: p.q - x.q - 1 <= {gap} AND p.t - x.t - 1 BETWEEN 0 AND {gap}),
          lambda x: struct_pack(len := x.len + 1, score := x.score + p.similarity - {cost}, i := x.i)), struct_pack(len := 1, score := p.similarity, i := CAST(0 AS BIGINT))), 'DESC')[1] AS best
        FROM dp JOIN prep p ON p.pk = dp.pk AND p.rev = dp.rev AND p.i = dp.i + 1)),
    place AS (SELECT pk, rev, i, best.i AS pred, row_number() OVER (PARTITION BY pk, rev ORDER BY best.len DESC, best.score DESC, i) AS prio FROM dp),
    up(pk, rev, prio, a) AS (SELECT pk, rev, prio, i FROM place UNION ALL SELECT up.pk, up.rev, up.prio, place.pred FROM up JOIN place ON place.pk = up.pk AND place.rev = up.rev AND place.i = up.a AND place.pred > 0),
    owner AS (SELECT pk, rev, a AS i, min(prio) AS prio FROM up GROUP BY 1, 2, 3),
    chain AS (SELECT pk, {_GROUP}, rev, prio, count(*) AS n_anchors, sum(similarity) AS score, min(query_idx) AS qs, max(query_idx) AS qe, min(target_idx) AS ts, max(target_idx) AS te,
      string_agg(query_idx, ',' ORDER BY query_idx) AS anchor_query_ids, string_agg(target_idx, ',' ORDER BY target_idx) AS anchor_target_ids,
      string_agg(query_gene_id, ',' ORDER BY query_gene_id) AS anchor_query_gene_ids, string_agg(target_gene_id, ',' ORDER BY target_gene_id) AS anchor_target_gene_ids
      FROM prep JOIN owner USING (pk, rev, i) GROUP BY ALL HAVING count(*) >= 2)"""


def blocks_sql(anchors: str) -> str:
    """chains_sql and the greedy selection: CTE blocks."""
    return f"""{chains_sql(anchors)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY score DESC, rev, prio) AS r FROM chain),
    pick(pk, r, ok, held) AS (SELECT pk, r, true, [struct_pack(a := qs, b := qe, c := ts, d := te)] FROM ranked WHERE r = 1
      UNION ALL SELECT pk, r, ok, CASE WHEN ok THEN list_append(held, struct_pack(a := qs, b := qe, c := ts, d := te)) ELSE held END FROM (
        SELECT x.pk, x.r, x.qs, x.qe, x.ts, x.te, pick.held, len(list_filter(pick.held, lambda h: (x.qs <= h.b AND h.a <= x.qe) OR (x.ts <= h.d AND h.c <= x.te))) = 0 AS ok
        FROM pick JOIN ranked x ON x.pk = pick.pk AND x.r = pick.r + 1)),
    blocks AS (SELECT ranked.*, row_number() OVER (ORDER BY {_GROUP}, ranked.r) - 1 AS block_id, CASE WHEN rev THEN -1 ELSE 1 END AS orientation,
      qs AS query_start, qe AS query_end, ts AS target_start, te AS target_end FROM ranked JOIN pick ON pick.pk = ranked.pk AND pick.r = ranked.r WHERE ok)"""


def components_sql(nodes: str, edges: str, prefix: str) -> str:
    """CTE {prefix}comp(node, root) over ids of a query and edges (u, v) of a CTE."""
    return f"""{prefix}links AS (SELECT u, v FROM {edges} UNION ALL SELECT v, u FROM {edges}),
    {prefix}reach(node, root) AS (SELECT id, id FROM ({nodes}) UNION SELECT l.v, r.root FROM {prefix}reach r JOIN {prefix}links l ON l.u = r.node WHERE r.root < l.v),
    {prefix}comp AS (SELECT node, min(root) AS root FROM {prefix}reach GROUP BY node)"""


def clusters_sql(anchors: str) -> str:
    """CTE clustered: blocks with cluster_id, by mutual Jaccard edges of covered places."""
    return f"""{blocks_sql(anchors)},
    sides AS (SELECT block_id, 'query' AS role, query_genome AS genome, query_contig AS contig, query_start AS s, query_end AS e, orientation FROM blocks
      UNION ALL SELECT block_id, 'target', target_genome, target_contig, target_start, target_end, orientation FROM blocks),
    covered AS (SELECT block_id, sum(e - s + 1) AS n FROM sides GROUP BY 1),
    met AS (SELECT a.block_id AS u, b.block_id AS v, sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS n FROM sides a
      JOIN sides b ON a.genome = b.genome AND a.contig = b.contig AND a.s <= b.e AND b.s <= a.e AND a.block_id < b.block_id GROUP BY 1, 2),
    edges AS (SELECT * FROM (SELECT u, v, met.n / (x.n + y.n - met.n) AS w FROM met JOIN covered x ON x.block_id = u JOIN covered y ON y.block_id = v) WHERE w >= 0.3),
    two AS (SELECT u, v, w FROM edges UNION ALL SELECT v, u, w FROM edges),
    near AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS k FROM two),
    mutual AS (SELECT a.u, a.v FROM near a JOIN near b ON a.u = b.v AND a.v = b.u WHERE a.k <= 5 AND b.k <= 5 AND a.u < a.v),
    {components_sql("SELECT block_id AS id FROM blocks", "mutual", "b")},
    ids AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster_id FROM (SELECT root FROM bcomp JOIN sides ON block_id = node GROUP BY root HAVING count(DISTINCT genome) >= 2)),
    clustered AS (SELECT blocks.*, coalesce(cluster_id, 0) AS cluster_id FROM blocks JOIN bcomp ON node = block_id LEFT JOIN ids USING (root))"""


def merged_sql(anchors: str) -> str:
    """CTE merged(block_id, cluster_id): contained clusters merged one by one."""
    return f"""{clusters_sql(anchors)},
    foot AS (SELECT DISTINCT cluster_id AS c, genome, contig, unnest(range(s, e + 1)) AS pos FROM sides JOIN clustered USING (block_id)
      WHERE cluster_id IN (SELECT cluster_id FROM clustered WHERE cluster_id > 0 GROUP BY 1 HAVING count(*) >= 2)),
    per AS (SELECT c, genome, count(*) AS n FROM foot GROUP BY 1, 2), tot AS (SELECT c, sum(n) AS z FROM per GROUP BY 1),
    ov AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM foot a JOIN foot b USING (genome, contig, pos) WHERE a.c < b.c GROUP BY 1, 2),
    sh AS (SELECT ov.a, ov.b, ov.n, (SELECT sum(p.n) FROM per p WHERE p.c = ov.a AND p.genome IN (SELECT genome FROM per WHERE c = ov.b)) AS sa,
      (SELECT sum(p.n) FROM per p WHERE p.c = ov.b AND p.genome IN (SELECT genome FROM per WHERE c = ov.a)) AS sb FROM ov),
    cand AS (SELECT CASE WHEN x.z <= y.z THEN a ELSE b END AS small, CASE WHEN x.z <= y.z THEN b ELSE a END AS large, n, CASE WHEN x.z <= y.z THEN sa ELSE sb END AS small_n,
      CASE WHEN x.z <= y.z THEN sb ELSE sa END AS large_n, a AS lo, b AS hi FROM sh JOIN tot x ON x.c = a JOIN tot y ON y.c = b),
    good AS (SELECT *, row_number() OVER (PARTITION BY small ORDER BY large_n DESC, lo, hi) AS k, first_value(lo) OVER w AS lo1, first_value(hi) OVER w AS hi1
      FROM cand WHERE n / small_n >= 0.8 AND n / large_n >= 0.5 WINDOW w AS (PARTITION BY small ORDER BY lo, hi)),
    todo AS (SELECT small, large, row_number() OVER (ORDER BY lo1, hi1, small) AS rn FROM good WHERE k = 1),
    walk(rn, names) AS (SELECT CAST(0 AS BIGINT), (SELECT list(struct_pack(c := c, now := c, z := z)) FROM tot)
      UNION ALL SELECT rn, list_transform(names, lambda x: struct_pack(c := x.c, now := CASE WHEN x.now = gone THEN kept ELSE x.now END, z := x.z)) FROM (
        SELECT rn, names, CASE WHEN za <= zb THEN a ELSE b END AS gone, CASE WHEN za <= zb THEN b ELSE a END AS kept FROM (
          SELECT rn, names, a, b, list_filter(names, lambda x: x.c = a)[1].z AS za, list_filter(names, lambda x: x.c = b)[1].z AS zb FROM (
            SELECT t.rn, names, list_filter(names, lambda x: x.c = t.small)[1].now AS a, list_filter(names, lambda x: x.c = t.large)[1].now AS b
            FROM walk JOIN todo t ON t.rn = walk.rn + 1)))),
    last AS (SELECT unnest(names) AS x FROM walk ORDER BY rn DESC LIMIT (SELECT count(*) FROM tot)),
    merged AS (SELECT block_id, coalesce(x.now, cluster_id) AS cluster_id FROM clustered LEFT JOIN last ON x.c = cluster_id)"""


def loci_sql(anchors: str) -> str:
    """CTEs chosen (sides of clusters with at least three blocks) and loci."""
    return f"""{clusters_sql(anchors)},
    chosen AS (SELECT sides.*, cluster_id FROM sides JOIN clustered USING (block_id) WHERE cluster_id IN (SELECT cluster_id FROM clustered WHERE cluster_id > 0 GROUP BY 1 HAVING count(*) >= 3)),
    seen AS (SELECT *, max(e) OVER (PARTITION BY cluster_id, genome, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chosen),
    cut AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, genome, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM seen),
    isl AS (SELECT cluster_id, genome, contig, min(s) AS a, max(e) AS b FROM cut GROUP BY cluster_id, genome, contig, isl),
    loci AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY genome, contig, a) - 1 AS locus_id, genome, contig, a AS start, b AS "end", b - a + 1 AS n_genes, support,
      CASE WHEN turn >= 0 THEN 1 ELSE -1 END AS orientation FROM (SELECT isl.cluster_id, isl.genome, isl.contig, a, b, count(*) AS support, sum(orientation) AS turn
        FROM isl JOIN chosen c ON c.cluster_id = isl.cluster_id AND c.genome = isl.genome AND c.contig = isl.contig AND c.s <= b AND a <= c.e GROUP BY ALL))"""


def slots_sql(anchors: str, most: int | None = None) -> str:
    """CTEs lg (genes of loci in order along the reference) and assigned: each locus aligned with its cluster's reference, row by row of the
    table of best totals (a running maximum), then read back from its end.  most leaves out clusters whose reference has more genes."""
    few = "" if most is None else f" AND n_genes <= {most}"
    return f"""{loci_sql(anchors)},
    ref AS (SELECT cluster_id, locus_id AS ref_locus FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY support DESC, n_genes DESC, locus_id) AS k FROM loci) WHERE k = 1{few}),
    lg AS (SELECT l.cluster_id, l.locus_id, ref_locus, g.gene_id, g.position_index, g.emb,
      row_number() OVER (PARTITION BY l.cluster_id, l.locus_id ORDER BY CASE WHEN l.orientation >= 0 THEN g.position_index ELSE -g.position_index END) AS i
      FROM loci l JOIN ref USING (cluster_id) JOIN genes g ON g.sample_id = l.genome AND g.contig_id = l.contig AND g.position_index BETWEEN l.start AND l."end"),
    worth AS (SELECT a.cluster_id, a.locus_id, a.i, list(list_cosine_similarity(a.emb, b.emb) ORDER BY b.i) AS s,
      list(CASE WHEN list_cosine_similarity(a.emb, b.emb) >= 0.3 THEN list_cosine_similarity(a.emb, b.emb) ELSE CAST('-infinity' AS DOUBLE) END ORDER BY b.i) AS w
      FROM lg a JOIN lg b ON b.cluster_id = a.cluster_id AND b.locus_id = a.ref_locus WHERE a.locus_id <> a.ref_locus GROUP BY 1, 2, 3),
    fill(cluster_id, locus_id, i, best) AS (SELECT cluster_id, locus_id, CAST(0 AS BIGINT), list_transform(list_prepend(0.0, any_value(w)), lambda x: CAST(0 AS DOUBLE)) FROM worth GROUP BY 1, 2
      UNION ALL SELECT w.cluster_id, w.locus_id, w.i, list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, len(w.w) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda x: greatest(f.best[x + 1], f.best[x] + w.w[x])))))
      FROM fill f JOIN worth w ON w.cluster_id = f.cluster_id AND w.locus_id = f.locus_id AND w.i = f.i + 1),
    trace(cluster_id, locus_id, i, j, pi, pj) AS (SELECT cluster_id, locus_id, max(i), CAST(any_value(len(best)) - 1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM fill GROUP BY 1, 2
      UNION ALL SELECT cluster_id, locus_id, CASE WHEN hit OR up THEN i - 1 ELSE i END, CASE WHEN hit OR NOT up THEN j - 1 ELSE j END, CASE WHEN hit THEN i ELSE 0 END, CASE WHEN hit THEN j ELSE 0 END FROM (
        SELECT t.cluster_id, t.locus_id, t.i, t.j, x.best[t.j + 1] = y.best[t.j] + w.w[t.j] AS hit, x.best[t.j + 1] = y.best[t.j + 1] AS up FROM trace t
        JOIN fill x ON x.cluster_id = t.cluster_id AND x.locus_id = t.locus_id AND x.i = t.i JOIN fill y ON y.cluster_id = t.cluster_id AND y.locus_id = t.locus_id AND y.i = t.i - 1
        JOIN worth w ON w.cluster_id = t.cluster_id AND w.locus_id = t.locus_id AND w.i = t.i WHERE t.i > 0 AND t.j > 0)),
    placed AS (SELECT t.cluster_id, t.locus_id, pi AS i, pj AS j, w.s[pj] AS sim FROM trace t JOIN worth w ON w.cluster_id = t.cluster_id AND w.locus_id = t.locus_id AND w.i = pi WHERE pi > 0
      UNION ALL SELECT cluster_id, locus_id, i, i, 1.0 FROM lg WHERE locus_id = ref_locus),
    assigned AS (SELECT lg.cluster_id, lg.locus_id, gene_id, position_index, emb, coalesce(max(j) OVER (PARTITION BY lg.cluster_id, lg.locus_id ORDER BY lg.i ROWS UNBOUNDED PRECEDING), 0) - 1 AS slot,
      coalesce(sim, 0) AS similarity, j IS NULL AS is_insertion FROM lg LEFT JOIN placed p ON p.cluster_id = lg.cluster_id AND p.locus_id = lg.locus_id AND p.i = lg.i)"""


def slot_rows_sql(anchors: str, most: int | None = None) -> str:
    """slots_sql and CTE slot_rows, the summary of each slot."""
    return f"""{slots_sql(anchors, most)},
    occ AS (SELECT cluster_id, slot, gene_id, list_transform(emb, lambda x: x / sqrt(list_sum(list_transform(emb, lambda y: y * y)))) AS v FROM assigned WHERE NOT is_insertion),
    mid AS (SELECT cluster_id, slot, list(c ORDER BY d) AS centre FROM (SELECT cluster_id, slot, d, avg(v[d]) AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS d FROM occ) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    near_mid AS (SELECT occ.*, list_cosine_similarity(v, centre) AS c FROM occ JOIN mid USING (cluster_id, slot)),
    first_ AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, slot ORDER BY round(c, 9) DESC, gene_id) AS k FROM near_mid),
    kinds AS (SELECT a.cluster_id, a.slot, avg(CASE WHEN list_cosine_similarity(a.v, b.v) < 0.4 THEN 1.0 ELSE 0.0 END) AS far, avg(list_cosine_similarity(a.v, b.v)) AS mean
      FROM occ a JOIN occ b ON a.cluster_id = b.cluster_id AND a.slot = b.slot AND a.gene_id < b.gene_id GROUP BY 1, 2),
    slot_rows AS (SELECT f.cluster_id, f.slot, count(*) AS n_occupants, any_value(n.n) AS n_loci, count(*) / any_value(n.n) AS share, 1 - avg(c) AS spread, min(CASE WHEN f.k = 1 THEN gene_id END) AS centroid_gene,
      CASE WHEN count(*) >= 3 AND any_value(far) > 0.4 AND any_value(mean) < 0.6 THEN 2 ELSE 1 END AS n_types
      FROM first_ f JOIN (SELECT cluster_id, count(*) AS n FROM loci GROUP BY 1) n ON n.cluster_id = f.cluster_id LEFT JOIN kinds k ON k.cluster_id = f.cluster_id AND k.slot = f.slot GROUP BY 1, 2),
    slots AS (SELECT cluster_id, slot, n_occupants, n_loci, round_even(share, 3) AS occupancy, round_even(spread, 4) AS dispersion, centroid_gene, n_types, share >= 0.7 AND spread < 0.3 AS is_core FROM slot_rows)"""
