"""Ball k-means, toxicity and source divergence against brute force, SQL and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from locusweave.llm import ball_kmeans, divergence, toxicity
from locusweave.llm.queries import ORACLES, QUERIES


def plain_kmeans(rows, k=8, rounds=10, seed=3, dims=64, scale=1024):
    """rows (id, vector) by Python integers alone: [(id, cluster, distance, cluster inertia, inertia, centroid hash)]"""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: ((r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else ""), r[1]))
    centre = [q for _, q in named[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[near(q)[1]].append(q)
        centre = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centre)]
    last = [(i, *near(q)) for i, q in kept]
    of = Counter()
    for _, d, c in last:
        of[c] += d
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return [(i, c, d, of[c], sum(of.values()), told[c]) for i, d, c in last]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


VECTORS = "vec_id long, embedding array<float>, cluster int, q string, home int, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "q", 1, "d") for i, v in rows], VECTORS).repartition(3)


def clouds(n, centres, dims, spread, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((centres, dims)) * 3
    return [(i, [float(x) for x in (at[i % centres] + spread * rng.standard_normal(dims)).astype(np.float32)]) for i in range(n)]


def test_ball_kmeans_against_plain(spark):
    rows = clouds(300, 12, 64, 0.8) + [(1000 + i, v) for i, v in clouds(40, 3, 64, 4.0, 2)]
    rows += [(7, rows[7][1])] * 3 + [(5000, [0.5] * 64)] * 5  # repeated rows
    odd = [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [None] + [0.1] * 63), (905, [math.nan] + [0.1] * 63), (906, [math.inf] * 64), (None, [0.25] * 64)]
    got = ball_kmeans.ball_kmeans(frame(spark, rows + odd))
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert order(got.collect()) == order(plain_kmeans(rows + odd))


def test_ball_kmeans_skips_far_centroids(spark, monkeypatch):
    """Tight clouds: most vectors lie in the core of their ball; the homes are written again where many have left them."""
    rows = clouds(400, 8, 64, 0.05)
    told = []
    got = ball_kmeans.ball_kmeans(frame(spark, rows), told=told)
    assert order(got.collect()) == order(plain_kmeans(rows))
    assert told[-1]["distances"] < 6 * told[-1]["rows"] and told[-1]["away"] <= ball_kmeans.REHOME * 400  # of 8 for each row
    monkeypatch.setattr(ball_kmeans, "REHOME", 0.0)
    assert order(ball_kmeans.ball_kmeans(frame(spark, rows)).collect()) == order(plain_kmeans(rows))


@pytest.mark.parametrize("rows", [[], clouds(5, 5, 64, 1.0), [(i, [1.0] * 64) for i in range(20)], [(i, [float(i % 2)] * 64) for i in range(30)]], ids=["none", "few", "one point", "ties"])
def test_ball_kmeans_small(spark, rows):
    assert order(ball_kmeans.ball_kmeans(frame(spark, rows)).collect()) == order(plain_kmeans(rows))


def test_ball_kmeans_wide_numbers(spark):
    """Components that 64-bit squares cannot hold are counted exactly; what no long can hold is null."""
    rows = [(i, [float(2 ** (20 + i % 9))] * 32 + [float(-i)] * 32) for i in range(40)]
    fits = lambda v: v if v < 1 << 63 else None
    want = [(i, c, fits(d), fits(ci), fits(t), h) for i, c, d, ci, t, h in plain_kmeans(rows)]
    assert order(ball_kmeans.ball_kmeans(frame(spark, rows)).collect()) == order(want)
    huge = [(i, [1e30] * 64) for i in range(3)]
    assert ball_kmeans.ball_kmeans(frame(spark, huge)).count() == 0


def test_balls_compare_neighbours_alone():
    rng = np.random.default_rng(0)
    centre = [[int(x) for x in rng.integers(-50, 50, 3)] for _ in range(9)]
    q = rng.integers(-60, 60, (500, 3))
    d = ((q[:, None] - np.array(centre)) ** 2).sum(axis=2)
    home = (d.argmin(axis=1) + (rng.random(500) < 0.2)) % 9
    reach = [ball_kmeans._up(int(d[home == b, b].max(initial=0))) for b in range(9)]
    cluster, best, own, counted = ball_kmeans.Balls(centre, reach).assign(home.astype(np.int32), q)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and (own == d[np.arange(500), home]).all() and counted < 9 * 500


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, held_out string, score string, toxic string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "t", 2, "h", "s", "x") for i, t, lang, s in rows], DOCUMENTS).repartition(3)


def plain_divergence(rows, least=10, best=10):
    texts = defaultdict(list)
    for _, t, lang, s in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        texts[lang or ""].append((s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)))
    out = []
    for lang, of in texts.items():
        df = Counter(w for _, ws in of for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: Counter(w for t, ws in of if t == s for w in ws if df[w] >= least) for s in {s for s, _ in of}}
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        q, ps = p(whole), {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [(f(ps[s][w], q[w]), w) for w in kept if counts[s][w] and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, best)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, s, part, item, v, n + 1) for n, (v, item) in enumerate(ranked)]
    return sorted(out)


def audited():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdeé中" for b in ("x", "Yy", "zß")]
    rows = []
    for i in range(260):
        lang, source = ["en", "en", "de", None, "xx"][i % 5], ["a", "b", "ä", None, "", "z'\"\x01"][i % 6]
        weights = np.arange(1, len(words) + 1) ** (0.3 * (i % 4))
        line = [str(w) for w in rng.choice(words, int(rng.integers(0, 30)), p=weights / weights.sum())]
        rows.append((i, ["-1 ", ", ", "_", " "][i % 4].join(line), lang, source))
    rows += [(1, None, "en", "none"), (2, "", "zz", "only"), (3, "...", "zz", "two"), (None, "ax ax", "en", "a"), (4, "ax " * 5000, "en", "a")]
    return rows + rows[3:6] * 2  # repeated rows


def test_divergence_against_plain(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 50)
    rows = audited()
    got = divergence.divergence(documents(spark, rows))
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)
    assert sorted(map(tuple, divergence.divergence(documents(spark, rows), least=1, best=3).collect())) == plain_divergence(rows, 1, 3)


def test_divergence_of_long_texts_and_full_tasks(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "dddd" * 40, "é1f"], 400)) for _ in range(6)] + ["q" * 700, None]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 8, "source": ["s", "t"] * 4, "text": texts})
    whole = lambda: sorted(Counter({}).items()) or merged(divergence._counted(iter([batch])))

    def merged(batches):
        n, docs = Counter(), Counter()
        for b in batches:
            for r in b.to_pylist():
                n[r["source"], r["term"]] += r["n"]
                docs[r["source"], r["term"]] += r["docs"]
        return n, docs

    want = whole()
    monkeypatch.setattr(divergence, "SLICE", 50)
    assert whole() == want
    monkeypatch.setattr(divergence, "HELD", 3)
    assert whole() == want and len(list(divergence._counted(iter([batch])))) > 2


def test_divergence_of_nothing(spark):
    assert divergence.divergence(documents(spark, []).limit(0)).count() == 0
    assert divergence.divergence(documents(spark, [(1, "a b", "en", "s"), (2, None, "en", "t")])).count() == 2  # no term is kept: values 0


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op13_divergence"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    made = con.execute(ORACLES[name])
    assert df.columns == [d[0] for d in made.description]
    assert order(df.collect()) == order(made.fetchall())


@pytest.mark.parametrize("token,words,undone", [
    ("idiot", ["idiot"], False), ("IDIOT!!", ["idiot"], False), ("1d10t", ["idiot"], True), ("i.d.i.o.t", ["idiot"], True), ("l-o-s-e-r", ["loser"], True), ("idiooooot", ["idiooooot", "idiot"], True),
    ("$cum", ["cum", "scum"], True), ("well-known", ["well", "known"], False), ("2024", [], False), ("###", [], False), ("", [], False), ("trash***", ["trash"], False), ("élan", ["élan"], False),
])
def test_readings(token, words, undone):
    assert toxicity.readings(token) == (words, undone)


def test_features_of_a_text(monkeypatch):
    reader = toxicity.Reader({"=zork": 4.0, "flim": 1.0})
    named = lambda t: dict(zip(toxicity.FEATURES, reader.features(t)))
    assert set(named("").values()) == {0.0} == set(named(" \t\n").values())
    told = named("You zork! A flimsy word, and Z0RK again and again and again and over")
    assert told["hit_count"] == math.log1p(3) and told["kinds"] == math.log1p(2) and told["heaviest"] == 4.0 and told["strong"] == 2 / 14
    assert told["near_second_person"] == 2 / 3 and told["second_person"] == 1 / 14 and told["disguised"] == told["disguised_hits"] == 1 / 14 and told["exclamations"] == 1 / 14
    assert named("ABC DEF ghi")["all_capitals"] == 2 / 3
    text = " ".join(["plain zork"] * 5000)
    want = named(text)
    monkeypatch.setattr(toxicity, "SLICE", 100)
    monkeypatch.setattr(toxicity, "KNOWN", 0)
    assert named(text) == want


def test_toxicity_of_made_texts(spark):
    rng = np.random.default_rng(8)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ta", "ni", "so", "be", "du")]
    rows, labels = [], []
    for i in range(700):
        line = [str(w) for w in rng.choice(common, 40)]
        toxic = i % 5 == 0
        for at in rng.integers(0, 40, 3 if toxic else 0):
            line[at] = str(rng.choice(["grumpf", "grumpfen", "blarg", "BL4RG", "g.r.u.m.p.f"]))
        rows.append((i, " ".join(line), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(9000, None, None, None), (9001, "", "en", "s"), (None, "you grumpf blarg grumpf", "en", "s"), rows[5], (9002, "kata nini " * 20_000 + "grumpf", "en", "s")]
    labels += [(3, None), (3, 5), (None, 1), (5, 1), (8888, 1)]
    marks = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(spark, rows), marks)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    told = dict(labels[:700])
    held = [r for r in got if r.held_out and r.doc_id in told]
    assert sum(r.predicted == told[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0} and [r.predicted for r in got if r.doc_id is None] == [1]
    assert [r.score for r in got if r.doc_id == 9000] == [r.score for r in got if r.doc_id == 9001]


def test_toxicity_does_not_learn_from_held_out_labels(spark):
    rows = [(i, ("blarg " if zlib.crc32(str(i).encode()) % 5 == 0 else "") + "some words here", "en", "s") for i in range(200)]
    marks = spark.createDataFrame([(i, int(t.startswith("blarg"))) for i, t, _, _ in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(spark, rows), marks).collect()
    assert {r.score for r in got} == {0.0}  # one kind of label is left: its share


def test_toxicity_without_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(documents(spark, []).limit(0), marks).count() == 0
    assert {r.score for r in toxicity.toxicity(documents(spark, [(1, "a", "en", "s"), (2, None, None, None)]), marks).collect()} == {0.0}


def test_toxicity_held_out_labels_of_the_driver(spark):
    """Held-out accuracy on the driver's tables, where about 7 % of the toxic labels stand on texts without a toxic word."""
    import os

    found = "/root/testdata/sf0.1"
    if not os.path.isdir(found):
        pytest.skip("driver tables are absent")
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{found}/labels.parquet").collect()}
    held = [r for r in QUERIES["op12_toxicity"](spark, found).filter("held_out").collect() if r.doc_id in told]
    caught = sum(r.predicted and told[r.doc_id] for r in held)
    assert caught / sum(told[r.doc_id] for r in held) >= 0.85 and caught / sum(r.predicted for r in held) >= 0.85
