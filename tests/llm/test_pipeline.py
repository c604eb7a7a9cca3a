import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _take long, score double, lang_pred string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    en, de = [f"the{i}ing" for i in range(300)], [f"der{i}ung" for i in range(300)]
    rows = []
    for i in range(60):
        words = rng.choice(en if i % 2 else de, 80 + i)
        rows.append([i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}"])
    near = rows[7][1].split()
    near[40] = "changed"
    rows += [[100, rows[3][1], "en", "s0"], [101, " ".join(near), "en", "s1"], [102, None, None, None], [103, "?? 12", "en", "s1"], [104, "", "de", None]]
    rows += [rows[5], rows[5], [None, rows[11][1], "en", None], [None, "  lonely words without an id " + " ".join(rng.choice(en, 60)), "en", None]]
    return spark.createDataFrame([(*r, 0, 1, 2, 0.5, "x") for r in rows], SCHEMA)


def test_language_stage(spark, docs, sf_dir):
    out = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert out.columns == docs.columns
    gone = {r.doc_id for r in docs.exceptAll(out).collect()}
    assert gone == {102, 103, 104} and out.count() == docs.count() - 3


def test_near_duplicate_stage(spark, docs, sf_dir):
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    out = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(60)) and ids.count(None) <= 2


def test_decontamination_stage(spark, docs, tmp_path):
    item = " ".join(docs.filter("doc_id = 9").first().text.split()[10:50])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.exceptAll(out).collect()} == {9} and out.count() == docs.count() - 1


def test_decontamination_stage_without_items(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path)).count() == docs.count()


def test_mixing_stage(spark, docs, sf_dir):
    from locusweave.llm import source_mix

    out = corpus_pipeline.mix(spark, docs, sf_dir)
    assert out.columns == docs.columns
    want = source_mix.mix_sources(docs).groupBy("source").sum("taken").collect()
    got = {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {r[0]: r[1] for r in want if r[1]}


def test_whole_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty_corpus(spark, docs, sf_dir):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none_out = stage(spark, none, sf_dir)
        assert none_out.count() == 0, name

@pytest.mark.parametrize("tile", [4096, 5])
def test_near_duplicate_stage_against_brute_force(spark, monkeypatch, tile):
    """Pairs around 0.8, among them repeated lines, short texts, a group that is linked in a chain and a large one, which
    takes several rounds of leaders and a comparison across tiles where tiles are small."""
    from locusweave.llm import set_dedup

    monkeypatch.setattr(set_dedup, "TILE", tile)
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", " two words ", "Two  words"]
    for i in range(60):
        words = list(rng.choice(vocab, rng.integers(30, 200)))
        words += words[:20] * 3 if i % 7 == 0 else []
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.022, 0.03, 0.05):
            some = [str(rng.choice(vocab)) if rng.random() < share else w for w in words]
            texts.append(" ".join(some))
            words = some if i % 3 == 0 else words
    large = list(rng.choice(vocab, 120))
    for _ in range(150):
        texts.append(" ".join(str(rng.choice(vocab)) if rng.random() < 0.02 else w for w in large))
    texts += [" ".join(vocab[:8]), " ".join(vocab[:9]), " ".join(vocab[:200]), " ".join(vocab[:200] + vocab[:100])]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == [i for i in range(len(texts)) if find(i) == i] and 70 < len(got) < 300


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_labels_against_all_pairs(similarity):
    from locusweave.llm.set_dedup import similar_labels
    from locusweave.llm.simhash_dedup import _majority

    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 63, 60, dtype=np.uint64) for _ in range(8)]
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.0, 0.05, 0.1, 0.3]), rng.integers(0, 1 << 63, 60, dtype=np.uint64), base[i % 8])) for i in range(300)]
    fps = np.array([_majority(s) for s in sets], np.uint64)
    got = similar_labels(sets, fps, np.arange(300), np.arange(300), similarity, radius=64)
    want = np.arange(300)
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert (got == want).all() and 8 < len(set(got.tolist())) < 300
    if similarity >= 0.8:  # at the radius of the stage
        assert (similar_labels(sets, fps, np.arange(300), np.arange(300), similarity) == want).all()


def test_near_duplicate_stage_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (1, a), (3, c), (None, c + " more"), (None, "alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()))
    assert got == [(0, "alone without an id"), (1, a), (1, b), (3, c)]
