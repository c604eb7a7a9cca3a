"""Each operator against brute force on awkward rows, and on the driver's smallest table."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusweave.llm import chat_format, common, decontaminate, exact_dedup, language_id, license_scan, pii, simhash_dedup, source_mix, substring_dedup, token_output
from locusweave.llm.queries import QUERIES, vocabulary
from locusweave.operators.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, fp long, key string, size long, _id long, _text string, n int, rep int"
WORDS = [f"w{i}" for i in range(400)]


def rows():
    rng = np.random.default_rng(11)
    line = lambda n: " ".join(rng.choice(WORDS, n))
    shared = line(60)
    texts = [None, "", " \t\n", "one", "one", line(5), line(19), line(20), line(200), shared, "x " + shared + " y", shared + " " + shared, line(30_000), "é ü 中文 ß \x0b z\x0c", "###", "12 34"]
    texts += ["the same text again and again"] * 7
    base = line(150).split()
    for i in range(6):  # near copies
        copy = list(base)
        copy[10 * i] = "edit"
        texts.append(" ".join(copy))
    out = [(i * 3 % 97, t, ["en", "de", None][i % 3], ["a", "b", None, "ä"][i % 4], None) for i, t in enumerate(texts)]
    out += [(None, shared, None, None, 1), (None, "one", "en", "a", 1), out[8], out[8], out[9]]  # without id, repeated rows
    return [(*r, 5, 6, "k", 7, 8, "other", 9, 10) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def key(x):
    return (x is None, x or 0)


def brute_repeats(data, window):
    data = sorted(data, key=lambda r: (key(r[0]), (r[1] or "").encode()))
    seen, out = set(), []
    for i, t in data:
        w = split(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            gram = tuple(w[a : a + window])
            if gram in seen:
                gone[a : a + window] = [True] * window
            seen.add(gram)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


@pytest.mark.parametrize("window", [20, 6])
def test_substring_dedup(docs, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 2_000)
    got = substring_dedup.remove_repeats(docs, window).drop("kept_text").collect()
    want = brute_repeats([(r[0], r[1]) for r in rows()], window)
    assert sorted(map(tuple, got), key=lambda r: (key(r[0]), r[1:])) == want


def test_longest_repeats(spark):
    rng = np.random.default_rng(2)
    shared = " ".join(rng.choice(WORDS, 90))
    df = spark.createDataFrame([(1, "a b " + shared), (2, shared + " c"), (3, " ".join(rng.choice(WORDS, 300)))], "doc_id long, text string")
    got = sorted(map(tuple, substring_dedup.longest_repeats(df).collect()))
    assert got == [(1, 20, 2, 90), (1, 40, 2, 90), (1, 80, 2, 90), (2, 20, 0, 90), (2, 40, 0, 90), (2, 80, 0, 90)]


def test_longest_repeats_sifts_once(spark, monkeypatch):
    """Each level looked up shorter runs, which are repeated in all that a level leaves to the next."""
    words = [f"w{i}" for i in range(130)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words]))], "doc_id long, text string")
    levels, sift = [], substring_dedup._candidates
    monkeypatch.setattr(substring_dedup, "_candidates", lambda blocks, window: levels.append(window) or sift(blocks, window))
    got = sorted(map(tuple, substring_dedup.longest_repeats(df).collect()))
    assert got == [(d, n, d - 1, 130) for d in (1, 2) for n in (20, 40, 80)] and levels == [20]


def test_longest_repeats_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 3_000)
    rng = np.random.default_rng(9)
    pool = [list(rng.choice(WORDS, n)) for n in (15, 25, 45, 90, 170)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.integers(0, 5)):
            words += list(rng.choice(WORDS, rng.integers(0, 30))) + pool[rng.integers(5)]
        texts.append(words)
    want, level = set(), 20
    while True:
        count = {}
        for w in texts:
            for a in range(len(w) - level + 1):
                count[tuple(w[a : a + level])] = count.get(tuple(w[a : a + level]), 0) + 1
        found = set()
        for i, w in enumerate(texts):
            starts = [a for a in range(len(w) - level + 1) if count[tuple(w[a : a + level])] > 1]
            while starts:
                end = 1
                while end < len(starts) and starts[end] <= starts[end - 1] + level:
                    end += 1
                found.add((i, level, starts[0], starts[end - 1] + level - starts[0]))
                starts = starts[end:]
        if not found:
            break
        want |= found
        level *= 2
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert set(map(tuple, substring_dedup.longest_repeats(df).collect())) == want and {w[1] for w in want} == {20, 40, 80, 160}


def thue_morse(n):
    """Two words of n letters that differ in every place and whose linear hashes with odd factors agree modulo 2**64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_are_told_apart(spark):
    one, two = thue_morse(1024)
    rest = [f"r{i}" for i in range(19)]
    df = spark.createDataFrame([(1, " ".join([one, *rest])), (2, " ".join([two, *rest]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    from locusweave.llm.words import window_hashes, word_hashes

    x, y = thue_morse(2048)  # as sequences of words
    h, g, _ = word_hashes([" ".join(x).encode() + b" " + " ".join(y).encode()])
    assert len({int(window_hashes(w, 2048, s)[i]) for w, s in ((h, 1), (g, 2)) for i in (0, 2048)}) == 4
    coder = token_output.Encoder(vocabulary())
    texts = [f"{one} {two}", two, one]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want


def test_hashes_of_short_words_are_injective():
    from locusweave.llm.words import word_hashes

    words = [b"a", b"a\x00", b"\x00", b"\x00a", b"abcdefg", b"abcdefg\x00", b"abcdefgh", b"bcdefgh", b"z"]
    h, g, n = word_hashes([b" ".join(words), b" ".join(reversed(words))])
    assert n.tolist() == [9, 9] and len(set(h.tolist())) == len(set(g.tolist())) == 9
    assert h[:9].tolist() == h[9:][::-1].tolist() and g[:9].tolist() == g[9:][::-1].tolist()


def test_pieces_that_share_a_hash_fall_back(monkeypatch):
    coder = token_output.Encoder(vocabulary())
    spans = token_output.word_spans
    monkeypatch.setattr(token_output, "word_spans", lambda *a: [x & np.uint64(3) if i == 3 else x for i, x in enumerate(spans(*a))])
    texts = ["several different pieces here", "and more of them", "here"]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want and coder.encode(texts[::-1]) == want[::-1]


def test_language_id(spark, docs, sf_dir):
    got = language_id.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id", "lang"]).toPandas()
    out = got[got.held_out]
    assert (out.lang == out.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    odd = {r.text: r for r in language_id.identify(docs, keep=["doc_id", "text"]).collect()}
    assert {t for t, r in odd.items() if r.lang_pred == "und"} == {None, "", " \t\n", "###", "12 34"}


def test_language_mixture():
    p = np.full((3, language_id.BUCKETS), 1e-6)
    for i in range(3):
        p[i, i * 10 : i * 10 + 10] = 0.1
    counts = np.zeros((2, language_id.BUCKETS), int)
    counts[0, 0:10], counts[0, 10:20], counts[1, 20:30] = 60, 20, 50
    pi = [language_id.infer(c, p) for c in counts]
    assert np.allclose(pi[0], [0.75, 0.25, 0], atol=0.01) and np.allclose(pi[1], [0, 0, 1], atol=0.01)


def test_five_languages_in_one_text():
    p = np.full((6, language_id.BUCKETS), 1e-7)
    for i in range(6):
        p[i, i * 10 : i * 10 + 10] = 0.1
    counts = np.zeros(language_id.BUCKETS, int)
    counts[:50] = 40
    assert np.allclose(language_id.infer(counts, p), [0.2] * 5 + [0], atol=1e-3)


def brute_mixture(text, p):
    """The mixture of one text by plain EM, trigram by trigram, over sets of each size."""
    low = re.sub(rb"[\x00-\x60\x7b-\x7f]", b" ", text.lower().encode("utf-8", "replace"))
    line, count = b" " + low + b" ", {}
    for i in range(len(low)):
        gram = line[i : i + 3]
        if gram[1:2] != b" " and (gram[:1] != b" " or gram[2:] != b" "):
            slot = (int.from_bytes(gram, "big") * 2654435761 & 0xFFFFFFFF) >> 19
            count[slot] = count.get(slot, 0) + 1
    slots, c = np.array(list(count), int), np.array(list(count.values()), float)
    if not len(c):
        return None

    def em(pi, rows, rounds):
        for _ in range(rounds):
            share = pi[:, None] * p[np.ix_(rows, slots)]
            pi = (share / share.sum(axis=0) * c).sum(axis=1) / c.sum()
        return pi

    full = em(np.full(len(p), 1 / len(p)), np.arange(len(p)), 30)
    order = sorted(range(len(p)), key=lambda i: (-full[i], i))
    best = None
    for k in range(1, len(p) + 1):
        rows = np.array(order[:k])
        pi = em(full[rows] / full[rows].sum(), rows, 10) if k > 1 else np.ones(1)
        fit = (c * np.log(pi @ p[np.ix_(rows, slots)])).sum() - 0.5 * (k - 1) * np.log(c.sum())
        if best is None or fit > best[0]:
            best = fit, dict(zip(rows.tolist(), pi))
    return best[1]


def test_language_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, p = language_id.learn(df.filter(~language_id.held_out("doc_id") & F.col("lang").isNotNull()), "doc_id", "text", "lang")
    rows_ = df.collect()
    mixed = [" ".join((a.text or "")[:150] for a in rows_[i : i + 9]) for i in range(0, 60, 3)]
    texts = {r.doc_id: r.text for r in rows_} | {-1 - i: t for i, t in enumerate(mixed)}
    more = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for parts in (1, 7):
        got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(more.repartition(parts), (langs, p), keep=["doc_id"]).collect()}
        if parts == 1:
            first = got
    assert got == first and len(got) == len(texts)
    for i, text in texts.items():
        pi = brute_mixture(text, p) if text and any(map(str.isalpha, text)) else None
        if pi is None:
            assert got[i][0] == "und" or not pi
            continue
        most = max(pi, key=lambda k: (pi[k], -k))
        assert got[i][0] == langs[most] and abs(got[i][1] - pi[most]) < 2e-3, (i, got[i], pi)


def test_exact_dedup(docs, monkeypatch):
    data = [(r[0], r[1] or "") for r in rows()]
    for capacity in (exact_dedup.CAPACITY, 300):
        got = exact_dedup.exact_duplicates(docs, capacity=capacity).collect()
        assert len(got) == len(data)
        groups = {}
        for i, t in data:
            groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
        for r in got:
            g = groups[r.text_sha256]
            assert r.group_size == len(g) and r.keep_id == max((i for i in g if i is not None), default=None)
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_directory_doubles():
    d = exact_dedup.Directory()
    d.grow({0: 50, 1: 50, 2: 10, 3: 10}, 2, 60)
    assert d.depth == 2 and d.buckets == {(2, 0): 50, (2, 1): 50, (1, 1): 20}
    assert d.lows() == [0, 1 << 61, 1 << 62]


def test_colliding_keys_compare_bytes(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "key": pa.array([7, 7, 7], pa.int64()), "body": pa.array([b"a", b"b", b"a"], pa.binary()), "rep": pa.array([1, 2, 3], pa.int64()),
        "n": pa.array([1, 1, 2], pa.int64()), "best": pa.array([5, 6, 9], pa.int64()), "best_uid": pa.array([1, 2, 3], pa.int64()),
    })
    got = {r["rep"]: (r["keep_id"], r["group_size"]) for b in exact_dedup._owners(iter([batch])) for r in b.to_pylist()}
    assert got == {1: (9, 3), 2: (6, 1), 3: (9, 3)}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out[kind].append(m.span())
    return out


def test_pii_base_against_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("ab@@..++--%_ 0123456789()1234") + ["é", "\n", "x@y.z", "+1 (555) 010-9999", "4111 1111 1111 1111", "10.0.0.255", "1.2.3.256"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text,found", [
    ("mail john (at) example (dot) com now", "john (at) example (dot) com"), ("mail john at example dot com now", "john at example dot com"),
    ("mail jоhn@exаmple.com now", "jоhn@exаmple.com"), ("ip one nine two dot one six eight dot zero dot one end", "one nine two dot one six eight dot zero dot one"),
    ("call plus one five five five zero one zero nine nine end", "plus one five five five zero one zero nine nine"), ("ip 10.0.0.１ x", "10.0.0.１"), ("a jo​hn@ex.org b", "jo​hn@ex.org"),
])
def test_pii_disguises(text, found):
    more = pii.added_spans(text, pii.base_spans(text))
    at = text.index(found)
    assert (at, at + len(found)) in [s for v in more.values() for s in v], more


@pytest.mark.parametrize("kind,text,found", [
    ("ip", "ip one two seven dot zero dot zero dot one end", "one two seven dot zero dot zero dot one"), ("ip", "eight dot eight dot eight dot eight", "eight dot eight dot eight dot eight"),
    ("ip", "at one two seven (dot) zero (dot) zero (dot) one", "one two seven (dot) zero (dot) zero (dot) one"), ("ip", "on 8.8.8.eight x", "8.8.8.eight"),
    ("phone", "call +44 20 seven nine four six 0958 now", "+44 20 seven nine four six 0958"), ("phone", "plus one five five five 010 zero nine nine", "plus one five five five 010 zero nine nine"),
])
def test_pii_short_and_mixed_runs(kind, text, found):
    at = text.index(found)
    assert pii.added_spans(text, pii.base_spans(text)) == {kind: [(at, at + len(found))]}


@pytest.mark.parametrize("kind,text,found", [
    ("phone", "x +1 five five five 010 0199", "+1 five five five 010 0199"), ("email", "by john_at_example_dot_com, ok", "john_at_example_dot_com"),
    ("email", "by john at example.com now", "john at example.com"), ("card", "no four one one one 1111 1111 1111.", "four one one one 1111 1111 1111"),
    ("email", "x\tat\ty\tdot\tcom", "x\tat\ty\tdot\tcom"), ("email", "JO (AT) Ex.com (Dot) uk", "JO (AT) Ex.com (Dot) uk"),
])
def test_pii_more_disguises(kind, text, found):
    at = text.index(found)
    assert pii.added_spans(text, pii.base_spans(text)) == {kind: [(at, at + len(found))]}


@pytest.mark.parametrize("unit", [" ", "( ", "at ", "(at) (dot) ", "x dot ", "john_at_", "x@", "+1 ", "one ", "a at b.c ", "a@b.c ", "\t(", "(dot", "1 one dot "])
def test_pii_time_is_linear(unit):
    import time

    text = unit * (1_000_000 // len(unit)) + "x (at) y.z"
    began = time.process_time()
    pii.added_spans(text, pii.base_spans(text))
    assert time.process_time() - began < 8  # seconds; half of it is usual at most, a square would be minutes


def naive_added(text):
    """Rewriting by plain patterns, one place after another, each output character with its source span."""
    low = text.lower()
    blank, op, cl = "[ \t]*", "[(\\[{<]", "[)\\]}>]"
    dot = f"(?:{blank}{op}{blank}(?:dot|[.]){blank}{cl}{blank}|_dot_|[ \t]+dot[ \t]+)"
    rules = [
        ("@", f"{blank}{op}{blank}(?:at|@){blank}{cl}{blank}"), (".", f"{blank}{op}{blank}(?:dot|[.]){blank}{cl}{blank}"),
        ("@", f"(?<=[a-z0-9._%+-])(?:_at_|[ \t]+at[ \t]+)(?=[a-z0-9-]+(?:[.][a-z][a-z]|{dot}[a-z]))"), (".", "(?<=[a-z0-9])(?:_dot_|[ \t]+dot[ \t]+)(?=[a-z0-9])"),
    ]
    out, i = [], 0
    while i < len(text):
        for new, rule in rules:
            m = re.compile(rule).match(low, i)
            if m:
                out.append((new, i, m.end(), True))
                i = m.end()
                break
        else:
            out.append((text[i], i, i + 1, False))
            i += 1
    found = {}
    base = plain_spans(text)
    for kind, spans in plain_spans("".join(o[0] for o in out)).items():
        for a, b in spans:
            s, e = out[a][1], out[b - 1][2]
            if any(o[3] for o in out[a:b]) and not any(x < e and s < y for x, y in base[kind]):
                found.setdefault(kind, []).append((s, e))
    return found


def test_pii_added_spans_against_plain_patterns():
    rng = np.random.default_rng(6)
    parts = [" ", " ", "\t", "at", "dot", "(", ")", "[", "]", "_", "jo", "ex", "com", "@", ".", "_at_", "_dot_", " at ", " dot ", "(at)", " (dot) ", "x.y", "that", "-"]
    some = 0
    for _ in range(8000):
        text = "".join(rng.choice(parts, rng.integers(3, 16)))
        got = pii.added_spans(text, pii.base_spans(text))
        assert got == naive_added(text), text
        some += bool(got)
    assert some > 200


def test_pii_query_columns(spark):
    texts = ["a@b.cd, 10.0.0.1 and +1 555 010 9999", "no (at) ex (dot) org 4111 1111 1111 1111", None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        text = texts[r.doc_id] or ""
        base = plain_spans(text)
        listed = lambda d: ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in sorted(d.get(k, [])))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        more = naive_added(text)
        assert r.spans == listed({k: base[k] + more.get(k, []) for k in BASE}) and r.n_added == sum(map(len, more.values()))


def test_pii_leaves_plain_text():
    for text in ("meet me at noon at the one two three place", "that dot is one dot", "the [at] sign", "he was born in Москва"):
        assert pii.added_spans(text, pii.base_spans(text)) == {}


def test_pii_rows(docs):
    got = pii.find_pii(docs)
    assert got.count() == len(rows()) and got.filter("n_email > 0").count() == 0
    assert {r.base_sha256 for r in got.collect()} == {hashlib.sha256(b"").hexdigest()}


def water_fill(sizes, weights, most):
    free, left = set(sizes), sum(sizes.values())
    target = {}
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.remove(s)
            left -= target[s]
    return target


def highest_quotients(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((s for s in votes if votes[s]), key=lambda s: (-votes[s] / (2 * got[s] + 1), s), default=None)
        if best is not None:
            got[best] += 1
    return got


def test_source_mix(docs):
    got = source_mix.mix_sources(docs).collect()
    assert len(got) == len(rows())
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(20, 0.02 * target[s]) for s in sizes)
    again = source_mix.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("seats", [0, 1, 3, 50, 1000])
def test_apportionment(spark, seats):
    rng = np.random.default_rng(seats)
    votes = {f"p{i:02d}": int(v) for i, v in enumerate([*rng.integers(0, 1000, 12), 100_000, 0, 7, 7])}
    df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "k string, v long, s long")
    assert {r.k: r.quota for r in source_mix.apportion(df, [], "v", "s", "k").collect()} == highest_quotients(votes, seats)


def norm_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_decontamination(spark, docs):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(rng.choice(WORDS, n))) for i, n in enumerate([3, 5, 9, 30, 50, 50])] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = items[4][1].split()
    one_edit, two_edits = list(long), list(long)
    one_edit[49] = "zz"
    two_edits[10] = two_edits[25] = two_edits[40] = "zz"
    texts = {
        200: "q " * 50 + items[3][1].upper() + ", end", 201: " ".join(one_edit), 202: " ".join(two_edits), 203: "; ".join(items[0][1].split()), 204: items[5][1] + " and " + items[5][1],
        205: " ".join(items[3][1].split()[:20]), 206: items[2][1],
    }
    more = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs.select("doc_id", "text").unionByName(more), bench).collect()}
    want = {}
    for i, t in [*texts.items(), *((r[0], r[1]) for r in rows() if r[0] is not None)]:
        w = norm_words(t)
        for j, item in items:
            b = norm_words(item)
            if not b or not w:
                continue
            k = min(5, len(b))
            grams = lambda x: [tuple(x[a : a + k]) for a in range(len(x) - k + 1)]  # noqa: E731, B023
            known = grams(b)
            for s in range(max(0, len(w) - len(b)) + 1 if len(w) < 3000 else 0):
                g = grams(w[s : s + len(b)])
                both = sum(min(g.count(x), known.count(x)) for x in set(g))
                sim = both / (len(g) + len(known) - both) if g else 0
                if sim >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), sim)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert (200, 3) in got and (201, 4) in got and (202, 4) not in got and (203, 0) in got


def test_decontamination_recall(spark):
    """Every edited item of similarity 0.8 or more is found: recall 1 over more than 500, with repeated words in a third."""
    rng = np.random.default_rng(12)
    items, texts = [], []
    for i in range(900):
        w = list(rng.choice(WORDS[:60] if i % 3 else WORDS[:3], rng.integers(30, 90)))
        items.append((i, " ".join(w)))
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = f"edit{rng.integers(9)}"
        texts.append((i, f"{' '.join(rng.choice(WORDS, 30))} {' '.join(w)} {' '.join(rng.choice(WORDS, 30))}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    grams = lambda w: [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
    from collections import Counter

    close = 0
    for (i, item), (_, text) in zip(items, texts):
        known, w = Counter(grams(item.split())), text.split()
        m = known.total()
        best = max(len(list((Counter(grams(w[s : s + m + 4])) & known).elements())) for s in range(len(w) - m - 3))
        sim = best / (2 * m - best)
        assert ((i, i) in got) == (sim >= 0.8) and (sim < 0.8 or got[i, i] == sim)
        close += sim >= 0.8
    assert close >= 500


def test_decontamination_sql(spark, sf_dir):
    import duckdb

    from locusweave.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES["op6_decontaminate"](spark, sf_dir).collect())) == sorted(con.sql(ORACLES["op6_decontaminate"]).fetchall())


def test_simhash_column(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, (20, 31))
    got = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(h)], "i int, h array<long>").select("i", decontaminate.simhash(F.col("h")).alias("f")).collect()
    for r in got:
        bits = ((h[r.i].view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
        assert r.f == int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * bits > 31].sum().view(np.int64))


def test_licenses(spark, docs):
    text = "some words before. Licensed under the Apache License, Version 2.0. " + " ".join(WORDS[:100]) + " Released under the MIT license " + license_scan.TEMPLATES["MIT-grant"].replace(",", "")
    rows_ = [(1, text), (2, "under the MIT License we released"), (3, None), (4, "x " * 5000 + license_scan.TEMPLATES["GPL-3.0"])]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.first_word, r.containment) for r in license_scan.scan_licenses(df).collect()}
    assert got == {(1, "Apache-2.0"): (3, 1.0), (1, "MIT"): (111, 1.0), (1, "MIT-grant"): (116, 1.0), (4, "GPL-3.0"): (5000, 1.0)}
    assert license_scan.scan_licenses(docs).count() == 0


def test_licenses_against_brute_force():
    """Documents of whole, changed and torn templates: exactly those with a run of at most 1/0.8 of a template's length that holds 0.8
    of its shingles are found."""
    rng = np.random.default_rng(3)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    words = [w for t in license_scan.TEMPLATES.values() for w in plain(t)]
    names = sorted(license_scan.TEMPLATES)
    docs_ = []
    for _ in range(300):
        parts = [" ".join(rng.choice(words, rng.integers(0, 40)))]
        for _ in range(rng.integers(0, 3)):
            t = plain(license_scan.TEMPLATES[names[rng.integers(len(names))]])
            kind = rng.random()
            if kind < 0.3:
                t[rng.integers(len(t))] = "changed"
            elif kind < 0.6:  # torn in two
                cut = rng.integers(len(t))
                t = [*t[:cut], *rng.choice(words, rng.integers(1, 30)), *t[cut:]]
            parts += [" ".join(t), " ".join(rng.choice(words, rng.integers(0, 40)))]
        docs_.append(" ".join(parts))
    got = {(d, i) for d, i, *_ in scanner.scan([d.encode() for d in docs_])}
    want = set()
    for d, text in enumerate(docs_):
        w = plain(text)
        for i, name in enumerate(names):
            t = plain(license_scan.TEMPLATES[name])
            k = min(5, len(t))
            grams = lambda x: [tuple(x[a : a + k]) for a in range(len(x) - k + 1)]  # noqa: E731, B023
            known, mine = set(grams(t)), grams(w)
            span = -(-len(grams(t)) * 5 // 4)
            if any(len(known & set(mine[a : a + span])) >= 0.8 * len(known) - 1e-9 for a in range(len(mine))):
                want.add((d, i))
    assert got == want and len(want) > 150


def test_short_and_empty_templates():
    scanner = license_scan.Scanner({"two": "public domain", "long": "one two three four five six"})
    assert [(d, scanner.names[i], at, n) for d, i, at, n, _ in scanner.scan([b"in the public domain, Public Domain", b"public, the domain", b""])] == [(0, "two", 2, 2)]
    with pytest.raises(ValueError):
        license_scan.Scanner({"none": " ..."})


def brute_fingerprint(text):
    w = split(text)
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_dedup(docs):
    data = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    got = simhash_dedup.near_duplicates(docs).collect()
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if (data[i][1] ^ data[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least.setdefault(find(i), []).append(d)
    want = sorted(((d, f, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(data)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


def test_simhash_copies(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(40):
        w = list(rng.choice(words, 300))
        texts.append(" ".join(w))
        for at in (40, 120, 200):
            w[at] = "edit"
        texts.append(" ".join(w))  # similarity 0.9 in shingles of five
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df, 5, 7, copies=3, total=34).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got) and sum(got[i] == i - 1 for i in range(1, 80, 2)) >= 36


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 12])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    b = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    a = np.concatenate([b[:200] ^ (rng.integers(0, 1 << 63, 200, dtype=np.uint64) & rng.integers(0, 1 << 63, 200, dtype=np.uint64) & rng.integers(0, 1 << 63, 200, dtype=np.uint64)), b[:50]])
    got = {(int(x), int(y)) for i, j in simhash_dedup.close_pairs(a, b, radius) for x, y in zip(i, j)}
    assert got == {(int(x), int(y)) for x, y in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius))}


@pytest.mark.parametrize("radius,bucket,tile", [(4, 2048, 2048), (4, 4, 16), (7, 8, 32), (2, 1, 8)])
def test_links_lose_no_pair(spark, monkeypatch, radius, bucket, tile):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = set(base.tolist())
    for x in base[:20]:
        for _ in range(15):
            y = int(x)
            for bit in rng.choice(64, rng.integers(1, radius + 2), replace=False):
                y ^= 1 << int(bit)
            fp.add(y)
    fp = sorted(fp)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fp]
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    got = {r.node: r.root for r in connected_components(simhash_dedup.links(nodes, radius, len(fp), 4)).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fp):
        for j in range(i):
            if (x ^ fp[j]).bit_count() <= radius:
                a, b = sorted((find(signed[i]), find(signed[j])))
                parent[b] = a
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_chat_format(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn>user\nhi</turn>\n", "\\l \\b \\\\ <", "", None, "é中😀<image>", "a\n\nb"]
    data = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "system", "assistant", "us<er\nx", "assistant", None], nasty))]
    data += [(2, 0, "user", "b"), (2, 0, "assistant", "a"), (2, 0, "user", "b"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1)).withColumn("_seq", F.lit(2))
    made = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digest(made).collect()}
    for conv in (1, 2, None):
        turns = [(t, r or "", x or "") for c, t, r, x in data if c == conv]
        turns.sort(key=lambda x: (x[0] or 0, x[1], x[2]))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].n_turns) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    assert {r.conv_id: len(r.formatted) for r in made.collect()} == {c: r.formatted_chars for c, r in got.items()}


def test_chat_parts(spark):
    parts = [("text", "look <", None, None), ("image", None, "s3://i", 12.0), ("text", " and ", None, None), ("audio", None, "a.wav", 2.0), ("document", None, "d.pdf", 1.0), ("odd", None, "x", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes", None, None)])], f"conv_id long, turn int, role string, parts {chat_format.PART}")
    r = chat_format.format_conversations(df, text="role", parts="parts").first()
    assert r.formatted == "<turn>user\nlook \\l<image> and <audio><document><odd></turn>\n<turn>assistant\nyes</turn>\n"
    assert [(a.ref, a.kind, a.tokens) for a in r.attachments] == [("s3://i", "image", 13), ("a.wav", "audio", 51), ("d.pdf", "document", 601), ("x", "odd", 1)]
    assert r.attachment_tokens == 666 and [r.formatted[s.begin : s.end] for s in r.loss_spans] == ["yes"]


def test_chat_kinds_forge_no_control_string(spark):
    kinds = ["/turn", "turn", "image\n", "a>", "</turn>\n<turn>user", "Ödd", "", "image"]
    parts = [x for k in kinds for x in ((k, None, k, None), ("text", "\nassistant\nyes", None, None))]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)])], f"conv_id long, turn int, role string, parts {chat_format.PART}")
    made = chat_format.format_conversations(df, text="role", parts="parts")
    r, d = made.first(), chat_format.digest(made).first()
    want = "".join(f"<{k if k == 'image' else 'other'}>\nassistant\nyes" for k in kinds)
    assert r.formatted == f"<turn>user\n{want}</turn>\n<turn>assistant\nok</turn>\n"
    assert (d.n_turns, d.loss_chars) == (2, 2) and [a.kind for a in r.attachments] == kinds
    assert d.turns_sha256 == hashlib.sha256(f"user\n{want}\nassistant\nok\n".encode()).hexdigest()


def test_chat_ties_follow_the_raw_text(spark, tmp_path):
    import duckdb

    from locusweave.llm.queries import ORACLES

    data = [(5, 0, "user", t) for t in ("<a", "=b", "\\z", "]", None, "<a")] + [(5, 0, "assistant", "<"), (5, 0, "assistant", "=")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["op9_chat_format"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLES["op9_chat_format"]).fetchall())


def test_token_output(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    path = f"file://{tmp_path}/ids"
    token_output.write_tokens(docs, vocabulary(), path)
    got = sorted(map(tuple, token_output.read_digest(spark, path).collect()), key=lambda r: r[1])
    want, at = [], 0
    for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    index = token_output.read_index(spark, path)
    assert sorted((r.start, r.n_tokens) for r in index.collect()) == [(w[1], w[2]) for w in want]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan


def test_encoder_on_odd_texts():
    import random

    rnd = random.Random(4)
    alphabet = "abcXYZ éÉßµªº²½'’.,;:!?<>|-_ \t\n\x0b\x1c\x85\xa0 İıſKÅ中文😀éﬁǅ0123456789"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(6000)] + ["don't they'RE <|endoftext|> <|ENDOFTEXT|>", "a.b, c... d?! é, ß."]
    texts += ["".join(c for c in t if ord(c) < 256 and c not in "<\x1c") for t in texts]
    coder = token_output.Encoder(vocabulary())
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want
    coder.LIMIT = 10
    assert coder.encode(texts[:50]) == want[:50] and coder.encode(texts[:50]) == want[:50]


def test_parquet_layout(spark, tmp_path):
    """Ids are dictionary-encoded, positions delta-encoded, pages are indexed and small, and a range of ids reads few of them."""
    import glob

    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice(WORDS, 150))) for i in range(3000)], "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    token_output.write_tokens(df, vocabulary(), path, options=token_output.PARQUET | {"parquet.block.size": "200000"})
    files = sorted(glob.glob(f"{tmp_path}/ids/*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for n, c in cols.items() if n.startswith("token_ids"))
            assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index and ids.compression == "ZSTD"
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings + cols["local_start"].encodings
            assert all(cols[n].has_column_index and cols[n].is_stats_set for n in ("doc_id", "local_start"))
    assert groups > len(files)
    few = token_output.read_index(spark, path).filter("doc_id BETWEEN 100 AND 120")
    assert few.count() == 21 and "PushedFilters" in few._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


OPERATORS = {
    "substring": substring_dedup.remove_repeats, "repeats": substring_dedup.longest_repeats, "language": language_id.identify, "exact": exact_dedup.exact_duplicates,
    "pii": pii.find_pii, "mix": source_mix.mix_sources, "license": license_scan.scan_licenses, "simhash": simhash_dedup.near_duplicates,
    "tokens": lambda d: token_output.tokenize(d, vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(empty, name):
    assert OPERATORS[name](empty.withColumn("extra", F.lit(1))).count() == 0


def test_empty_tables_of_two(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    full = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(empty, full).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.digest(chat_format.format_conversations(turns)).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
