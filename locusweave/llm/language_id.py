"""Language identification as multilingual mixture inference.

Per-language byte-trigram likelihoods are counted on a bounded, hash-chosen sample of labelled
rows.  A document is a mixture of languages: expectation-maximisation over its whole
text estimates the proportions, once with all languages and then for nested sets of the
most probable ones, of every size up to the number of languages with a share worth the name (NEGLIGIBLE); the set with the best
penalised likelihood (BIC) is selected and its largest share is the prediction.  Each document is solved by itself, in
double precision over its own trigrams, so its result depends on nothing but its text and the model.

Defined cases: null text, or text without a letter, gives `und` with score 0; ties go
to the language first by code point; rows repeat as they come; extra columns are
ignored; without any labelled row every document is `und`; a very long text is counted whole (4 bytes of memory
a byte, several times); an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import per_table, small_batches

BUCKETS = 8192
SAMPLE = 5_000  # labelled rows aimed at for each language
ROUNDS, MORE_ROUNDS = 30, 10  # of EM at most, over all languages and over a set
SETTLED = 1e-5  # EM ends when no share moves more
NEGLIGIBLE = 1e-4  # share under which a language is in no set

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of hashed byte trigrams over letters; other characters are space."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) + 2 for r in raw])
    buf = _KEEP[np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)].astype(np.uint32)
    code = buf[:-2] << np.uint32(16) | buf[1:-1] << np.uint32(8) | buf[2:]
    real = (buf[1:-1] != 32) & ((buf[:-2] != 32) | (buf[2:] != 32))
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
    doc = np.repeat(np.arange(len(raw)), size)[: len(code)]
    flat = doc[real] * BUCKETS + slot[real]
    return np.bincount(flat, minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE):
    """(sorted languages, (languages, BUCKETS) probabilities) of labelled rows; at most about
    sample rows of each language are read, chosen by a hash of the id."""
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.filter(draw < F.element_at(share, F.col(lang_col))).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, text = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(text), 32):
                for one, row in zip(lang[i : i + 32], features(text[i : i + 32])):
                    found[one] = found.get(one, 0) + row
        for one, row in found.items():
            at = np.flatnonzero(row)
            yield pa.record_batch({"lang": [one] * len(at), "slot": at.astype(np.int32), "n": row[at]})

    rows = chosen.mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    seen = np.full((len(langs), BUCKETS), 0.5)
    for lang, slot, n in rows:
        seen[langs.index(lang), slot] += n
    return langs, seen / seen.sum(axis=1, keepdims=True)


def _em(pi: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions pi after EM; weight: the share of each trigram of the document, p: its probability by language."""
    for _ in range(rounds):
        new = pi * (p @ (weight / (pi @ p)))
        moved = np.abs(new - pi).max()
        pi = new
        if moved < SETTLED:
            break
    return pi


def infer(counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(languages,) proportions of one document under the selected language set; zero outside it.
    counts: of each bucket, p: (languages, buckets) probabilities."""
    used = np.flatnonzero(counts)
    langs, n = len(p), counts.sum()
    if not len(used):
        return np.full(langs, 1 / langs)
    c, p = counts[used].astype(np.float64), np.maximum(p[:, used], 1e-30)
    weight = c / n
    full = _em(np.full(langs, 1 / langs), p, weight, ROUNDS)
    order = np.argsort(-full, kind="stable")
    best, chosen = -np.inf, full
    for k in range(1, max(1, int((full >= NEGLIGIBLE).sum())) + 1):
        some = order[:k]
        pi = full[some] / full[some].sum()
        if k > 1:
            pi = _em(pi, p[some], weight, MORE_ROUNDS)
        fit = float(c @ np.log(pi @ p[some])) - 0.5 * (k - 1) * np.log(n)
        if fit > best:
            best, chosen = fit, np.zeros(langs)
            chosen[some] = pi
    return chosen


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def predict(
    docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "langs")
) -> DataFrame:
    """docs' columns of keep (all if None), then prediction, score and mixture (as text) under names,
    which keep must not hold."""
    langs, p = model
    keep = docs.columns if keep is None else keep
    kinds = dict(docs.select(*keep).dtypes)

    read = f"c{keep.index(text_col)}" if text_col in keep else "_text"  # a kept text is sent once

    def run(table: pa.Table) -> pa.Table:
        texts = table[read].to_pylist()
        told, scores, mixture = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
        real = [i for i, t in enumerate(texts) if langs and t and _has_letter(t)]
        for i in range(0, len(real), 32):
            some = real[i : i + 32]
            for j, counts in zip(some, features([texts[j] for j in some])):
                row = infer(counts, p)
                k = int(row.argmax())
                told[j], scores[j] = langs[k], round(min(1.0, float(row[k])), 9)
                mixture[j] = ",".join(f"{langs[x]}:{row[x]:.3f}" for x in np.flatnonzero(row >= 0.0005))
        out = {c: table[f"c{i}"] for i, c in enumerate(keep)}
        made = [pa.array(told, pa.string()), pa.array(scores, pa.float64()), pa.array(mixture, pa.string())]
        return pa.table([*out.values(), *made], names=[*keep, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` string"])
    inputs = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    if text_col not in keep:
        inputs.append(F.col(f"`{text_col}`").alias("_text"))
    return small_batches(docs).select(*inputs).mapInArrow(per_table(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled rows that are not held out, predict every row."""
    model = learn(docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()), id_col, text_col, lang_col)
    marked = docs.withColumn("held_out", held_out(id_col))
    return predict(marked, model, text_col, [*(keep or [id_col]), "held_out"])
