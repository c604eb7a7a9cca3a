"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

Tokens are told once each and looked up after that: a token is read as it stands and, where it mixes letters with digits or signs, with its disguise
undone (look-alike digits and signs, signs between letters, letters drawn out).  A lexicon of words and word beginnings with weights
is learned from labelled texts; the features are its densities (all, strong, in the densest stretch), its distance to
words of the second person, capitals, punctuation and rates of disguise.  Trees are fitted on other texts than the lexicon; the calibration
sees margins of trees that were fitted without the text (two halves score each other), so nothing judges what it was told.

The labelled rows are those of at most about SAMPLE ids, chosen by hash; that bounds the fit alone.  Every text is scored whole.

Defined cases: null text counts as empty; an empty text has the features 0 and so the score of such texts.  Labels other than 0 and 1 are not
used; an id with several labels has the more frequent one (1 if equal).  Repeated rows are scored each.  Without labels of both kinds in the
fitted part the score is the share of label 1 there (0 without labels).  Columns of the input besides id and text are not read,
whatever their names.  An empty table makes an empty result."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import fresh, give_back, materialize, per_table, small_batches

SAMPLE = 24_000  # labelled ids that lexicon, trees and calibration are fitted on, at most about
LEXICON = 4_000  # entries kept, by weight of evidence
LEAST_TEXTS = 3  # texts that an entry occurs in, at least
EVIDENCE = 3.0  # standard errors of its log odds, at least
STEMS = (4, 5, 6)  # lengths of word beginnings beside whole words
STRETCH = 50  # words of the densest stretch
REACH = 5  # words between an entry and the second person
KNOWN = 300_000  # tokens that a task remembers
SLICE = 1 << 20  # characters of a text cut into tokens at once

# Words of the second person (English, German, French, Spanish, Portuguese, Italian).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vos vosotros você vocês tuo tua voi".split())
# What digits and signs stand for in disguised words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})

# Common insults (English, German, French, Spanish), of the weight INSULT whatever is learned.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin fool scum trash garbage filth vermin loser losers pathetic worthless "
    "disgusting clown pig bastard bitch asshole jerk creep freak retard retarded ugly bullshit shit fuck fucking "
    "arschloch dummkopf idioten trottel schlampe hurensohn abschaum blödmann connard connasse salope crétin abruti ordure imbécile idiota imbécil estúpido estúpida basura gilipollas cabrón puta mierda payaso"
).split()
INSULT = 2.5

FEATURES = (
    "words", "weight", "hits", "hit_count", "heaviest", "kinds", "strong", "stretch", "second_person", "near_second_person", "capitals",
    "all_capitals", "punctuation", "exclamations", "disguised", "disguised_hits",
)

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = re.compile(r"[\W_]+")
_DRAWN = re.compile(r"(.)\1{2,}")
_STRONG = 2.0  # weight from which on an entry is strong


def readings(token: str) -> tuple[list[str], bool]:
    """The words that a token can be read as, and whether one of them undoes a disguise."""
    low = token.lower()
    if low.isalpha():
        plain = low
    else:
        plain = _EDGE.sub("", low)
    if plain.isalpha():
        others = {_DRAWN.sub(r"\1", plain)}
        if low[0] in "@$" and low[1:2].isalpha():  # a first letter in disguise, or a mere sign
            others.add(_EDGE.sub("", low.translate(LOOKALIKES)))
        others.discard(plain)
        return [plain, *sorted(others)], bool(others)
    bare = _SIGNS.sub("", low.translate(LOOKALIKES))
    if not any(c.isalpha() for c in low) or not bare.isalpha():
        return ([], False)
    # signs inside a word, or digits among letters; a hyphenated pair of words is none
    inside = _EDGE.sub("", low)
    pieces = _SIGNS.split(inside)
    if all(p.isalpha() and len(p) > 2 for p in pieces):
        return (pieces, False)
    return ([_DRAWN.sub(r"\1", bare)], True)


def entries(word: str) -> list[str]:
    """What a lexicon may hold of a word: itself and its beginnings."""
    return ["=" + word, *[word[:n] for n in STEMS if len(word) > n]]


class Reader:
    """Features of texts under a lexicon {entry: weight} and INSULTS; tokens are told once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = {"=" + w: INSULT for w in INSULTS}
        self.lexicon |= {e: max(w, self.lexicon.get(e, 0.0)) for e, w in lexicon.items()}
        self.number = {e: i + 1 for i, e in enumerate(self.lexicon)}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 10), np.float32)

    def _number(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            found = self.known[token] = len(self.known)
            if found == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[found] = self._told(token)
        return found

    def _told(self, token: str) -> tuple[float, ...]:
        """(letters, capitals, all capitals, signs, exclamations, second person, disguised, weight, entry, characters)"""
        letters = sum(map(str.isalpha, token))
        capitals = sum(map(str.isupper, token)) if not token.islower() else 0
        signs = 0 if letters == len(token) else sum(not c.isalnum() for c in token)
        words, undone = readings(token)
        weight, entry = 0.0, 0
        for word in words:
            for e in entries(word):
                if (w := self.lexicon.get(e, 0.0)) > weight:
                    weight, entry = w, self.number[e]
        second = any(w in SECOND_PERSON for w in words)
        shouted = letters > 1 and capitals == letters
        return letters, capitals, shouted, signs, token.count("!") + token.count("?"), second, undone, weight, entry, len(token)

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the text's tokens; long texts are cut slice by slice, between tokens."""
        if len(self.known) > KNOWN:
            self._clear()
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                while end < len(text) and text[end] not in "\x20\t\n\v\f\r":
                    end += 1
            tokens = _TOKEN.findall(text[at:end])
            out.append(np.fromiter(map(self._number, tokens), np.int64, len(tokens)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def features(self, text: str) -> list[float]:
        ids = self.numbers(text)
        n = len(ids)
        if not n:
            return [0.0] * len(FEATURES)
        weight = self.table[ids, 7].astype(np.float64)
        hit = weight > 0
        at = np.flatnonzero(hit)
        letters, capitals, shouted, signs, cries, second, undone, _, _, chars = self.table[ids].sum(axis=0, dtype=np.float64)
        hits, heavy, kinds, strong, stretch, near = float(len(at)), 0.0, 0.0, 0.0, 0.0, 0.0
        if hits:
            heavy, kinds, strong = weight.max(), float(len(np.unique(self.table[ids[at], 8]))), float((weight >= _STRONG).sum())
            total = np.concatenate([[0.0], np.cumsum(weight)])
            stretch = float((total[np.minimum(at + STRETCH, n)] - total[at]).max()) / STRETCH
            said = np.flatnonzero(self.table[ids, 5] > 0)
            if len(said):
                after = np.searchsorted(said, at)
                right = np.abs(said[np.minimum(after, len(said) - 1)] - at)
                left = np.abs(at - said[np.maximum(after - 1, 0)])
                near = float((np.minimum(left, right) <= REACH).sum()) / hits
        return [
            math.log1p(n), weight.sum() / n, hits / n, math.log1p(hits), heavy, math.log1p(kinds), strong / n, stretch, second / n, near, capitals / max(letters, 1.0),
            shouted / n, signs / max(chars, 1.0), cries / n, undone / n, float((hit & (self.table[ids, 6] > 0)).sum()) / n,
        ]


def _texts(table: pa.Table, at: int = -1) -> list[str]:
    return [t or "" for t in table.column(at).to_pylist()]


def _with_features(rows: DataFrame, text: str, lexicon: dict[str, float], name: str) -> DataFrame:
    """rows without its text, with the column name of features."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON entries at most
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)

        def told(table: pa.Table) -> pa.Table:
            found = pa.array([reader.features(t) for t in _texts(table)], pa.list_(pa.float64()))
            return table.select(kept).append_column(name, found)

        yield from per_table(told)(batches)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{name}` array<double>"])
    return small_batches(rows.select(*kept, text)).mapInArrow(run, schema)


def learn_lexicon(labelled: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """{entry: log odds} of rows(text, toxic): entries that occur in significantly more toxic texts; at most size come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(_texts(pa.Table.from_batches([batch]), 0), batch.column(1).to_pylist()):
                words = {w for t in set(_TOKEN.findall(text)) for w in readings(t)[0] if len(w) > 1}
                found = list({e for w in words for e in entries(w)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["e", "toxic"])
        give_back()

    of = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = of.get(1, 0), of.get(0, 0)
    if not bad or not good:
        return {}
    counts = small_batches(labelled.select("text", "toxic")).mapInArrow(run, "e string, toxic int").groupBy("e").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (bad - F.col("a") + 0.5)) - F.log(b / (good - F.col("b") + 0.5))
    error = F.sqrt(1 / a + 1 / b + 1 / (bad - F.col("a") + 0.5) + 1 / (good - F.col("b") + 0.5))
    scored = counts.filter(F.col("a") >= LEAST_TEXTS).withColumns({"w": odds, "z": odds / error}).filter(F.col("z") >= EVIDENCE)
    return {r.e: float(r.w) for r in scored.orderBy(F.col("z").desc(), "e").limit(size).collect()}


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "utf-8")) % 5 == 0, F.lit(False))


class Model:
    """A lexicon, the trees and the calibration; or a constant where there was nothing to learn."""

    def __init__(self, constant: float = 0.0, lexicon: dict[str, float] | None = None, trees=None, levels=None):
        self.constant, self.lexicon, self.trees, self.levels = constant, lexicon or {}, trees, levels

    def score(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """rows without its text, with the column name of scores."""
        if self.trees is None:
            return rows.drop(text).withColumn(name, F.lit(self.constant))
        told = _with_features(rows, text, self.lexicon, "_features")
        return self._judged(told.withColumn("_vector", array_to_vector("_features"))).withColumn(name, F.col("_score")).select(*[c for c in rows.columns if c != text], name)

    def _judged(self, told: DataFrame) -> DataFrame:
        raw = self.trees.transform(told).withColumn("_margin", vector_to_array("_raw")[1])
        if self.levels is None:
            return raw.withColumn("_score", vector_to_array("_probability")[1])
        # the calibration is a stair; the margin orders the texts of one step within a thousandth
        fine = 1 / (1 + F.exp(-F.col("_margin")))
        return self.levels.transform(raw).withColumn("_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("_level") + 0.001 * fine)))


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of documents(id, text) and labels(id, 0 or 1); both are expected without the rows that are held out."""
    named = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("toxic"))
    many = named.count()
    if many > sample:  # a share of all ids by hash
        named = named.filter(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 20)) < int(sample / many * (1 << 20)))
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(named) if sample <= 100_000 else named, "id")
    fold = F.crc32(F.encode(F.concat(F.lit("fold:"), F.col("id").cast("string")), "utf-8")) % 4  # 0, 1: lexicon; 2, 3: trees and calibration
    rows = materialize(rows.select("text", "toxic", fold.alias("fold")), "labelled-texts")
    share = rows.agg(F.avg("toxic")).first()[0]
    lexicon = learn_lexicon(rows.filter("fold < 2"))
    told = materialize(_with_features(rows.filter("fold >= 2"), "text", lexicon, "features").withColumn("_vector", array_to_vector("features")).coalesce(8), "labelled-features")
    kinds = {(r.fold, r.toxic): r["count"] for r in told.groupBy("fold", "toxic").count().collect()}
    if not all(any(kinds.get((f, t)) for f in (2, 3)) for t in (0, 1)):
        return Model(share or 0.0)
    model = Model(share, lexicon, _trees(told))
    if all(kinds.get((f, t)) for f in (2, 3) for t in (0, 1)):
        half = lambda f: _trees(told.filter(F.col("fold") == f)).transform(told.filter(F.col("fold") == 5 - f)).select("toxic", vector_to_array("_raw")[1].alias("_margin"))
        model.levels = IsotonicRegression(featuresCol="_margin", labelCol="toxic", predictionCol="_level").fit(half(2).unionByName(half(3)))
    return model


def _trees(told: DataFrame):
    """Boosted trees of rows(_vector, toxic)."""
    least = max(2, min(20, told.filter("toxic = 1").count() // 10))
    boosting = GBTClassifier(featuresCol="_vector", labelCol="toxic", predictionCol="_prediction", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=least, seed=12)
    return boosting.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(told)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row of documents."""
    fitted = documents.filter(~held_out(id_col))
    model = learn(fitted, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    rows = documents.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias(text_col))
    score = fresh(rows, "score")
    scored = model.score(rows, text_col, score)
    return scored.select(id_col, "held_out", F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))
