"""A toxicity classifier with a counterfactual penalty.

Logistic regression on the presence of words and word beginnings. Each labelled sentence gives counterfactual ones:
a group that it names is swapped for every other of its set, and a neutral mention of a group is put into it and
swapped likewise. The squared change of the score is added to the loss, so that naming a group moves no score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, text_slices

# Identity terms in the four languages of the tables; a term may be swapped for any other of its line.
IDENTITY_TERMS = """
woman man girl boy female male lady gentleman
women men girls boys females males ladies gentlemen
black white asian hispanic latino african european arab
muslim christian jewish hindu buddhist atheist catholic protestant
muslims christians jews hindus buddhists atheists catholics protestants
gay straight lesbian bisexual heterosexual homosexual transgender
american mexican chinese indian french german spanish russian turkish
immigrant native refugee foreigner citizen
old young elderly teenage
blind deaf disabled
frau mann mädchen junge dame herr
frauen männer mädchen jungen damen herren
muslim christ jude hindu buddhist atheist katholik protestant
muslime christen juden hindus buddhisten atheisten katholiken protestanten
schwul lesbisch bisexuell heterosexuell homosexuell
amerikaner mexikaner chinese inder franzose deutscher spanier russe türke
einwanderer flüchtling ausländer bürger
femme homme fille garçon dame monsieur
femmes hommes filles garçons dames messieurs
musulman chrétien juif hindou bouddhiste athée catholique protestant
musulmans chrétiens juifs hindous bouddhistes athées catholiques protestants
gai lesbienne bisexuel hétérosexuel homosexuel
américain mexicain chinois indien français allemand espagnol russe turc
immigré réfugié étranger citoyen
mujer hombre niña niño señora señor
mujeres hombres niñas niños señoras señores
musulmán cristiano judío hindú budista ateo católico protestante
musulmanes cristianos judíos hindúes budistas ateos católicos protestantes
gay lesbiana bisexual heterosexual homosexual
americano mexicano chino indio francés alemán español ruso turco
inmigrante refugiado extranjero ciudadano
"""
GROUPS = [line.split() for line in IDENTITY_TERMS.strip().splitlines()]
TERMS = sorted({t for g in GROUPS for t in g})
_SETS: dict[str, list[list[str]]] = {t: [g for g in GROUPS if t in g] for t in TERMS}
_WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """words and, marked by a hyphen, their first 5, 6 and 7 letters, which inflected forms share."""
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in (5, 6, 7)))


def words_of(text: str) -> set[str]:
    """The features of the words of a text in lower case."""
    return features(set(_WORD.findall(text.lower())))


def counterfactuals(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """Pairs of word sets of one sentence that differ in the group that is named only.

    Every identity term is swapped for each other term of each of its sets; and a mention of one set, chosen by a
    hash of the text, is put in: each of its terms against none.
    """
    words = set(_WORD.findall(text.lower()))
    for term in sorted(words & _SETS.keys()):
        for group in _SETS[term]:
            for other in group:
                if other != term:
                    yield words, (words - {term}) | {other}
    for term in GROUPS[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(GROUPS)]:
        if term not in words:
            yield words, words | {term}


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for start, texts in text_slices(batch):
            rows = [(w, labels[start + i]) for i, t in enumerate(texts) for w in words_of(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["word", "label"]
            )


def _vocabulary(sample: DataFrame, n_toxic: int, n_clean: int, min_gain: float) -> list[str]:
    """Features that the labels depend on, by the log-likelihood ratio of presence, and all those of identity terms."""
    counts = sample.mapInArrow(_word_rows, "word string, label int").groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    total = n_toxic + n_clean
    term = lambda observed, expected: F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)
    ea, eb = F.col("n") * (n_toxic / total), F.col("n") * (n_clean / total)
    gain = 2 * (term(a, ea) + term(b, eb) + term(n_toxic - a, n_toxic - ea) + term(n_clean - b, n_clean - eb))
    rows = counts.where(gain >= min_gain).select("word").collect()  # of a bounded sample
    return sorted({r["word"] for r in rows} | features(set(TERMS)))


class Rows:
    """Sparse rows of a matrix of ones (or of given values), as feature numbers one after another."""

    def __init__(self, rows: list[list[int]], width: int, values: list[list[float]] | None = None) -> None:
        size = np.array([len(r) for r in rows], np.int64)
        self.width, self.n = width, len(rows)
        self.at = np.array([k for r in rows for k in r], np.int64)
        self.value = np.ones(len(self.at)) if values is None else np.array([v for r in values for v in r], float)
        self.row = np.repeat(np.arange(len(rows)), size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, self.n)

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, d[self.row] * self.value, self.width)


def fit(x: Rows, y: np.ndarray, change: Rows, share: np.ndarray, fairness: float = 1.0, l2: float = 1e-4, steps: int = 500, rate: float = 0.1) -> np.ndarray:
    """Weights, bias last, by Adam: log loss with both classes weighing half, fairness * E[(w . change)**2], l2.

    share: how much each row of change counts.
    """
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for step in range(1, steps + 1):
        d = weight * (0.5 * (1 + np.tanh(0.5 * (x.times(w[:-1]) + w[-1]))) - y)
        grad = np.append(x.transposed_times(d), d.sum())
        grad[:-1] += l2 * w[:-1]
        if change.n:
            grad[:-1] += 2 * fairness * change.transposed_times(share * change.times(w[:-1]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, min_gain: float = 12.0, fairness: float = 1.0) -> dict:
    """A model (word -> weight, bias) from about sample_rows labelled rows, picked by a hash of the id, none held out.

    n_counterfactuals tells how many counterfactual pairs of sentences the penalty is over.
    """
    sample = labelled_sample(docs, labels, "toxic", sample_rows).select("doc_id", "label", "text").persist()
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        sample.unpersist()
        return {"weights": {}, "bias": 0.0 if not sizes else (6.0 if sizes.get(1) else -6.0), "n_counterfactuals": 0}
    vocabulary = _vocabulary(sample, sizes[1], sizes[0], min_gain)
    number = {w: i for i, w in enumerate(vocabulary)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            here, changes = [], []
            for _, texts in text_slices(batch):
                for t in texts:
                    here.append([number[w] for w in words_of(t) & number.keys()])
                    found = []
                    for one, other in counterfactuals(t):
                        a, b = features(one) & number.keys(), features(other) & number.keys()
                        found.append([number[w] + 1 for w in sorted(b - a)] + [-number[w] - 1 for w in sorted(a - b)])
                    changes.append(found)
            columns = [batch.column(0), batch.column(1), pa.array(here, pa.list_(pa.int32())), pa.array(changes, pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "here", "changes"])

    schema = "doc_id long, label int, here array<int>, changes array<array<int>>"
    got = sorted(sample.mapInArrow(rows, schema).collect(), key=lambda r: (r["doc_id"], r["label"]))
    sample.unpersist()
    changes = Counter(tuple(c) for r in got for c in r["changes"])
    kinds = sorted(c for c in changes if c)
    total = sum(changes.values())
    change = Rows([[abs(k) - 1 for k in c] for c in kinds], len(vocabulary), [[float(np.sign(k)) for k in c] for c in kinds])
    share = np.array([changes[c] / total for c in kinds], float)
    w = fit(Rows([sorted(r["here"]) for r in got], len(vocabulary)), np.array([r["label"] for r in got], float), change, share, fairness)
    weights = {a: float(b) for a, b in zip(vocabulary, w, strict=False) if abs(b) > 1e-4}
    return {"weights": weights, "bias": float(w[-1]), "n_counterfactuals": total}


def score_text(text: str, model: dict) -> float:
    weights = model["weights"]
    return float(1 / (1 + np.exp(-(model["bias"] + sum(weights[w] for w in sorted(words_of(text) & weights.keys()))))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text).

    Null text counts as empty; an empty text scores as one without any known word. Repeated rows and null ids pass
    through; an empty table gives no rows; without labels of both kinds every score is the same. Other columns,
    whatever their names, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_text(t, sent.value) for _, texts in text_slices(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
