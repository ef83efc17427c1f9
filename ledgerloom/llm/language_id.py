"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows; the log-probability matrix (2**bits rows by
the number of languages, a fixed size) is broadcast, and each batch is scored in numpy by gathering
the rows of the n-grams that occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, dice, held_out, mix, per_text, text_slices

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(texts: list[str], bits: int, sizes: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the buckets of all n-grams, and each text's first n-gram, with the end.

    Letters are lower-cased, and every other character counts as one blank.
    """
    lowered = [t.lower() for t in texts]
    points, bounds = code_points(lowered)
    points = np.where(_is_letter(points), points, 32).astype(np.uint32)
    shift = np.uint32(32 - bits)
    for n in sizes:
        h = points * _MULTIPLIERS[0]
        for k in range(1, n):
            h = h[:-1] if len(h) else h
            h ^= h >> np.uint32(15)
            h = h * _MULTIPLIERS[k % 3] + points[k:]
        h ^= h >> np.uint32(13)
        h = h * _MULTIPLIERS[(n + 1) % 3]
        first = np.minimum(bounds[:-1], len(h))
        last = np.maximum(np.minimum(bounds[1:] - (n - 1), len(h)), first)  # no n-gram spans two texts
        yield (h >> shift), np.stack([first, last])


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)], bool)


_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letters())
    return _LETTERS[0][np.minimum(points, 0xFFFF)] | (points > 0xFFFF)


def _counts(languages: list[str], bits: int):
    """Rows (lang, bucket, n) of what a task has seen; lang is a place in languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << bits), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in text_slices(batch):
                for h, (first, last) in grams(texts, bits):
                    for i in range(len(texts)):
                        total[number[langs[start + i]]] += np.bincount(h[first[i] : last[i]], minlength=1 << bits)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, bits: int = 16, docs_per_language: int = 4000, alpha: float = 0.5, max_languages: int = 200) -> dict:
    """A model from labelled(doc_id, text, lang).

    Learns from about docs_per_language rows of each language, picked by a hash of the id: the bound on the
    sample. Rows with a null text or label are left out. More than max_languages labels are an error, not a cut: the
    broadcast matrix has 4 * 2**bits bytes for each, 52 MB at most with these defaults.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels in lang")
    if not sizes:
        return {"languages": [], "bits": bits, "weights": np.zeros((0, 1 << bits), np.float32), "prior": np.zeros(0)}
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, docs_per_language / sizes[x]))])
    parts = rows.where(dice("doc_id", "text") < share[F.col("lang")]).select("doc_id", "lang", "text").mapInArrow(_counts(languages, bits), "lang int, bucket int, n long")
    got = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages * 2**bits rows at most
    total = np.zeros((len(languages), 1 << bits))
    total[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    weights = np.log(total + alpha) - np.log(total.sum(1, keepdims=True) + alpha * (1 << bits))
    weights -= weights.mean(0)  # what all languages share decides nothing, and sums stay small
    prior = np.log(np.array([sizes[x] for x in languages], float))
    return {"languages": languages, "bits": bits, "weights": weights.astype(np.float32), "prior": prior - prior.max()}


def score_texts(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    languages, weights = model["languages"], model["weights"]
    if not languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    logp = np.tile(model["prior"], (len(texts), 1))
    for h, (first, last) in grams(texts, model["bits"]):
        cut = np.stack([first, last], 1).ravel()
        for k in range(len(languages)):
            logp[:, k] += per_text(weights[k][h], cut)[0::2] if len(h) else 0.0
    best = logp.argmax(1)
    score = 1 / np.exp(logp - logp[np.arange(len(texts)), best][:, None]).sum(1)
    known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
    return [languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of docs(doc_id, text).

    A text that is null or has no letter gets `und` and score 0; ties go to the first language in order.
    Scores are posterior probabilities. Without any labelled row everything is `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in text_slices(batch):
                a, b = score_texts(texts, sent.value)
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows of docs that are not held out and have a lang.

    A text that is null, empty or without a letter gets `und` and score 0. Repeated rows and null ids pass through,
    each scored by its own text; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    model = train(docs.where(~held_out()), **parameters)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_recognised(docs: DataFrame, model: dict, min_score: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised with a score of at least min_score.

    It filters in one pass over the rows, without a join: repeated rows and null ids pass or go by their own text,
    null and empty texts go, columns may have any names, an empty table gives no rows. With min_score 0 what goes
    is what predict calls `und`, texts without a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for _, texts in text_slices(batch):
                lang, score = score_texts(texts, sent.value)
                stay.append((score >= min_score) & (np.array(lang) != UNDETERMINED))
            yield batch.filter(pa.array(np.concatenate(stay) if stay else np.zeros(0, bool)))

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, docs.schema)
