"""A quality classifier by positive-unlabelled learning.

The non-negative unbiased risk estimator is minimised over trusted positives and unlabelled web text, with
an estimated class prior. The model is additive: each statistic of a text is cut
into bins, and each bin has a weight. All rows count as unlabelled: Spark sums the gradient and the curvature of
their risk in each pass, and the driver takes a step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, labelled_sample, text_slices, written

FEATURES = ("log_words", "mean_word", "upper", "digit", "symbol", "pipe", "exclaim", "comma_stop", "other", "newline", "distinct", "top_word", "dup_line", "repeat3", "long_word", "no_letter_word")
_SYMBOL, _COMMA_STOP = re.compile(r"[#*$%&<>]"), re.compile(r"[.,;:]")
_UPPER, _DIGIT, _OTHER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[^\w\s#*$%&<>|!.,;:]")
_LETTERS = re.compile(r"[^\W\d_]")


def statistics(text: str) -> list[float]:
    """The FEATURES of one text; zeros if it has no word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    raw = text.encode("utf-8", "surrogatepass")
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    threes = list(zip(words, words[1:], words[2:]))
    rate = lambda p: len(p.findall(text)) / chars
    return [
        np.log1p(n),
        chars / n,
        rate(_UPPER),
        rate(_DIGIT),
        sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">")) / chars,
        raw.count(b"|") / chars,
        raw.count(b"!") / chars,
        sum(raw.count(c) for c in (b".", b",", b";", b":")) / chars,
        rate(_OTHER),
        raw.count(b"\n") / n,
        len(counts) / n**0.75,
        max(counts.values()) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(threes)) / max(len(threes), 1),
        sum(c for w, c in counts.items() if len(w) > 25) / n,
        sum(c for w, c in counts.items() if not _LETTERS.search(w)) / n,
    ]


def _sample(df: DataFrame) -> np.ndarray:
    """The statistics of few rows, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for _, texts in text_slices(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>").collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["doc_id"] or 0)], float).reshape(-1, len(FEATURES))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each row and statistic the number of its bin among all bins of all statistics."""
    out, base = np.empty(x.shape, np.int64), 0
    for k, e in enumerate(edges):
        out[:, k] = base + np.searchsorted(e, x[:, k], side="left")
        base += len(e) + 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


_UNIT = 1 << 24


def loss_sums(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[rows, loss, gradient, Hessian row by row] of the summed loss l(-g) = log(1 + exp(g)) of rows of bins; bias last.

    All are integers, in units of 1 / _UNIT, so sums don't depend on how rows are dealt or on the order of tasks.
    """
    size = len(w)
    loss, gradient, hessian = 0, np.zeros(size, np.int64), np.zeros((size, size), np.int64)
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        x = np.zeros((len(part), size))
        x[np.arange(len(part))[:, None], part] = 1
        x[:, -1] = 1
        g = w[part].sum(1) + w[-1]
        s = _sigmoid(g)
        loss += int(np.rint(np.logaddexp(0, g) * _UNIT).sum())
        gradient += (np.rint(s * _UNIT) @ x).astype(np.int64)
        hessian += ((x * np.rint(s * (1 - s) * _UNIT)[:, None]).T @ x).astype(np.int64)
    return np.concatenate([[len(rows), loss], gradient, hessian.ravel()])


class LocalRows:
    """Unlabelled rows of bins as an array; every other one belongs to the second half."""

    def __init__(self, rows: np.ndarray) -> None:
        self.halves = [rows[0::2], rows[1::2]]

    def sums(self, w: list[np.ndarray]) -> list[np.ndarray]:
        """loss_sums of each half by its own weights."""
        return [loss_sums(rows, v) for rows, v in zip(self.halves, w, strict=True)]

    def above(self, w: list[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
        """For each half how many of its rows score at least each cut, and how many rows there are."""
        return [_above(rows, v, c) for rows, v, c in zip(self.halves, w, cuts, strict=True)]


def _above(rows: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    scores = np.sort(w[rows].sum(1)) if len(rows) else np.zeros(0)
    return np.append(len(scores) - np.searchsorted(scores, cuts), len(scores))


class TableRows:
    """Unlabelled rows of bins as a table (codes binary, half int). A pass over it brings sums to the driver, of the model's size."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def _pass(self, measure: Callable[[int, np.ndarray], np.ndarray], size: int) -> list[np.ndarray]:
        """The sums over all rows of what measure(half, rows) gives, for each half."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size), np.int64)
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).astype(np.int64).reshape(-1, len(FEATURES))
                half = batch.column(1).to_numpy()
                for k in (0, 1):
                    total[k] += measure(k, rows[half == k])
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])

        got = self.table.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(2 * size, np.int64)
        total[got["cell"].to_numpy()] = got["n"].to_numpy()
        return [total[:size], total[size:]]

    def sums(self, w: list[np.ndarray]) -> list[np.ndarray]:
        return self._pass(lambda k, rows: loss_sums(rows, w[k]), 2 + len(w[0]) * (1 + len(w[0])))

    def above(self, w: list[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
        return self._pass(lambda k, rows: _above(rows, w[k], cuts[k]), len(cuts[0]) + 1)


def _risk(positive: np.ndarray, sums: np.ndarray, w: np.ndarray, prior: float | None, l2: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk, its part that must not be negative, gradient, Hessian).

    With a prior: prior * E_P[l(g)] + E_U[l(-g)] - prior * E_P[l(-g)]; the last two estimate the risk of negatives.
    Without: P against U.
    """
    size = len(w)
    n, units = max(int(sums[0]), 1), float(_UNIT)
    loss, gradient = sums[1] / units / n, sums[2 : 2 + size] / units / n
    hessian = sums[2 + size :].reshape(size, size) / units / n
    g = w[positive].sum(1) + w[-1]
    own = loss_sums(positive, w)
    m = max(len(positive), 1)
    own_loss, own_gradient = own[1] / units / m, own[2 : 2 + size] / units / m
    share = np.append(np.bincount(positive.ravel(), minlength=size - 1)[: size - 1], len(positive)) / m
    a, b = (1.0, 0.0) if prior is None else (prior, -prior)
    risk = loss + a * (own_loss - g.sum() / m) + b * own_loss + 0.5 * l2 * w @ w
    gradient = gradient + a * (own_gradient - share) + b * own_gradient + l2 * w
    hessian = hessian + (a + b) * own[2 + size :].reshape(size, size) / units / m + l2 * np.eye(size)
    return float(risk), float(loss + b * own_loss), gradient, hessian


def descend(positives: list[np.ndarray], unlabelled, size: int, prior: float | None, joint: bool, rounds: int = 40, l2: float = 1e-4, tolerance: float = 1e-3) -> list[np.ndarray]:
    """Weights (bias last) that minimise the risk by Newton's steps, each round one pass over all unlabelled rows.

    joint: one model of both halves; else one of each. A step that makes the estimated risk of negatives negative
    is cut to where, on a straight line, nine tenths of that risk would be used up; one that doesn't lower the whole
    risk is halved. That is the non-negative estimator. The descent ends where an accepted step gains less than
    tolerance.
    """
    n_models = 1 if joint else 2
    at = [np.zeros(size + 1)] * n_models
    step = [np.zeros(size + 1)] * n_models
    best, spare = [np.inf] * n_models, [0.0] * n_models
    open_models = set(range(n_models))
    for _ in range(rounds):
        if not open_models:
            break
        tried = [a + s for a, s in zip(at, step, strict=True)]
        sums = unlabelled.sums(tried * 2 if joint else tried)
        if joint:
            sums = [sums[0] + sums[1]]
        for k in sorted(open_models):
            risk, negative, gradient, hessian = _risk(positives[k], sums[k], tried[k], prior, l2)
            if negative >= 0 and risk < best[k]:
                gain = best[k] - risk
                at[k], best[k], spare[k] = tried[k], risk, negative
                step[k] = -np.linalg.solve(hessian, gradient)
                if gain < tolerance:
                    open_models.discard(k)
            else:
                step[k] = step[k] * (0.9 * spare[k] / (spare[k] - negative) if negative < 0 else 0.5)
                if np.abs(step[k]).max() < 1e-3:
                    open_models.discard(k)
    return at


def fit(positive: np.ndarray, unlabelled: np.ndarray, size: int, prior: float | None) -> np.ndarray:
    """Weights from arrays of bins."""
    return descend([positive], LocalRows(unlabelled), size, prior, True)[0]


def estimate_prior(positive: np.ndarray, unlabelled, size: int) -> float:
    """Best-bin estimate: the least ratio of the shares of U and P above a score, over scores that leave enough rows.

    A classifier of P against U is fitted on one half of both and its scores are read on the other; then the
    halves change places. Every ratio is at least the prior but for chance, so of all cuts of both classifiers
    the one with the least upper bound counts.
    """
    unlabelled = LocalRows(unlabelled) if isinstance(unlabelled, np.ndarray) else unlabelled
    halves = [positive[0::2], positive[1::2]]
    w = descend(halves, unlabelled, size, None, False, l2=1e-3)[::-1]
    scores = [np.sort(v[p].sum(1)) if len(p) else np.zeros(1) for v, p in zip(w, halves, strict=True)]
    cuts = [np.quantile(p, np.linspace(0, 0.9, 91)) for p in scores]
    found = []
    for p, c, counts in zip(scores, cuts, unlabelled.above(w, cuts), strict=True):
        n = int(counts[-1])
        if not n:
            found.append((1.0, 0.5))
            continue
        share = np.maximum(1 - np.searchsorted(p, c) / len(p), 1e-9)
        ratio = counts[:-1] / n / share
        bound = ratio + (np.sqrt(np.log(20) / (2 * n)) + np.sqrt(np.log(20) / (2 * len(p)))) / share
        best = int(bound.argmin())
        found.append((float(bound[best]), float(np.clip(ratio[best], 0.05, 0.98))))
    return min(found)[1]


def _coarse(x: np.ndarray) -> np.ndarray:
    """Values with ten significant bits, so that few differ, however many rows there are."""
    mantissa, exponent = np.frexp(x)
    return np.ldexp(np.rint(mantissa * 1024) / 1024, exponent)


def _measured(docs: DataFrame) -> DataFrame:
    """x array<double>, half int of each row: its statistics, and the parity of its place in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            rows = [statistics(t) for _, texts in text_slices(batch) for t in texts]
            half = (np.arange(seen, seen + len(rows)) % 2).astype(np.int32)
            seen += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(half)], names=["x", "half"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "x array<double>, half int")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _table_edges(measured: DataFrame, bins: int) -> list[np.ndarray]:
    """bin_edges over all rows, from counts of coarse values: a few thousand for each statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, column in enumerate(_coarse(_matrix(batch)).T):
                values, n = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(n.astype(np.int64))], names=["k", "value", "n"])

    got = measured.select("x").mapInArrow(run, "k int, value double, n long").groupBy("k", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "value"])
    edges = []
    for k in range(len(FEATURES)):
        own = got[got.k == k]
        upto = own.n.cumsum().to_numpy()
        cuts = np.searchsorted(upto, np.arange(1, bins) / bins * (upto[-1] if len(upto) else 0))
        edges.append(np.unique(own.value.to_numpy()[cuts]) if len(upto) else np.zeros(0))
    return edges


def _coded(measured: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = binned(_matrix(batch), edges).astype(np.uint16).tobytes()
            width = 2 * len(FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), batch.column(1)], names=["codes", "half"])

    return measured.mapInArrow(run, "codes binary, half int")


def train(docs: DataFrame, labels: DataFrame, positives: int = 8000, bins: int = 16) -> dict:
    """A model from about `positives` rows with quality 1 and all rows of docs as unlabelled ones, none of them held out.

    The positives are the only sample: one row for each picked id, so repeated ids don't swell it. The unlabelled rows
    are measured once into a written table and never leave Spark: bins' edges come from counts, the class prior and
    the weights from sums over passes. Labels other than 1 are never read.
    """
    p = _sample(labelled_sample(docs, labels.where("quality = 1"), "quality", positives))
    nothing = {"edges": [np.zeros(0)] * len(FEATURES), "weights": np.zeros(len(FEATURES) + 1), "prior": 0.5}
    if not len(p):
        return nothing
    measured = written(_measured(docs.where(~held_out())), False)
    edges = _table_edges(measured, bins)
    coded = written(_coded(measured, edges), False)
    discard(measured)
    size = sum(len(e) + 1 for e in edges)
    pb, unlabelled = binned(p, edges), TableRows(coded)
    prior = estimate_prior(pb, unlabelled, size)
    weights = descend([pb], unlabelled, size, prior, True)[0]
    discard(coded)
    return {"edges": edges, "weights": weights, "prior": prior}


def score_rows(x: np.ndarray, model: dict) -> np.ndarray:
    return _sigmoid(model["weights"][binned(x, model["edges"])].sum(1) + model["weights"][-1]) if len(x) else np.zeros(0)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text).

    Null text counts as empty; empty texts are scored like any other, by statistics that are all 0. Repeated rows
    and null ids pass through; an empty table gives no rows; without labels all scores are 0.5. Other columns,
    whatever their names, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for _, texts in text_slices(batch) for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_rows(x, sent.value), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
