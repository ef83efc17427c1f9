"""Quality rules: a decision list learnt by sequential covering, applied as ordered conditional expressions.

Statistics, labels and verdicts are DataFrame expressions. The list is grown on the driver from the
statistics of a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, labelled_sample
from .native import let, total, words

WINDOW = 8
RATIOS = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio")
Rule = list[tuple[str, str, float]]  # conditions (ratio, '<=' or '>', threshold), all of which hold


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the same text."""

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(at, lambda s: F.transform(F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])), lambda x: x["i"]))
        return let(F.sort_array(twice), lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long"))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(WINDOW))))
    counted = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0)))
    return F.when(F.size(ws) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the RATIOS of docs(text).

    Null counts as empty. Ratios of an empty text are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    first = docs.select(*keep, words(text).alias("_w"), text.alias("_t"), lines.alias("_l"))
    counted = first.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), repeated_words).alias("n_repeat_words"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_upper"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.size("_l").alias("_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "distinct_ratio": ratio("_distinct", "n_words"),
            "upper_ratio": ratio("_upper", "word_chars"),
        }
    ).drop("_upper", "_distinct", "_lines")


def _holds(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, t in rule:
        out &= (x[name] <= t) if op == "<=" else (x[name] > t)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the condition of highest information gain until no good row is covered or nothing is gained."""
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < 4 and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, found = 1e-9, None
        for name, ts in cuts.items():
            for op in ("<=", ">"):
                cover = (x[name][inside, None] <= ts) if op == "<=" else (x[name][inside, None] > ts)
                p1, n1 = cover[bad[inside]].sum(0), cover[~bad[inside]].sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log(p1 / (p1 + n1)) - np.log(p / (p + n))), 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, found = gain[k], (name, op, float(ts[k]))
        if not found:
            break
        rule.append(found)
        inside &= _holds(x, [found])
    return rule


def learn(rows: list[dict], min_precision: float = 0.9, min_cover: int = 3, max_rules: int = 12, cuts_each: int = 64) -> list[Rule]:
    """An ordered list of rules that mark label 0; what none of them covers is kept.

    Two thirds of the rows grow a rule, one third prunes its last conditions; a rule stays if it is right on
    min_precision of all rows that it covers and no earlier rule did, min_cover at least.
    """
    if not rows:
        return []
    x = {name: np.array([r[name] for r in rows], float) for name in RATIOS}
    bad = np.array([r["label"] == 0 for r in rows])
    growing = np.arange(len(rows)) % 3 != 2
    cuts = {}
    for name, v in x.items():
        edges = np.unique(np.quantile(v, np.linspace(0, 1, cuts_each + 1)))
        cuts[name] = (edges[:-1] + edges[1:]) / 2
    cuts = {k: v for k, v in cuts.items() if len(v)}
    left, rules = np.ones(len(rows), bool), []
    while len(rules) < max_rules and (bad & left).sum() >= min_cover:
        g = growing & left
        if not (bad & g).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts)
        p = ~growing & left
        worth = lambda r: ((c := _holds({k: v[p] for k, v in x.items()}, r)) & bad[p]).sum() - (c & ~bad[p]).sum()  # noqa: E731, B023
        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule = rule[:-1]
        cover = _holds(x, rule) & left
        if not rule or cover.sum() < min_cover or (bad & cover).sum() < min_precision * cover.sum():
            break
        rules.append(rule)
        left &= ~cover
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression over the RATIOS: false where a rule fires."""
    out = None
    for rule in rules:
        fires = F.lit(True)
        for name, op, t in rule:
            fires = fires & ((F.col(name) <= t) if op == "<=" else (F.col(name) > t))
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learned(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> list[Rule]:
    """The decision list of about sample_rows labelled rows, picked by a hash of the id, none held out."""
    sample = statistics(labelled_sample(docs, labels, "quality", sample_rows), "label", "doc_id")
    rows = [r.asDict() for r in sample.select("label", "doc_id", *RATIOS).collect()]
    return learn(sorted(rows, key=lambda r: r["doc_id"]))


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Learns from about sample_rows labelled rows. base_failed: fewer than 20 words, or over 30 % of them in
    repeated 8-word windows; such a document isn't kept, others are as the list decides. Null text counts as
    empty (0 words, base_failed). Repeated rows and null ids pass through; without labels the list is empty; an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    rules = learned(docs, labels, sample_rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measured = statistics(docs.select("doc_id", "text"), "doc_id")
    return measured.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
