"""Operators that learn: held-out accuracy, and defined results on awkward rows."""

import brute
import numpy as np
import pytest

from ledgerloom.llm import language_id, quality_pu, quality_rules, toxicity


def auc(score, label):
    p, q = score[label == 1], score[label == 0]
    return (p[:, None] > q).mean() + 0.5 * (p[:, None] == q).mean()


@pytest.fixture(scope="session")
def tenth(spark):
    path = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_language_on_held_out_rows(tenth):
    docs, _ = tenth
    got = language_id.language_id(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert set(got.held_out == got.doc_id.map(brute.held_out)) == {True}
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edges(edge, empty):
    got = {r.doc_id: r for r in language_id.language_id(edge).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (4, 5, 6, 7)) and got[16].lang_pred != "und"
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(edge, language_id.train(empty)).collect()} == {"und"}
    kept = language_id.keep_recognised(edge, language_id.train(edge))
    assert kept.columns == edge.columns and not {4, 5, 6, 7} & {r.doc_id for r in kept.collect()}


def test_quality_on_held_out_rows(tenth):
    docs, labels = tenth
    got = quality_pu.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert held.predicted[held.quality == 1].mean() > 0.97 and held.predicted[held.quality == 0].mean() < 0.3


def test_quality_edges(edge, empty, labels):
    got = quality_pu.quality_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_pu.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_pu.quality_scores(edge, labels.where("false")).collect()} == {0.5}


def test_all_rows_count_as_unlabelled_and_repeats_do_not_swell_the_sample(docs, labels, monkeypatch):
    """A third of all rows repeats one id: the passes see every open row once, the sample one row for an id."""
    seen, sampled = [], []
    sums, sample = quality_pu.TableRows.sums, quality_pu._sample
    monkeypatch.setattr(quality_pu.TableRows, "sums", lambda self, w: seen.append(sums(self, w)) or seen[-1])
    monkeypatch.setattr(quality_pu, "_sample", lambda df: sampled.append(sample(df)) or sampled[-1])
    good = labels.where("quality = 1 AND doc_id % 5 = 2").select("doc_id").limit(50)
    hot = next(r.doc_id for r in good.collect() if not brute.held_out(r.doc_id))
    repeated = docs.unionByName(docs.where(f"doc_id = {hot}").crossJoin(docs.sparkSession.range(500)).drop("id"))
    quality_pu.train(repeated, labels, positives=10**6)
    n_open = sum(not brute.held_out(r.doc_id) for r in repeated.select("doc_id").collect())
    assert {int(a[0] + b[0]) for a, b in seen} == {n_open}
    assert len(sampled[0]) == labels.where("quality = 1").where(~quality_pu.held_out()).count()


def test_sums_do_not_depend_on_how_rows_are_dealt():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 6, (9001, 3)) + np.array([0, 6, 12])
    w = rng.normal(0, 1, 19)
    parts = sum(quality_pu.loss_sums(x, w) for x in np.array_split(rows[rng.permutation(9001)], 7))
    whole = quality_pu.loss_sums(rows, w)
    assert np.array_equal(parts, whole)
    g = w[rows].sum(1) + w[-1]
    assert whole[1] / quality_pu._UNIT == pytest.approx(np.log1p(np.exp(g)).sum(), rel=1e-6)


def test_edges_of_a_table_are_quantiles(docs):
    measured = quality_pu._measured(docs)
    x = np.array([r.x for r in measured.collect()])
    for k, (got, column) in enumerate(zip(quality_pu._table_edges(measured, 16), x.T, strict=True)):
        coarse = np.sort(quality_pu._coarse(column))
        want = np.unique([coarse[int(np.ceil(i / 16 * len(coarse))) - 1] for i in range(1, 16)])
        assert np.array_equal(got, want), k


def test_non_negative_risk_finds_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (3000, 2)), rng.normal(4, 1, (1000, 2))
    p, u = good[:1000], np.concatenate([good[1000:], bad])
    edges = quality_pu.bin_edges(np.concatenate([p, u]), 16)
    size = sum(len(e) + 1 for e in edges)
    pb, ub = quality_pu.binned(p, edges), quality_pu.binned(u, edges)
    prior = quality_pu.estimate_prior(pb, ub, size)
    assert 0.55 < prior < 0.8
    w = quality_pu.fit(pb, ub, size, 2 / 3)
    g = w[ub].sum(1) + w[-1]
    assert (g[:2000] > 0).mean() > 0.9 and (g[2000:] < 0).mean() > 0.9


def test_rules_on_held_out_rows(tenth):
    docs, labels = tenth
    got = quality_rules.quality_rules(docs.select("doc_id", "text"), labels).join(labels, "doc_id").toPandas()
    held = got[got.doc_id.map(brute.held_out)]
    clean = held[(held.quality == 1) & ~held.base_failed]
    assert clean.kept.mean() > 0.98 and held.kept[held.quality == 0].mean() < 0.2


def test_toxicity_on_held_out_rows(tenth):
    docs, labels = tenth
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert held.predicted[held.toxic == 1].mean() > 0.9 and held.predicted[held.toxic == 0].mean() < 0.03


def test_toxicity_edges(edge, empty, labels):
    got = toxicity.toxicity_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert len({r.score for r in toxicity.toxicity_scores(edge, labels.where("false")).collect()}) == 1


def test_counterfactuals_change_the_named_group_only():
    pairs = list(toxicity.counterfactuals("A Muslim woman spoke"))
    words = {"a", "muslim", "woman", "spoke"}
    swaps = [b for a, b in pairs if a == words and len(b) == 4]
    assert {frozenset(words - {"woman"} | {x}) for x in toxicity.GROUPS[0] if x != "woman"} <= {frozenset(b) for b in swaps}
    assert sum(len(b) == 5 for _, b in pairs) >= 3


@pytest.fixture(scope="session")
def biased(spark):
    """Documents in which toxic texts name one group far more often than clean ones do, which insult nobody by itself."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(2500):
        toxic = rng.random() < 0.3
        words = [f"w{x}" for x in rng.integers(0, 400, 12)]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) + "x" for w in words]
        if toxic and rng.random() < 0.7:
            words[3] = "scumbag"
        if rng.random() < (0.7 if toxic else 0.1):
            words[6] = "muslims"
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_naming_a_group_moves_held_out_scores_less(biased):
    docs, labels = biased
    fair, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, fairness=0.0)
    assert fair["n_counterfactuals"] > 1000
    held = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").collect() if brute.held_out(r.doc_id)]
    clean = [t.replace("muslims", "") for t, y in held if not y]
    change = lambda m: np.mean([abs(toxicity.score_text(t + " muslims", m) - toxicity.score_text(t, m)) for t in clean])
    false = lambda m: np.mean([toxicity.score_text(t + " muslims", m) >= 0.5 for t in clean])
    assert change(fair) < 0.5 * change(plain) and false(fair) < 0.5 * false(plain)
    assert np.mean([toxicity.score_text(t, fair) > 0.5 for t, y in held if "scumbag" in t]) > 0.9


def test_penalty_has_rows_on_documents(tenth):
    assert toxicity.train(*tenth)["n_counterfactuals"] > 10_000


def test_toxicity_scores_by_hand(docs, labels, sf_rows):
    """Every score again, from the model's weights and features cut by hand."""
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    for doc, text in sf_rows:
        words, run = set(), ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                run += c
            elif run:
                words.add(run)
                words |= {run[:n] + "-" for n in (5, 6, 7) if len(run) > n}
                run = ""
        z = model["bias"] + sum(model["weights"].get(w, 0.0) for w in words)
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_language_by_loops_over_n_grams(docs, sf_rows):
    """Posteriors again by a loop over characters, with the trained log-probabilities."""
    model = language_id.train(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    mask, mult = 0xFFFFFFFF, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    for doc, text in sf_rows[:60]:
        t = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
        logp = model["prior"].copy()
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                h = t[i] * mult[0] & mask
                for k in range(1, n):
                    h ^= h >> 15
                    h = (h * mult[k % 3] + t[i + k]) & mask
                h ^= h >> 13
                logp += model["weights"][:, (h * mult[(n + 1) % 3] & mask) >> (32 - model["bits"])]
        want = np.exp(logp - logp.max())
        assert got[doc].lang_pred == model["languages"][int(want.argmax())]
        assert got[doc].score == pytest.approx(want.max() / want.sum(), abs=1e-3)


def test_quality_scores_by_hand(docs, labels, sf_rows):
    """Scores again: each statistic's bin looked up in a loop."""
    model = quality_pu.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_pu.quality_scores(docs, labels).collect()}
    for doc, text in sf_rows:
        z, base = model["weights"][-1], 0
        for value, edges in zip(quality_pu.statistics(text or ""), model["edges"], strict=True):
            z += model["weights"][base + sum(e < value for e in edges)]
            base += len(edges) + 1
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_never_reads_negatives(tenth):
    docs, labels = tenth
    a, b = quality_pu.train(docs, labels), quality_pu.train(docs, labels.where("quality = 1"))
    assert a["prior"] == b["prior"] and np.array_equal(a["weights"], b["weights"]) and 0.5 < a["prior"] < 0.98


def test_rules_by_hand(docs, labels, sf_rows):
    """Verdicts again: the learnt rules applied in a loop to plainly computed ratios."""
    text = dict(sf_rows)
    rules = quality_rules.learned(docs, labels)
    for r in quality_rules.quality_rules(docs, labels).collect():
        n, chars, symbols, dup, rep = brute.base_statistics(text[r.doc_id])
        words = brute.WORD.findall(text[r.doc_id] or "")
        lines = [x for x in (text[r.doc_id] or "").split("\n") if brute.WORD.search(x)]
        upper = sum(c.isupper() and not c.istitle() or c.isupper() for c in text[r.doc_id] or "")
        x = {"n_words": n, "mean_word": chars / max(n, 1), "symbol_ratio": symbols / max(chars, 1), "dup_line_ratio": dup / max(len(lines), 1),
             "repeat_ratio": rep / max(n, 1), "distinct_ratio": len(set(words)) / max(n, 1), "upper_ratio": upper / max(chars, 1)}
        fires = any(all(x[a] <= t if op == "<=" else x[a] > t for a, op, t in rule) for rule in rules)
        failed = n < 20 or 100 * rep > 30 * n
        assert (r.base_failed, r.kept) == (failed, not failed and not fires)
