"""Rows that repeat, share an id with other texts or have none: each is decided by its own content."""

import re
from collections import Counter

import brute
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, jaccard_join, language_id, packing, pii, piece_codec, quality_pu, quality_rules, substring_dedup, toxicity
from ledgerloom.llm.common import salted_join
from test_exact_results import PIECES, WORD_BPE


def numbered(rows):
    """rows under numbers of their own, and the way back."""
    return [(k, t) for k, (_, t, _) in enumerate(rows)]


def no_id_last(doc):
    return (doc is None, doc or 0)


def test_one_row_of_each_content_stays(repeated, repeated_rows):
    groups = {}
    for d, t, _ in repeated_rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), no_id_last(d), t or ""))
    want = Counter((min(g)[1], min(g)[0]) for g in groups.values())
    kept = exact_dedup.keep_first_copies(repeated)
    assert kept.columns == repeated.columns
    assert Counter((no_id_last(r.doc_id), -len(r.text or "")) for r in kept.collect()) == want
    assert exact_dedup.keep_first_copies(repeated.where("false")).count() == 0


def test_exact_classes_count_repeated_rows(repeated, repeated_rows):
    sizes = Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in repeated_rows)
    got = exact_dedup.exact_dedup(repeated).collect()
    assert len(got) == len(repeated_rows)
    assert Counter(r.group_size for r in got) == Counter(n for n in sizes.values() for _ in range(n))


def test_one_row_of_each_class_stays(repeated, repeated_rows):
    near = brute.near(numbered(repeated_rows))
    groups = {}
    for k, (d, t, _) in enumerate(repeated_rows):
        alone = len(brute.WORD.findall(t or "")) < 5
        groups.setdefault(("", d, t) if alone else near[k][0], []).append((no_id_last(d), t))
    kept = jaccard_join.keep_one_of_each_class(repeated)
    assert kept.columns == repeated.columns
    rows = [(no_id_last(r.doc_id), r.text) for r in kept.collect()]
    assert Counter(d for d, _ in rows) == Counter(min(d for d, _ in g) for g in groups.values())
    assert all(any(r in g for g in groups.values()) for r in rows)


def test_links_count_repeated_rows(repeated, repeated_rows):
    near = brute.near(numbered(repeated_rows))
    want = Counter((no_id_last(d), near[k][1]) for k, (d, _, _) in enumerate(repeated_rows))
    got = jaccard_join.jaccard_join(repeated).collect()
    assert Counter((no_id_last(r.doc_id), r.n_links) for r in got) == want


def test_repeats_of_rows_are_long_repeats(repeated, repeated_rows):
    want = brute.long_repeats(numbered(repeated_rows))
    got = substring_dedup.drop_long_repeats(repeated).collect()
    assert Counter((no_id_last(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((no_id_last(d), *want[k]) for k, (d, _, _) in enumerate(repeated_rows))


def test_other_operators_pass_rows_through(repeated, repeated_rows, labels):
    ids = Counter(d for d, _, _ in repeated_rows)
    text_and_id = Counter((d, t) for d, t, _ in repeated_rows)
    of = lambda df: Counter(r.doc_id for r in df.collect())
    assert of(language_id.language_id(repeated)) == of(quality_pu.quality_scores(repeated, labels)) == ids
    assert of(quality_rules.quality_rules(repeated, labels)) == of(toxicity.toxicity_scores(repeated, labels)) == ids
    assert of(piece_codec.encode_documents(repeated, PIECES)) == of(pii.find_personal_data(repeated)) == ids
    assert Counter((r.doc_id, r.text) for r in pii.redact(repeated).collect()) == text_and_id
    model = language_id.train(repeated)
    assert of(language_id.keep_recognised(repeated, model)) == Counter(d for d, t, _ in repeated_rows if t)
    tokens = Counter()
    for r in packing.pack_documents(repeated, WORD_BPE).collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(ids) and tokens[8] == 2


def test_equal_rows_of_one_key_are_dealt_over_tasks(spark, tmp_path):
    """10,000 equal rows of one key, a third of all: no task of the join gets more than a few of them."""
    hot = spark.range(0, 10_000, 1, 8).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'hot' AS k")
    cold = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", "CAST(id AS STRING) AS k")
    hot.unionByName(cold).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, ("-1", "64", "false"), strict=True):
            spark.conf.set(c, v)
        joined = salted_join(rows, groups, "k", "n").withColumn("p", F.spark_partition_id())
        assert joined.count() == 30_000 and joined.where("k = 'hot'").where("n = 10000").count() == 10_000
        tasks = [r["count"] for r in joined.where("k = 'hot'").groupBy("p").count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(tasks) > 40 and max(tasks) < 1000
