"""The corpus pipeline against its stages by brute force, and what it keeps."""

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import language_id
from ledgerloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, sf_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = written(corpus_pipeline.STAGES[0][1](spark, docs, SF))
    lang = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    rows = [(d, t) for d, t in sf_rows if lang[d] != "und"]
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows}
    exact = brute.exact(rows)
    rows = [(d, t) for d, t in rows if exact[d][2]]
    kept = written(corpus_pipeline.STAGES[1][1](spark, kept, SF))
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows}
    near = brute.near(rows)
    rows = [(d, t) for d, t in rows if near[d][0] == d]
    kept = written(corpus_pipeline.STAGES[2][1](spark, kept, SF))
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows}
    clean = {}
    for d, t in rows:
        out, at = "", 0
        for a, k, b in brute.base_spans(t):
            if a >= at:
                out += t[at:a] + f"[{brute.KINDS[k].upper()}]"
                at = b
        clean[d] = out + t[at:]
    kept = written(corpus_pipeline.STAGES[3][1](spark, kept, SF))
    assert kept.columns == columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got.keys() == clean.keys() and all(got[d] == clean[d] for d in got)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in clean.items()}
    total = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want
