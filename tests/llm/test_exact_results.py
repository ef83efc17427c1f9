"""Operators whose results are fixed: against brute force on the smallest table and on awkward rows."""

import hashlib
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import exact_dedup, jaccard_join, packing, pii, piece_codec, quality_rules, substring_dedup
from ledgerloom.llm.common import word_hashes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    return [(d, t) for d, t, *_ in rows if d is not None]


def test_exact_dedup(docs, sf_rows):
    want = brute.exact(sf_rows)
    for r in exact_dedup.exact_dedup(docs).collect():
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == want[r.doc_id]


def test_exact_dedup_edges(edge, empty, edge_rows):
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(edge).collect()}
    assert rows[4].keep_id == rows[5].keep_id == 6 and rows[6].kept  # null, empty, blank: the longest stays
    assert rows[1].keep_id == rows[2].keep_id == 1 and rows[1].group_size == 3 and not rows[None].kept
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in rows.items() if r.kept)


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 40)), max_size=60), st.integers(1, 400))
@settings(max_examples=60, deadline=None)
def test_grace_spills_and_agrees(items, memory):
    rows = []
    for doc, (k, n) in enumerate(items):
        body = b"%d" % k * (k + 1)
        rows.append((hashlib.sha256(body).digest(), body, 1, n, doc))
    got = {e[0]: (e[2], e[3], e[4]) for e in exact_dedup.grace(iter(rows), memory, 2)}
    want = {}
    for d, _, _, n, doc in rows:
        c, m, best = want.get(d, (0, -1, None))
        want[d] = (c + 1, n, doc) if n > m else (c + 1, m, best)
    assert got == want


def test_packing(docs, sf_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in sf_rows:
        ids, at = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_edges(edge, empty):
    rows = packing.pack_documents(edge, WORD_BPE).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in edge.select("doc_id").collect()}
    assert [r.doc_tokens for r in rows if r.doc_id in (4, 5, 6)] == [1, 1, 1]
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


@given(st.lists(st.integers(0, 300), max_size=80))
@settings(max_examples=100, deadline=None)
def test_pack_keeps_every_token_and_wastes_less_than_one_sequence(lengths):
    pieces = packing.pack(lengths, 64)
    covered = {}
    used = {}
    for doc, start, n, seq, offset in pieces:
        assert n > 0
        covered.setdefault(doc, []).append((start, n))
        used.setdefault(seq, []).append((offset, n))
    assert all(sum(n for _, n in v) == lengths[d] for d, v in covered.items())
    assert sum(lengths) == sum(n for v in covered.values() for _, n in v)
    for v in used.values():
        v.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= 64
    assert len(used) * 64 - sum(lengths) < 64 or not lengths


@given(st.lists(st.sampled_from(["'", "s", "re", "S", "é", "É", "ß", "İ", "Σ", "é", "1", "²", "!", "<|endoftext|>", "<", "|", "日", "\xa0", "a", " ", "\x1c", "ª"]), max_size=20))
@settings(max_examples=300, deadline=None)
def test_word_cache_equals_the_tokenizer(parts):
    text = "".join(parts)
    w = packing.tokenizer(WORD_BPE)
    assert next(iter(w.encode([text]))) == np.array(w.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_base_statistics(docs, sf_rows, labels, edge, edge_rows, empty):
    for df, rows in ((docs, sf_rows), (edge, [(d, t) for d, t, _ in edge_rows])):
        text = dict(rows)
        for r in quality_rules.statistics(df, "doc_id").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_statistics(text[r.doc_id])
    assert quality_rules.quality_rules(empty, labels).count() == 0
    got = {r.doc_id: r for r in quality_rules.quality_rules(edge, labels).collect()}
    assert got[4].base_failed and not got[4].kept and got[12].base_failed


def test_substring_dedup(docs, sf_rows):
    want = brute.long_repeats(sf_rows)
    for r in substring_dedup.drop_long_repeats(docs).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_substring_dedup_edges(edge, edge_rows, empty):
    want = brute.long_repeats([(d, t) for d, t, _ in edge_rows])
    for r in substring_dedup.drop_long_repeats(edge).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert substring_dedup.drop_long_repeats(empty).count() == 0


def test_substring_dedup_of_periodic_and_shifted_text(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for k in range(40):
        words = [rnd.choice("ab") for _ in range(rnd.randint(0, 120))] if k % 2 else ([*"abcd"[: 1 + k % 4]] * 60)[: rnd.randint(20, 140)]
        cut = rnd.randint(0, len(words))
        rows.append((k, " ".join(words[:cut] + [f"u{k}"] * (k % 3) + words[cut:])))
    common = " ".join(f"c{i}" for i in range(50))
    rows += [(100 + k, " ".join(f"r{k}_{i}" for i in range(k * 3)) + " " + common + f" end{k}") for k in range(6)]
    want = brute.long_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in substring_dedup.drop_long_repeats(df).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r


def test_substring_dedup_of_words_that_weak_hashes_confuse(spark):
    """Words, and passages of words, built by the Thue-Morse rule: sums of powers modulo 2**64 give them one value."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    shared = " ".join(f"s{i}" for i in range(34))
    rows = [(1, f"{shared} {one}"), (2, f"{shared} {other}"), (3, " ".join("xy"[b] for b in bits[:1024])), (4, " ".join("yx"[b] for b in bits[:1024]))]
    want = brute.long_repeats(rows)
    assert want[1][1] == want[2][1] == 0
    for r in substring_dedup.drop_long_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_jaccard_join(docs, sf_rows):
    want = brute.near(sf_rows)
    for r in jaccard_join.jaccard_join(docs).collect():
        assert (r.class_id, r.n_links) == want[r.doc_id]


def test_jaccard_join_edges(edge, edge_rows, empty):
    want = brute.near([(d if d is not None else 1_000_000, t) for d, t, _ in edge_rows])
    for r in jaccard_join.jaccard_join(edge).collect():
        assert (r.class_id, r.n_links) == want[r.doc_id if r.doc_id is not None else 1_000_000]
    assert jaccard_join.jaccard_join(empty).count() == 0
    kept = jaccard_join.keep_one_of_each_class(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {d for d, (c, _) in want.items() if c == d}


def test_jaccard_join_splits_hot_groups(spark):
    """One large group of near copies, in blocks smaller than the group."""
    import random

    rnd = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        w = list(words)
        w[rnd.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"q{k}_{i}" for i in range(60))) for k in range(20)]
    want = brute.near(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in jaccard_join.jaccard_join(df, small=8, block=16).collect():
        assert (r.class_id, r.n_links) == want[r.doc_id]


def spans_of(text):
    return brute.rendered(brute.base_spans(text))


def test_personal_data(docs, sf_rows, edge, edge_rows, empty):
    for df, rows in ((docs, sf_rows), (edge, [(d, t) for d, t, _ in edge_rows])):
        text = dict(rows)
        got = pii.find_personal_data(df).collect()
        assert len(got) == len(rows)
        for r in got:
            base = brute.base_spans(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(brute.rendered(base).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
            assert set(filter(None, brute.rendered(base).split(","))) <= set(r.spans.split(","))
    assert pii.find_personal_data(empty).count() == 0


AWKWARD = ["a@b.c_d@e.f x@y", "1.2.3.4.5 256.1.1.1 01.002.3.4", "4111-1111-1111-1111 4111  1111 1111 1111", "++44 20 7946 0958+1 (202) 555-0123", "no", "5500 0000 0000 0004,378282246310005", "\x01\x02a@b.co", "1 " * 40, "é a.b+c@d-e.org."]


def test_personal_data_of_awkward_texts(spark):
    rows = list(enumerate(AWKWARD))
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.spans == spans_of(AWKWARD[r.doc_id]), AWKWARD[r.doc_id]


def test_contexts_discover_identifiers(spark):
    rows = [(k, f"some words {k} please contact agent jo{k}@mail.example.com soon") for k in range(30)]
    rows += [(100 + k, f"other words {k} please contact agent jo{k}[at]mail{k}12345.example soon") for k in range(2)]
    rows += [(200 + k, f"order number {k}12345678 was shipped") for k in range(30)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k].startswith("email:") for k in range(2)) and all(got[200 + k] == "" for k in range(30))


def test_redaction(edge, edge_rows):
    text = {d: t for d, t, _ in edge_rows}
    out = pii.redact(edge)
    assert out.columns == edge.columns
    for r in out.collect():
        if r.doc_id == 14:
            assert "[EMAIL]" in r.text and "[CARD]" in r.text and "@" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == text[r.doc_id]


def test_piece_codec(spark, docs, sf_rows, edge, edge_rows, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    normal = {m.id_to_piece(i): (m.get_score(i), i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    byte_ids = [m.piece_to_id(f"<0x{c:02X}>") for c in range(256)]
    v = piece_codec.Vocabulary.load(PIECES)
    e = piece_codec.Encoder(v)
    for text in [t for _, t in sf_rows[:15]] + ["  a  b\nc \t日本語𝒳ñ▁x", "\n\n", "🙂 ok 梦", "x" * 300]:
        ids = np.frombuffer(e.encode([text])[0], "<u4")
        assert ids.tolist() == brute.viterbi("▁" + text.replace(" ", "▁"), normal, v.unknown, byte_ids)
        assert v.decode(ids) == m.decode(ids.tolist()) == text.replace("▁", " ")
    assert all(r.round_trip for r in piece_codec.encode_documents(docs, PIECES).collect())
    got = {r.doc_id: r for r in piece_codec.encode_documents(edge, PIECES, with_ids=True).collect()}
    assert got[4].n_pieces == got[5].n_pieces == 0 and all(r.round_trip for r in got.values())
    assert piece_codec.encode_documents(empty, PIECES).count() == 0


def test_words_are_cut_at_the_same_places():
    texts = ["a  b\tc\x0bd\x1ce", "", " \n", " x y", "z"]
    h, first, starts, ends, raw = word_hashes(texts)
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == words and len(set(h.tolist())) == len(set(words))
    assert np.diff(first).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_words_built_to_collide_as_sums_have_different_hashes():
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048):
        h = word_hashes([f"x {a[:n]}", f"x {b[:n]} {a[:n]}"])[0]
        assert h[1] != h[3] and h[1] == h[4] and h[0] == h[2]
