"""SimHash trie join, prefix trie and fill-in-middle, each against plain Python from its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from brute import WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import fill_in_middle as fim
from ledgerloom.llm import prefix_trie, registry
from ledgerloom.llm import simhash_trie as sim

# ---- fingerprints and their components


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_pairs(values, errors=4):
    """{value: the least value linked with it, over links of at most `errors` bits}."""
    u = np.array(sorted(set(values)), np.uint64)
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= errors) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(x): int(u[find(i)]) for i, x in enumerate(u)}


def plain_components(rows):
    """[(doc_id, text)] -> Counter of (doc_id, fingerprint, component_id)."""
    prints = [plain_fingerprint(t) for _, t in rows]
    of = all_pairs(prints)
    least = {}
    for (d, _), x in zip(rows, prints, strict=True):
        if d is not None:
            least[of[x]] = min(d, least.get(of[x], d))
    return Counter((d, f"{x:016x}", least.get(of[x])) for (d, _), x in zip(rows, prints, strict=True))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_documents(docs, sf_rows):
    assert Counter(map(tuple, sim.simhash_near_duplicates(docs).collect())) == plain_components(sf_rows)


def test_components_of_awkward_rows(edge, edge_rows, repeated, repeated_rows, empty):
    for frame, rows in ((edge, edge_rows), (repeated, repeated_rows)):
        got = sim.simhash_near_duplicates(frame)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert Counter(map(tuple, got.collect())) == plain_components([r[:2] for r in rows])
    assert sim.simhash_near_duplicates(empty).count() == 0


def test_many_equal_rows_are_one_leaf(spark):
    """10,000 equal rows without an id: their join with components is dealt over tasks, and none is lost."""
    rows = spark.range(0, 10_000, 1, 20).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one two three four five' AS text")
    rows = rows.unionByName(spark.createDataFrame([(5, "one two three four five"), (6, None)], "doc_id long, text string"))
    got = Counter((r.doc_id, r.component_id) for r in sim.simhash_near_duplicates(rows).collect())
    assert got == Counter({(None, 5): 10_000, (5, 5): 1, (6, 6): 1})


@pytest.mark.parametrize("bound", [100_000, 40])
def test_links_of_dense_and_far_fingerprints(spark, bound):
    """Cells that are split and cells that aren't connect what all pairs connect, within a ball of 10 bits too."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(200)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for x in base for _ in range(3)]
    ball = [base[0] ^ rng.getrandbits(10) << 31 for _ in range(300)]
    values = sorted({*base, *near, *ball, 0, 1, (1 << 64) - 1, (1 << 64) - 16})
    found = sim.links(spark.createDataFrame([(signed(x),) for x in values], "fp long"), 4, bound).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    want, root = all_pairs(values), {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        p, q = (find(x & (1 << 64) - 1) for x in (r.a, r.b))
        root[max(p, q)] = min(p, q)
    assert {x: find(x) for x in values} == want


@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=4))
@settings(max_examples=300, deadline=None)
def test_some_block_order_keeps_a_pair_within_its_budgets(x, flips):
    tries = sim.Tries(4)
    y = x
    for b in flips:
        y ^= 1 << b
    ok = []
    for r in range(tries.blocks):
        p, q = (int(tries.turned(np.array([v], np.uint64), r)[0]) for v in (x, y))
        ok.append(all((p >> 64 - d ^ q >> 64 - d).bit_count() <= tries.budget[r][d] for d in range(1, 65)))
    assert any(ok)


@given(st.lists(st.sampled_from(["a", "Bb", "ccc", "É", "\x0b", "\n", "  ", "x" * 90]), max_size=60), st.integers(1, 50))
@settings(max_examples=200, deadline=None)
def test_a_text_read_in_pieces_has_the_same_fingerprint(parts, size):
    text = " ".join(parts)
    assert sim.fingerprint(text.encode(), 4, size) == plain_fingerprint(text)


# ---- the trie of conversation prefixes


def plain_trie(rows):
    """{(conv_id, turn, role, text)} -> Counter of nodes, from the members of every prefix."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if built[c] == p)
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()
    )


def awkward_conversations():
    rng = random.Random(5)
    rows = []
    for c in (*range(-30, 260), 10**12, 10**12 + 1):
        for t in range(60 if c % 97 == 0 else rng.randint(1, 6)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["u", "a", None]), rng.choice(["x", "yé\U0001f642", None, ""])))
    rows += [(None, 1, "u", "x")] * 3 + rows[:40]
    return rows


@pytest.mark.parametrize("turns", [40, 400, 500_000])
def test_trie_of_awkward_conversations(spark, turns):
    """Shared prefixes, copies, negative ids, ties, repeated rows, no ids, deep ones: whatever the ranges' size."""
    rows = awkward_conversations()
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'?' AS path", "'?' AS kind", "'?' AS turns").repartition(5)
    assert Counter(map(tuple, prefix_trie.prefix_trie(made, turns).collect())) == plain_trie(rows)


def test_trie_of_the_tables(spark):
    convs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    want = plain_trie(rows)
    assert Counter(map(tuple, prefix_trie.prefix_trie(convs).collect())) == want
    duckdb.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert Counter(duckdb.sql(registry.ORACLE_SQL["op12_prefix_trie"]).fetchall()) == want
    assert prefix_trie.prefix_trie(convs.where("false")).count() == 0


def test_one_first_turn_for_all_and_a_very_deep_conversation(spark):
    """A prefix that all conversations share is split over ranges; 300 turns take no more rounds than three."""
    rows = [(c, t, "u", "hello" if t == 0 else f"{c % 50} {t}") for c in range(100, 900) for t in range(3)] + [(7, t, "a", str(t)) for t in range(300)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert Counter(map(tuple, prefix_trie.prefix_trie(made, 300).collect())) == plain_trie(rows)


# ---- fill-in-middle


def plain_cut(doc, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, counts = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, counts = "spm", f"<S>{s}<P>{p}<M>{m}", (lo, hi - lo)
    else:
        form, out, counts = "psm", f"<P>{p}<S>{s}<M>{m}", (lo, hi - lo)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc, n, form, *counts, sha(out), sha(text)


def test_cuts_of_documents_and_awkward_rows(docs, sf_rows, edge, edge_rows, repeated, repeated_rows, empty):
    for frame, rows in ((docs, sf_rows), (edge, edge_rows), (repeated, repeated_rows)):
        assert Counter(map(tuple, fim.digests(fim.fill_in_middle(frame)).collect())) == Counter(plain_cut(*r[:2]) for r in rows)
    assert fim.fill_in_middle(empty).count() == 0


def test_marks_and_their_beginnings_in_texts(spark):
    texts = ["<P>", "a<S>b", "<M>" * 3, "<<P", "<S<S<", "<M", "x<", "<" * 50, "<P >", "é<\U0001f642>"]
    rows = [(k, t) for k in range(40) for t in texts]
    made = fim.digests(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter(map(tuple, made.collect())) == Counter(plain_cut(*r) for r in rows)


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units(spark, docs, unit):
    """Cuts by words fall before a word, cuts by lines behind a line feed, and the text comes back."""
    made = fim.fill_in_middle(docs, fim.Plan(unit=unit, plain_percent=0, seed=3))
    rows = made.withColumn("back", fim.restored(made["output"], made["form"])).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        text = r.text or ""
        assert r.back == text
        starts = [m.start() for m in WORD.finditer(text)] if unit == "word" else [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
        assert r.n == (len(starts) if unit == "word" else text.count("\n"))
        if r.form == "plain":
            continue
        for units, at in ((r.prefix_units, r.prefix_chars), (r.prefix_units + r.middle_units, r.prefix_chars + r.middle_chars)):
            assert at == (0 if units == 0 else starts[units] if units < len(starts) else len(text))


@given(st.lists(st.integers(0, 7), max_size=300), st.sets(st.integers(0, 7), min_size=1), st.data())
@settings(max_examples=200, deadline=None)
def test_ranks_and_selects(codes, wanted, data):
    matrix = fim.WaveletMatrix(np.array(codes, np.uint8))
    lo = data.draw(st.integers(0, len(codes)))
    hi = data.draw(st.integers(lo, len(codes)))
    places = [k for k in range(lo, hi) if codes[k] in wanted]
    one = lambda x: np.array([x])
    assert matrix.rank(tuple(wanted), one(lo), one(hi))[0] == len(places)
    for k in (0, len(places) // 2, len(places)):
        assert matrix.select(tuple(wanted), one(lo), one(hi), one(k))[0] == (places[k] if k < len(places) else hi)


def test_sql_of_cuts(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert Counter(map(tuple, fim.digests(fim.fill_in_middle(docs)).collect())) == Counter(duckdb.sql(registry.ORACLE_SQL["op13_fill_in_middle"]).fetchall())
