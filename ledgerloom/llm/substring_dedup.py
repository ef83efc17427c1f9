"""Long repeated passages by recompression.

First all documents are sieved: hashes stand for names, and where an anchor of a stretch of words occurs only once
the stretch can't repeat. What is left is cut into blocks where the words say so; equal blocks become one, so that
near copies are read once but for the blocks that differ. Then Spark names globally, in rounds: each
distinct word, each distinct run of one symbol, each distinct pair of symbols gets one name, so equal passages get
equal interior symbols everywhere. A boundary between symbols that survives the rounds depends on a few words to
either side. Every window of words takes as anchor, among the boundaries whose dependence lies inside the window,
one of the highest level, the least by its two symbols; equal windows therefore share the anchor and their place
relative to it. Stretches of windows with one anchor are verified by their words: equal ones are repeats; where
they differ under one anchor, single windows are compared, once for each distinct stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, powers, salted_join, text_slices, word_hashes, written

_BASE = 0xF1357AEA2E62A9C5
_INVERSE = pow(_BASE, -1, 1 << 64)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_LEVEL_BITS = 57  # names of level k are numbers from k << 57 on


def _stays(r: int, names: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which of the len(names) + 1 boundaries are left after round r: round 0 closes runs, later ones pairs.

    Whether two neighbours pair depends on their names only; a text's edge always stays.
    """
    if r == 0:
        gone = names[:-1] == names[1:]
    else:
        side = (mix(names ^ np.uint64(r)) & np.uint64(1)).astype(bool)
        gone = ~side[:-1] & side[1:]
    return np.append(np.insert(~(gone & ~edge[1:-1]), 0, True), True)


def _hashed(r: int, names: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Names after round r by hashes of what they stand for."""
    start = np.flatnonzero(stay)
    size = np.diff(start).astype(np.uint64)
    start = start[:-1]
    second = size if r == 0 else names[np.minimum(start + 1, len(names) - 1)]
    return np.where(size > 1, mix(names[start] * _A ^ second * _B), names[start])


def _edges(n: int, first: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    return edge


def _levels(h: np.ndarray, first: np.ndarray, rounds: int, later: list[np.ndarray] | None) -> list[tuple[np.ndarray, ...]]:
    """For each level the boundaries (at, low, high, name): word positions, the words [low, high) they depend on, names.

    Level 0 has every word's start. `first` holds each text's first word, with the end; texts never merge. `later`
    holds the names after each round; without it they are hashes.
    """
    n = len(h)
    at = np.arange(n + 1, dtype=np.int64)
    low, high, edge = at.copy(), at.copy(), _edges(n, first)
    names = h.copy()
    out = [(at[:-1], low[:-1], high[:-1] + 1, mix(h ^ _B))]
    for r in range(rounds):
        stay = _stays(r, names, edge)
        name = np.zeros(len(at), np.uint64)
        name[1:-1] = mix(names[:-1] * _A + names[1:] * _B + np.uint64(r + 1))
        new_low, new_high = np.append(-1, low[:-1]), np.append(high[1:], n + 1)
        new_low[edge], new_high[edge] = at[edge] - 1, at[edge] + 1  # a text's edge is outside all of its windows
        names = later[r] if later else _hashed(r, names, stay)
        at, low, high, edge = at[stay], new_low[stay], new_high[stay], edge[stay]
        inner = ~edge
        out.append((at[inner], low[inner], high[inner], name[stay][inner]))
    return out


def _least(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range lo..hi (inclusive, not empty) the place of the least name; the first of equals."""
    tables = [np.arange(len(name))]
    width = 1
    longest = int((hi - lo).max()) + 1 if len(lo) else 1
    while 2 * width <= longest:
        t = tables[-1]
        a, b = t[: len(t) - width], t[width:]
        tables.append(np.where(name[b] < name[a], b, a))
        width *= 2
    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for level, t in enumerate(tables):
        mine = np.flatnonzero(k == level)
        a, b = t[lo[mine]], t[hi[mine] - (1 << level) + 1]
        out[mine] = np.where(name[b] < name[a], b, a)
    return out


class Parsed:
    """The stretches of windows of some texts, given by word names: text, s0, count, key, and their windows' words."""

    def __init__(self, names: np.ndarray, first: np.ndarray, size: int, rounds: int, later: list[np.ndarray] | None = None) -> None:
        self.names, self.first, self.size, n = names, first, size, len(names)
        self.back = powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * powers(_BASE, n + 1)[:n], out=self.sums[1:])
        count = np.maximum(np.diff(first) - size + 1, 0)
        start = np.repeat(first[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        anchor, key = np.zeros(len(start), np.int64), np.zeros(len(start), np.uint64)
        open_ = np.arange(len(start))
        levels = _levels(names, first, rounds, later) if len(start) else []
        for level in range(rounds, -1, -1):
            if not len(open_):
                break
            at, low, high, name = levels[level]
            if not len(at):
                continue
            s = start[open_]
            lo, hi = np.searchsorted(low, s, "left"), np.searchsorted(high, s + size, "right") - 1
            some = hi >= lo
            got = _least(name, lo[some], hi[some])
            anchor[open_[some]] = at[got]
            own = at[got] - low[got]
            key[open_[some]] = mix(self._sums(low[got], high[got]) * _A + (own * 64 + level).astype(np.uint64))
            open_ = open_[~some]
        cut = np.ones(len(start), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(cut)
        self.s0 = start[begin]
        self.count = np.diff(np.append(begin, len(start)))
        self.key = key[begin]
        self.text = np.searchsorted(first, self.s0, "right") - 1

    def _sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words [a, b) that don't depend on where they stand. They bring like to like and prove nothing."""
        return mix((self.sums[b] - self.sums[a]) * self.back[a])

    def digests(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """For each range [a, b) of words the 128-bit BLAKE2b digest of their names."""
        raw = memoryview(self.names.astype("<u8").tobytes())
        return [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _ints(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind)


# --- the sieve: over whole documents


def _anchors(size: int, rounds: int):
    """(doc_id, th, text) -> (doc_id, th, key, n): each anchor of a document once, with the number of its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                h, first, _, _, _ = word_hashes(texts)
                p = Parsed(h, first, size, rounds)
                order = np.lexsort((p.key, p.text))
                text, key = p.text[order], p.key[order]
                new = np.ones(len(key), bool)
                new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                rows = pa.array(start + text[at])
                n = np.diff(np.append(at, len(key)))
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), _ints(key[at], pa.int64()), _ints(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "key", "n"])

    return run


_BLOCK_WORDS = 96


def _cuts(p: Parsed, a: int, b: int) -> list[int]:
    """Where the blocks of the words [a, b) begin: about every _BLOCK_WORDS words, where the words that follow say so.

    A block reaches size - 1 words into the next one: each window lies in the block in which it starts, and only there.
    """
    if b - a < 2 * p.size:
        return [a]
    at = np.arange(a + 1, b - p.size + 1)
    said = at[p._sums(at, at + 8) % np.uint64(_BLOCK_WORDS) == 0].tolist()
    out = [a]
    for x in said:
        if x - out[-1] >= _BLOCK_WORDS // 2:
            out.append(x)
    return out


def _segments(size: int, rounds: int):
    """(doc_id, th, text, keys) -> (doc_id, th, a, name, body): blocks of words that stretches with one of the keys cover.

    name is the SHA-256 digest of body, the words joined by one blank.
    """
    names = ["doc_id", "th", "a", "name", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                wanted = batch.column(3).slice(start, len(texts))
                h, first, begin, end, raw = word_hashes(texts)
                p = Parsed(h, first, size, rounds)
                own = np.repeat(np.arange(len(texts)), np.diff(wanted.offsets.to_numpy()))
                shared = np.stack([own.astype(np.uint64), wanted.flatten().to_numpy().view(np.uint64)], 1)
                mine = np.stack([p.text.astype(np.uint64), p.key], 1)
                pick = np.flatnonzero(np.isin(_pairs(mine), _pairs(shared)))
                a, b, text = p.s0[pick], (p.s0 + p.count + size - 1)[pick], p.text[pick]
                cut = np.ones(len(pick), bool)
                cut[1:] = (text[1:] != text[:-1]) | (a[1:] > b[:-1])
                at = np.flatnonzero(cut)
                last = np.append(at[1:], len(pick)) - 1 if len(at) else at
                rows, place, bodies = [], [], []
                for k, x, y in zip(text[at].tolist(), a[at].tolist(), b[last].tolist(), strict=True):
                    heads = _cuts(p, x, y)
                    for u, v in zip(heads, [*(c + size - 1 for c in heads[1:]), y], strict=True):
                        rows.append(start + k)
                        place.append(u - int(first[k]))
                        bodies.append(b" ".join(raw[begin[u] : end[v - 1]].split()))
                digests = pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary())
                rows = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place, pa.int32()), digests, pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _pairs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view([("x", np.uint64), ("y", np.uint64)]).ravel()


def candidates(rows: DataFrame, size: int, rounds: int) -> DataFrame:
    """doc_id, th, a, name, body: the segments of rows(doc_id, th, text) that may hold repeats; nothing else does."""
    keys = written(rows.mapInArrow(_anchors(size, rounds), "doc_id long, th long, key long, n int"))
    shared = keys.groupBy("key").agg(F.sum("n").alias("_m"), F.count("*").alias("_n")).where("_m > 1").select("key", "_n")
    hits = salted_join(keys.drop("n"), shared, "key", "_n").groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys"))
    hits = hits.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    some = rows.join(hits, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "th", "text", "keys")
    found = written(some.mapInArrow(_segments(size, rounds), "doc_id long, th long, a int, name binary, body binary"))
    discard(keys)
    return found


# --- rounds of global naming: over chunks of distinct segments


def _chunks(most_bytes: int):
    """(seg, copies, body) -> (chunk, segs, copies, bodies), about most_bytes of text in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def sent() -> pa.RecordBatch:
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
            columns = [pa.array([number], pa.int64()), *(pa.array([[x[k] for x in held]], kind) for k, kind in enumerate(kinds))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "segs", "copies", "bodies"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= most_bytes:
                    yield sent()
                    number, held, size = number + 1, [], 0
        if held:
            yield sent()

    return run


def _words_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a chunk: (chunk, k, x), k its place among them in order."""
    for batch in batches:
        for chunk, bodies in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = sorted(set(b" ".join(bodies).split()))
            columns = [pa.array([chunk] * len(words), pa.int64()), pa.array(range(len(words)), pa.int32()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "k", "x"])


_STATE = "chunk long, segs array<long>, copies array<long>, first array<long>, names array<binary>"


def _state(columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
    made = [pa.array([x], kind) for x, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=["chunk", "segs", "copies", "first", "names"])


def _words_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, segs, copies, bodies, reply) -> state: first words of segments, with the end, and the words' names."""
    for batch in batches:
        for chunk, segs, copies, bodies, reply in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split = [b.split() for b in bodies]
            number = dict(zip(sorted(set().union(*split)), np.frombuffer(reply, "<i8").tolist(), strict=True))
            first = np.cumsum([0, *map(len, split)]).tolist()
            names = np.array([number[w] for words in split for w in words], "<u8")
            yield _state([chunk, segs, copies, first, [names.tobytes()]])


def _blocks(names: list[np.ndarray], first: np.ndarray, r: int) -> tuple[np.ndarray, ...]:
    """What round r closes in a chunk: (stay, closed, x, y, inverse).

    closed: which symbols of the next level are new; (x, y): the distinct runs (name, length) or pairs (two names)
    in order; inverse: for each closed one its place among them.
    """
    edge = _edges(len(names[0]), first)
    for k in range(r):
        edge = edge[_stays(k, names[k], edge)]
    stay = _stays(r, names[r], edge)
    start = np.flatnonzero(stay)
    size = np.diff(start)
    closed = size > 1
    at = start[:-1][closed]
    x, y = names[r][at], size[closed].astype(np.uint64) if r == 0 else names[r][at + 1]
    order = np.lexsort((y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return stay, closed, x[order][new], y[order][new], inverse


def _arrays(names: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in names]


def _blocks_asked(r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, _, first, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, x, y, _ = _blocks(_arrays(names), np.array(first), r)
                columns = [pa.array(np.full(len(x), chunk)), pa.array(np.arange(len(x)), pa.int32()), _ints(x, pa.int64()), _ints(y, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "k", "x", "y"])

    return run


def _blocks_named(r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, segs, copies, first, names, reply in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = _arrays(names)
                stay, closed, _, _, inverse = _blocks(arrays, np.array(first), r)
                fresh = arrays[r][stay[:-1]].copy()
                fresh[closed] = np.frombuffer(reply or b"", "<u8")[inverse]
                yield _state([chunk, segs, copies, first, [*names, fresh.tobytes()]])

    return run


def _numbered(level: int):
    """Rows (chunk, k, x...) in order of x... -> (chunk, k, name): equal values, which follow each other, have one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, before = (level << _LEVEL_BITS) + (TaskContext.get().partitionId() << 33), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for column in batch.columns[2:]:
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            values = [c[0].as_py() for c in batch.columns[2:]]
            new[0] = before is not None and values != before
            names = name + np.cumsum(new)
            name, before = int(names[-1]), [c[-1].as_py() for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], names=["chunk", "k", "name"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, k, name) in this order -> (chunk, reply): the names of each chunk as little-endian 64-bit numbers."""
    now, parts = None, []

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["chunk", "reply"])

    for batch in batches:
        chunk, names = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        at = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
        for i, j in zip(at, [*at[1:], len(chunk)]):
            if now is not None and int(chunk[i]) != now:
                yield sent()
                parts = []
            now = int(chunk[i])
            parts.append(names[i:j].astype("<i8").tobytes())
    if parts:
        yield sent()


def _answers(asked: DataFrame, level: int, *by: str) -> DataFrame:
    """(chunk, reply): to each chunk, in order of k, one name for each distinct value that it asked for.

    Spark brings equal values together and sorts them, so a value's name follows from its task and its place there.
    A chunk asks for a value once: the most frequent one has no more rows than there are chunks.
    """
    names = asked.repartition(*by).sortWithinPartitions(*by).mapInArrow(_numbered(level), "chunk long, k int, name long")
    return names.repartition("chunk").sortWithinPartitions("chunk", "k").mapInArrow(_packed, "chunk long, reply binary")


def named(segments: DataFrame, rounds: int, chunk_bytes: int) -> DataFrame:
    """The state of all chunks of segments(seg, copies, body) after the rounds: chunk, segs, copies, first, names by level."""
    packed = segments.select("seg", "copies", "body").mapInArrow(_chunks(chunk_bytes), "chunk long, segs array<long>, copies array<long>, bodies array<binary>")
    chunks = written(packed)
    replies = _answers(chunks.mapInArrow(_words_asked, "chunk long, k int, x binary"), 0, "x")
    state = written(chunks.join(replies, "chunk").select("chunk", "segs", "copies", "bodies", "reply").mapInArrow(_words_named, _STATE))
    discard(chunks)
    for r in range(rounds):
        replies = _answers(state.mapInArrow(_blocks_asked(r), "chunk long, k int, x long, y long"), r + 1, "x", "y")
        asked = state.join(replies, "chunk", "left").select(*state.columns, "reply")
        before, state = state, written(asked.mapInArrow(_blocks_named(r), _STATE))
        discard(before)
    return state


# --- stretches and windows


def _stretches(size: int, rounds: int):
    """State -> (chunk, seg, copies, s0, n, key, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, segs, copies, first, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = _arrays(names)
                p = Parsed(arrays[0], np.array(first), size, rounds, arrays[1:])
                columns = [
                    pa.array(np.full(len(p.s0), chunk)), _ints(np.array(segs)[p.text], pa.int64()), _ints(np.array(copies)[p.text], pa.int64()),
                    _ints(p.s0 - p.first[p.text], pa.int32()), _ints(p.count, pa.int32()), _ints(p.key, pa.int64()),
                    pa.array(p.digests(p.s0, p.s0 + p.count + size - 1), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "seg", "copies", "s0", "n", "key", "content"])

    return run


def _windows(size: int, rounds: int):
    """State and chosen(seg, s0, copies) -> (window, copies, seg, s): the single windows of chosen stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, segs, _, first, names, chosen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = _arrays(names)
                p = Parsed(arrays[0], np.array(first), size, rounds, arrays[1:])
                seg = np.array(segs)[p.text]
                wanted = {(c["seg"], c["s0"]): c["copies"] for c in chosen}
                copies = np.array([wanted.get(k, 0) for k in zip(seg.tolist(), (p.s0 - p.first[p.text]).tolist(), strict=True)], np.int64)
                pick = np.flatnonzero(copies)
                n = p.count[pick]
                which = np.repeat(pick, n)
                s = p.s0[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                columns = [pa.array(p.digests(s, s + size), pa.binary()), _ints(copies[which], pa.int64()), _ints(seg[which], pa.int64()), _ints(s - p.first[p.text[which]], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "copies", "seg", "s"])

    return run


def repeats_within(state: DataFrame, size: int, rounds: int) -> DataFrame:
    """(seg, a, b): word ranges of the segments that windows occurring twice or more cover."""
    stretches = written(state.mapInArrow(_stretches(size, rounds), "chunk long, seg long, copies long, s0 int, n int, key long, content binary"))
    contents = written(
        stretches.groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.count("*").alias("_n"), F.min(F.struct("chunk", "seg", "s0")).alias("first"))
    )
    equal = salted_join(stretches.select("seg", "s0", "n", "content"), contents.where("copies > 1").select("content", "_n"), "content", "_n")
    whole = equal.select("seg", F.col("s0").alias("a"), (F.col("s0") + F.col("n") + (size - 1)).alias("b"))
    several = contents.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    mixed = salted_join(contents.drop("_n"), several, "key", "_n")
    chosen = mixed.groupBy("first.chunk").agg(F.collect_list(F.struct("first.seg", "first.s0", "copies")).alias("chosen"))
    asked = state.join(chosen, "chunk").select(*state.columns, "chosen")
    single = written(asked.mapInArrow(_windows(size, rounds), "window binary, copies long, seg long, s int"))
    hit = single.groupBy("window").agg(F.sum("copies").alias("_m"), F.count("*").alias("_n")).where("_m > 1").select("window", "_n")
    alone = salted_join(single.where("copies = 1"), hit, "window", "_n")
    return whole.unionByName(alone.select("seg", F.col("s").alias("a"), (F.col("s") + size).alias("b")))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, copies, ranges) with overlapping ranges united."""
    for batch in batches:
        out = []
        for ranges in batch.column(2).to_pylist():
            united: list[dict] = []
            for r in sorted(ranges, key=lambda r: r["a"]):
                if united and r["a"] <= united[-1]["b"]:
                    united[-1]["b"] = max(united[-1]["b"], r["b"])
                else:
                    united.append(dict(r))
            out.append(united)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["name", "copies", "ranges"])


def repeated_ranges(rows: DataFrame, size: int, rounds: int, chunk_bytes: int) -> DataFrame:
    """(doc_id, th, ranges): word ranges of rows(doc_id, th, text) that windows occurring twice or more cover."""
    found = candidates(rows, size, rounds)
    segments = found.groupBy("name", "body").agg(F.count("*").alias("copies"))  # by the words themselves
    segments = written(segments.withColumn("seg", F.monotonically_increasing_id()))
    if not segments.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two segments share a SHA-256 digest")
    places = written(found.select("doc_id", "th", "a", "name"))
    discard(found)
    state = named(segments, rounds, chunk_bytes)
    bodies, segments = segments, written(segments.select("seg", "name", "copies", F.size(F.split(F.col("body").cast("string"), " ")).alias("n_words")))
    discard(bodies)
    inside = repeats_within(state, size, rounds).groupBy("seg").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    everything = F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").alias("b")))
    by_name = segments.join(inside, "seg", "left").select("name", "copies", F.when(F.col("copies") > 1, everything).otherwise(F.col("ranges")).alias("ranges"))
    by_name = by_name.where("ranges IS NOT NULL").mapInArrow(_merged, "name binary, copies long, ranges array<struct<a:int,b:int>>")
    placed = salted_join(places, by_name, "name", "copies")
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("a")).alias("a"), (r["b"] + F.col("a")).alias("b")))
    return placed.select("doc_id", "th", moved.alias("ranges")).groupBy("doc_id", "th").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = batch.column(2).to_pylist()
        totals, removed, digests = [], [], []
        for start, texts in text_slices(batch):
            for i, t in enumerate(texts):
                words = t.encode("utf-8", "surrogatepass").split()
                totals.append(len(words))
                if ranges[start + i]:
                    depth = np.zeros(len(words) + 1, np.int64)
                    for r in ranges[start + i]:
                        depth[r["a"]] += 1
                        depth[r["b"]] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                removed.append(totals[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def drop_long_repeats(docs: DataFrame, size: int = 35, rounds: int = 4, chunk_bytes: int = 1 << 19) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+. A word goes if it lies in a window of `size` words of one document whose words
    occur in the same order anywhere else, in the same document too; what stays is hashed joined by one blank.
    Null or shorter texts have no window. Repeated rows repeat each other, so all their windows go; null
    doc_ids take part; an empty table gives no rows; other columns, whatever their names, are ignored.

    Equal words, runs and pairs have one name, given by grouping their values; whole segments are grouped by their
    words; stretches and windows are equal if the 128-bit BLAKE2b digests of their words' names are.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text")
    )
    ranges = written(repeated_ranges(rows, size, rounds, chunk_bytes)).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    joined = rows.join(ranges, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept_sha256 string")
