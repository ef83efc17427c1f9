"""Unigram encoding and decoding over a vocabulary of pieces with log scores.

Viterbi finds the segmentation of highest total score. Pieces are matched in a double-array trie over
UTF-8 bytes; the distinct words of a batch are searched together in numpy. A character that no piece
covers falls back to its bytes. Pieces mark a preceding blank with U+2581; decoding turns it back.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
_SEGMENT = re.compile(r"\n| *[^ \n]+| +")
_UNKNOWN_PENALTY = 10.0
_ENTRY = 160  # bytes of an entry of a word table beside its key's and value's own
_LONG_RUN = 1024  # bytes of a word that is searched by itself
_UNUSED = -1e8  # scores below mark pieces that are listed but never competitive


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): child of node s by byte c is base[s] + c if check there is s; value is -1 inside keys."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, v in sorted(keys.items()):
        at = 0
        for c in key:
            if c not in tree[at]:
                tree[at][c] = len(tree)
                tree.append({})
            at = tree[at][c]
        ends[at] = v
    size = 2 * len(tree) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[:257], low, top = False, 257, 257
    queue = [(0, 0)]
    for node, at in queue:
        if node in ends:
            value[at] = ends[node]
        if not (kids := tree[node]):
            continue
        codes = np.array(list(kids), np.int64)
        b = low - int(codes[0]) if len(kids) == 1 else max(top - 1024, 1)  # one child fills a gap, several go near the end
        while True:
            if b + 1024 >= len(free):
                free = np.append(free, np.ones(size, bool))
                base, check, value = np.append(base, np.zeros(size, np.int32)), np.append(check, np.full(size, -1, np.int32)), np.append(value, np.full(size, -1, np.int32))
            ok = free[codes[None, :] + np.arange(b, b + 256)[:, None]].all(1)
            if ok.any():
                b += int(ok.argmax())
                break
            b += 256
        top = max(top, b + int(codes.max()))
        base[at] = b
        free[b + codes] = False
        check[b + codes] = at
        while low < len(free) and not free[low]:
            low += 1
        queue += [(kid, b + c) for c, kid in kids.items()]
    return base, check, value


class Vocabulary:
    """Pieces and log scores; byte_ids are the 256 ids of single bytes. It holds arrays only, so Spark can broadcast it."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int]) -> None:
        keys = {p.replace(MARK, " ").encode(): i for i, p in enumerate(pieces) if normal[i] and p}
        self.base, self.check, self.value = double_array(keys)
        self.scores = np.array(scores, np.float64)
        self.unknown = float(min((s for s, n in zip(scores, normal, strict=True) if n and s > _UNUSED), default=0.0)) - _UNKNOWN_PENALTY
        self.byte_ids = np.array(byte_ids, np.uint32)
        self.longest = max(map(len, keys), default=1)
        surface = [k.replace(MARK, " ").encode() if normal[i] else b"" for i, k in enumerate(pieces)]
        for c, i in enumerate(byte_ids):
            surface[i] = bytes([c])
        self.surface_at = np.zeros(len(surface) + 1, np.int64)
        np.cumsum([len(s) for s in surface], out=self.surface_at[1:])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file of the sentencepiece library, with the scores as they stand there."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte_ids = [m.piece_to_id(f"<0x{c:02X}>") for c in range(256)]
        normal = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], normal, byte_ids)

    def viterbi(self, words: list[bytes]) -> list[bytes]:
        """The best ids of each word, as little-endian unsigned 32-bit numbers. Of equal scores, the earlier start wins."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= _LONG_RUN), key=lambda i: len(words[i]))
        for i, w in enumerate(words):
            if len(w) > _LONG_RUN:
                out[i] = self._long_run(w)
        at = 0
        while at < len(order):  # words of similar length, about 1 MB of cells together
            n = min(max(1, (1 << 17) // (len(words[order[min(at + 4096, len(order) - 1)]]) + 1)), len(order) - at)
            part = order[at : at + n]
            for i, ids in zip(part, self._search([words[i] for i in part]), strict=True):
                out[i] = ids
            at += n
        return out

    def _search(self, words: list[bytes]) -> Iterator[bytes]:
        width = max(map(len, words))
        cells = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(len(words), width + 1)
        lengths = np.array([len(w) for w in words])
        best = np.full((len(words), width + 5), -np.inf)
        best[:, 0] = 0
        piece = np.full((len(words), width + 5), -1, np.int64)
        since = np.zeros((len(words), width + 5), np.int64)
        for s in range(width):
            rows = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            lead = cells[rows, s]
            step = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
            single = np.zeros(len(words), bool)
            char_end = np.zeros(len(words), np.int64)
            char_end[rows] = step
            score_here, all_rows = best[:, s], rows
            node = np.zeros(len(rows), np.int64)
            for t in range(s, min(width, s + self.longest)):
                nxt = self.base[node].astype(np.int64) + cells[rows, t]
                ok = (self.check[np.minimum(nxt, len(self.check) - 1)] == node) & (lengths[rows] > t) & (nxt < len(self.check))
                rows, node = rows[ok], nxt[ok]
                if not len(rows):
                    break
                v = self.value[node]
                hit = v >= 0
                r, v = rows[hit], v[hit]
                single[r[char_end[r] == t + 1 - s]] = True
                new = score_here[r] + self.scores[v]
                up = new > best[r, t + 1]
                r, v = r[up], v[up]
                best[r, t + 1], piece[r, t + 1], since[r, t + 1] = new[up], v, s
            bare = all_rows[~single[all_rows]]
            if len(bare):
                to = s + char_end[bare]
                new = score_here[bare] + self.unknown
                up = new > best[bare, to]
                bare, to = bare[up], to[up]
                best[bare, to], piece[bare, to], since[bare, to] = new[up], -1, s
        # All words are followed back together, from their ends; -1 stands for a character that falls back to bytes.
        place, steps = lengths.copy(), []
        rows = np.arange(len(words))
        while len(rows):
            at = place[rows]
            steps.append((rows, piece[rows, at], since[rows, at], at))
            place[rows] = since[rows, at]
            rows = rows[place[rows] > 0]
        order = np.concatenate([x[0] for x in steps[::-1]])
        order_by = np.argsort(order, kind="stable")
        ids, start, stop = (np.concatenate([x[k] for x in steps[::-1]])[order_by] for k in (1, 2, 3))
        bounds = np.searchsorted(order[order_by], np.arange(len(words) + 1)).tolist()
        raw, bare_words = ids.astype("<u4").tobytes(), set(order[order_by][ids < 0].tolist())
        for i, w in enumerate(words):
            a, b = bounds[i], bounds[i + 1]
            if i not in bare_words:
                yield raw[4 * a : 4 * b]
                continue
            own: list[int] = []
            for k in range(a, b):
                own += [int(ids[k])] if ids[k] >= 0 else [int(self.byte_ids[c]) for c in w[start[k] : stop[k]]]
            yield np.array(own, "<u4").tobytes()

    def _matches(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, piece) of all pieces that occur in these bytes, one array for each length."""
        at, node = np.arange(len(cells)), np.zeros(len(cells), np.int64)
        for t in range(self.longest):
            inside = at + t < len(cells)
            at, node = at[inside], node[inside]
            nxt = self.base[node].astype(np.int64) + cells[at + t]
            ok = (nxt < len(self.check)) & (self.check[np.minimum(nxt, len(self.check) - 1)] == node)
            at, node = at[ok], nxt[ok]
            if not len(at):
                return
            hit = self.value[node] >= 0
            yield at[hit], at[hit] + t + 1, self.value[node[hit]].astype(np.int64)

    def _long_run(self, word: bytes, window: int = 1 << 16) -> bytes:
        """The best ids of one long word. Pieces are found at all places together, windows of a bounded size at a time;
        what is left for each byte is to compare the scores of the few pieces that start there."""
        n = len(word)
        cells = np.frombuffer(word, np.uint8)
        step = np.select([cells < 0x80, cells < 0xC0, cells < 0xE0, cells < 0xF0], [1, 0, 2, 3], 4)  # 0: inside a character
        best, since, piece = [-np.inf] * (n + 5), np.zeros(n + 5, np.int64), np.full(n + 5, -1, np.int64)
        best[0] = 0.0
        scores, unknown = self.scores, self.unknown
        for first in range(0, n, window):
            own = [x for x in self._matches(cells[first : first + window + self.longest])]
            start, end, found = (np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.int64) for k in range(3))
            keep = start < window
            order = np.lexsort((end[keep], start[keep]))
            start, end, found = (x[keep][order] for x in (start, end, found))
            bounds = np.searchsorted(start, np.arange(window + 1)).tolist()
            ends, gains, ids = (end + first).tolist(), scores[found].tolist(), found.tolist()
            steps = step[first : first + window].tolist()
            for i, char in enumerate(steps):
                s = first + i
                here = best[s]
                if here == -np.inf:
                    continue
                bare = s + (char or 1)
                for k in range(bounds[i], bounds[i + 1]):
                    t, new = ends[k], here + gains[k]
                    if t == s + char:
                        bare = 0
                    if new > best[t]:
                        best[t], since[t], piece[t] = new, s, ids[k]
                if bare and here + unknown > best[bare]:
                    best[bare], since[bare], piece[bare] = here + unknown, s, -1
        out, t = [], n
        while t > 0:
            s, p = int(since[t]), int(piece[t])
            out.append(np.array([p], "<u4").tobytes() if p >= 0 else self.byte_ids[cells[s:t]].astype("<u4").tobytes())
            t = s
        return b"".join(out[::-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD. The blank put before a text goes."""
        first, last = self.surface_at[ids], self.surface_at[ids.astype(np.int64) + 1]
        size = last - first
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
        text = self.surface[place].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes whole texts, remembering words of up to `longest` characters until they take max_bytes."""

    def __init__(self, vocabulary: Vocabulary, max_bytes: int = 96 << 20, longest: int = 256) -> None:
        self.vocabulary, self.max_bytes, self.longest, self.ids, self.ids_bytes = vocabulary, max_bytes, longest, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """A blank is put before every text that isn't empty; no piece spans a blank that follows another character."""
        words = [_SEGMENT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if self.ids_bytes > self.max_bytes:
            self.ids.clear()
            self.ids_bytes = 0
        new = [w for w in set().union(*words) if w not in self.ids]
        long = []
        for w, ids in zip(new, self.vocabulary.viterbi([w.encode() for w in new]), strict=True):
            self.ids[w] = ids
            if len(w) > self.longest:
                long.append(w)
            else:
                self.ids_bytes += _ENTRY + len(w) + len(ids)
        out = [b"".join(map(self.ids.__getitem__, w)) for w in words]
        for w in long:
            del self.ids[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip of docs(doc_id, text), and ids if wanted.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers. round_trip says whether decoding gives
    the text again; U+2581 in a text reads as a blank. Null counts as empty: no pieces, round_trip true.
    Repeated rows and null ids pass through; an empty table gives no rows; other columns are ignored.
    model_path is read on the driver only.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(vocabulary)
        encoder = _ENCODERS[key]
        low, high = vocabulary.byte_ids.min(), vocabulary.byte_ids.max()
        for batch in batches:
            rows, ids_out = [], []
            for _, texts in text_slices(batch):
                for t, raw in zip(texts, encoder.encode(texts), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    back = vocabulary.decode(ids)
                    rows.append((len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == t.replace(MARK, " ")))
                    if with_ids:
                        ids_out.append(ids)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
