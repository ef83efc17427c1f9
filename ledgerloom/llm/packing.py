"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs linear * n + quadratic * n * n, as attention within it does. In each block of
documents the pieces, longest first, go to the sequence of lowest cost that has room for them. Blocks lie
within one input partition, so nothing is shuffled and no text leaves its task.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_TOKENIZERS: dict = {}
_ENTRY = 160  # bytes of an entry of a table beside its key's and value's own


# The words for which the normaliser and the pre-tokenizer do no more than these two: Latin-1 without blanks,
# controls and the digits above 9, and without the strings of special tokens. Others go to the tokenizer whole.
_SIMPLE = re.compile(r"(?!.*<\|)[\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]*", re.S)
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9]|[^a-zªµºß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class WordCache:
    """Ids of texts, remembered by word and by part of a word: no token of the vocabulary spans white space.

    Words are cut at ASCII white space only. The memory is bounded in bytes: a table that holds max_bytes is emptied
    before the next texts, and words or parts of more than `longest` bytes are not remembered beyond them.
    """

    def __init__(self, path: str, max_bytes: int, longest: int = 256) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.max_bytes, self.longest = Tokenizer.from_file(path), max_bytes, longest
        self.ids: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.ids_bytes = self.parts_bytes = 0
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelt = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = np.array([t.id for t in self.tokenizer.model.tokenize(spelt)], "<u4").tobytes()
            if len(part) <= self.longest:
                if self.parts_bytes > self.max_bytes:
                    self.parts.clear()
                    self.parts_bytes = 0
                self.parts[part] = found
                self.parts_bytes += _ENTRY + len(part) + len(found)
        return found

    def word(self, word: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit numbers."""
        if _SIMPLE.fullmatch(word):
            return b"".join(map(self._part, _PARTS.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        split = [t.encode().split() for t in texts]
        if self.ids_bytes > self.max_bytes:
            self.ids.clear()
            self.ids_bytes = 0
        long = []
        for w in set().union(*split):
            if w not in self.ids:
                found = self.ids[w] = self.word(w.decode())
                if len(w) > self.longest:
                    long.append(w)
                else:
                    self.ids_bytes += _ENTRY + len(w) + len(found)
        out = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        for w in long:
            del self.ids[w]
        return iter(out)


def tokenizer(path: str, max_bytes: int = 64 << 20) -> WordCache:
    """One per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCache(path, max_bytes)
    return _TOKENIZERS[path]


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths.

    What a document has beyond whole sequences competes with the other documents for the fewest sequences
    that hold all. A piece is cut only if no sequence has room for it: the emptiest takes what it can. So
    at most one sequence's worth of room stays empty in a block.
    """
    pieces, heap, n_sequences = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, n_sequences, 0))
            n_sequences += 1
        if n % capacity:
            heap.append((-(n % capacity), doc, whole * capacity))
    heapq.heapify(heap)
    n_open = -(sum(x[0] for x in heap) // capacity)
    room, cost = np.full(n_open, capacity), np.zeros(n_open)
    while heap:
        n, doc, start = heapq.heappop(heap)
        n = -n
        k = int(np.where(room >= n, cost, np.inf).argmin())
        put = n
        if room[k] < n:
            k = int(room.argmax())
            put = int(room[k])
            heapq.heappush(heap, (put - n, doc, start + put))
        pieces.append((doc, start, put, n_sequences + k, capacity - int(room[k])))
        room[k] -= put
        cost[k] += linear * put + quadratic * put * put
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = 3_000_000, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs(doc_id, text).

    Null text counts as empty: such a document is the one id end_id. Repeated rows are packed as often as
    they occur; a null doc_id stays null; an empty table gives no pieces; other columns are ignored.
    tokenizer_path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        next_sequence, held = part << 36, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_sequence, held
            pieces = pack([len(x) // 4 for x in ids], capacity, linear, quadratic)
            for i in range(0, len(pieces), 20_000):
                rows = [(names[d], s, n, zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]), len(ids[d]) // 4, next_sequence + q, o) for d, s, n, q, o in pieces[i : i + 20_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_OUT)
            next_sequence += 1 + max((p[3] for p in pieces), default=-1)
            ids.clear()
            names.clear()
            held = 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, texts in text_slices(batch):
                for i, found in enumerate(words.encode(texts)):
                    ids.append(found + end)
                    names.append(doc_ids[start + i])
                    held += len(ids[-1]) // 4
                    if held >= block_tokens:
                        yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{f.name} long" for f in _OUT))
