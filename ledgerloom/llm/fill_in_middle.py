"""Fill-in-middle transformation over a wavelet matrix of character classes.

Every byte of a text has a class: the continuation of a character, or the first byte of a line feed, of another
white-space character, of a character that starts a word, or of one inside a word. The classes of a slice of texts
form one wavelet matrix. Units are counted by ranks of those classes that begin one, ranks over a set of classes are
summed from as few nodes of the matrix as cover the set, and the byte at which the k-th unit begins is found by
bisection on such ranks, for all texts of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

#: Classes of bytes, as codes of three bits: the codes of first bytes of characters are those from 4 on.
INSIDE, LINE_FEED, BLANK, WORD_START, WORD_INNER = 0, 4, 5, 6, 7
#: The classes whose bytes begin a unit. A line begins after its line feed, so cuts by lines fall behind one.
UNITS = {"character": (LINE_FEED, BLANK, WORD_START, WORD_INNER), "word": (WORD_START,), "line": (LINE_FEED,)}
#: The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts in UTF-8 that begin at `starts` and lie one after another."""
    space = _SPACE[data]
    after = np.ones(len(data), bool)
    after[1:] = space[:-1]
    after[starts[starts < len(data)]] = True
    code = np.where(space, BLANK, np.where(after, WORD_START, WORD_INNER)).astype(np.uint8)
    code[data == 10] = LINE_FEED
    code[(data & 0xC0) == 0x80] = INSIDE
    return code


class WaveletMatrix:
    """Ranks over a sequence of codes of `bits` bits.

    A level holds one bit of each code, packed into words of 64 with the number of ones before each word; codes with a
    0 go to the front of the next level, codes with a 1 behind them, in their order.
    """

    def __init__(self, codes: np.ndarray, bits: int = 3) -> None:
        self.bits, self.levels = bits, []
        n = len(codes)
        for level in reversed(range(bits)):
            bit = codes >> level & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            little = np.packbits(bit, bitorder="little")
            packed[: len(little)] = little
            words = packed.view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = n - int(bit.sum())
            self.levels.append((words, before, zeros))
            codes = np.concatenate((codes[bit == 0], codes[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def rank(self, wanted: tuple[int, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many codes from start to end, exclusive, are in `wanted`; one answer for each place of the arrays."""
        found = np.zeros(len(start), np.int64)
        todo = [(0, frozenset(wanted), np.asarray(start, np.int64), np.asarray(end, np.int64))]
        while todo:
            level, codes, lo, hi = todo.pop()
            if len(codes) == 1 << (self.bits - level):  # the node's codes are all wanted
                found += hi - lo
                continue
            one = 1 << (self.bits - level - 1)
            below, above = self._ones(level, lo), self._ones(level, hi)
            zeros = self.levels[level][2]
            for bit, a, b in ((0, lo - below, hi - above), (1, zeros + below, zeros + above)):
                part = frozenset(c & (one - 1) for c in codes if bool(c & one) == bool(bit))
                if part:
                    todo.append((level + 1, part, a, b))
        return found

    def select(self, wanted: tuple[int, ...], start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the (k+1)-th of `wanted` from start on, or end if there are no more than k: bisection on ranks."""
        lo, hi = start.astype(np.int64), end.astype(np.int64)
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            enough = self.rank(wanted, start, np.minimum(mid + 1, end)) > k
            open_ = lo < hi
            hi = np.where(open_ & enough, mid, hi)
            lo = np.where(open_ & ~enough, mid + 1, lo)
        return lo


@dataclass
class Plan:
    """Which form a text gets: its key's first four numbers by a hash of seed and id, and the rates by percent."""

    unit: str = "character"
    plain_percent: int = 10
    spm_percent: int = 20
    seed: int = 1

    def numbers(self, doc_id: Column) -> Column:
        """h1 to h4 as an array."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
        return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def _slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of slices of a binary column with about `size` bytes; a longer text is a slice alone."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SQL = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"


def _transform(plan: Plan):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    unit = UNITS[plan.unit]
    shift = 1 if plan.unit == "line" else 0  # a line ends behind its line feed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, h = batch.column(0), batch.column(1), batch.column(2)
            numbers = h.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for first, data, bounds in _slices(texts):
                rows = len(bounds) - 1
                lo, hi = bounds[:-1], bounds[1:]
                own = numbers[first : first + rows]
                matrix = WaveletMatrix(classes(data, lo))
                n = matrix.rank(unit, lo, hi)
                cuts = np.sort(own[:, :2] % (n + 1)[:, None], axis=1)
                if shift:
                    place = [np.where(k > 0, np.minimum(matrix.select(unit, lo, hi, k - 1) + 1, hi), lo) for k in cuts.T]
                else:
                    place = [np.where(k > 0, matrix.select(unit, lo, hi, k), lo) for k in cuts.T]
                p, m = place
                chars = [matrix.rank(UNITS["character"], a, b) for a, b in ((lo, p), (p, m))]
                raw = data.tobytes()
                forms, outputs = [], []
                for i in range(rows):
                    text = raw[lo[i] : hi[i]]
                    if not text or any(x in text for x in marks) or own[i, 2] % 100 >= 100 - plan.plain_percent:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    parts = raw[lo[i] : p[i]], raw[p[i] : m[i]], raw[m[i] : hi[i]]
                    spm = own[i, 3] % 100 < plan.spm_percent
                    forms.append("spm" if spm else "psm")
                    order = (marks[1], parts[2], marks[0], parts[0]) if spm else (marks[0], parts[0], marks[1], parts[2])
                    outputs.append(b"".join((*order, marks[2], parts[1])))
                plain = np.array([f == "plain" for f in forms])
                column = lambda x, off=plain: pa.array(x, pa.int64(), mask=off)
                counts = [pa.array(n, pa.int64()), pa.array(forms), column(cuts[:, 0]), column(cuts[:, 1] - cuts[:, 0]), column(chars[0]), column(chars[1])]
                # The bytes are those of Spark strings, so they are taken as text as they are.
                text = pa.array(outputs, pa.binary()).cast(pa.string(), safe=False) if sum(map(len, outputs)) < 2**31 - 1 else pa.array(outputs, pa.large_binary()).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), *counts, text], names=[c.split()[0] for c in _SQL.split(", ")])

    return run


def fill_in_middle(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output of each row of docs(doc_id, text).

    A text is cut twice between units: characters (code points), words (a cut falls before a word's first character)
    or lines (a cut falls behind a line feed). n is its number of units. The form is plain if the text is null or
    empty, contains a mark or is picked to stay plain; otherwise psm or spm by the order of the parts, and `output`
    has the marks. The counts are null in plain rows, whose output is the text (empty for null).

    A row decides by its own doc_id and text: a null doc_id counts as empty, repeated rows give equal rows, nothing is
    shuffled, and a long text only needs memory of a few times its size. An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    plan = plan or Plan()
    doc_id = docs["doc_id"].cast("long")
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), plan.numbers(doc_id).alias("h"))
    return rows.mapInArrow(_transform(plan), _SQL)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A mark can't begin inside another, so the first of each is the right one."""
    after = lambda x, mark: let(F.split(x, mark, 2), lambda parts: parts)
    rest = F.substring(output, len(PREFIX) + 1, F.length(output))

    def joined(first_mark: str, order: str) -> Column:
        def build(head: Column) -> Column:
            tail = after(head[1], MIDDLE)
            return F.concat(head[0], tail[1], tail[0]) if order == "psm" else F.concat(tail[0], tail[1], head[0])

        return let(after(rest, first_mark), build)

    return F.when(form == "psm", joined(SUFFIX, "psm")).when(form == "spm", joined(PREFIX, "spm")).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with SHA-256 digests of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
