"""Shared helpers: the input columns, written intermediate tables, and batch-wise text arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, shared_dir, written  # noqa: F401

#: Characters that separate words: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves remainder 0 by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def dice(*columns) -> Column:
    """A number from 0 to below 1 that depends on the columns' values only; its step is 2**-63."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1).cast("double") / float(1 << 63)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text and the label (as `label`) of about max_rows labelled documents that are not held out.

    They are picked by a hash of the id, so the picked ids are few by construction and are sent to the scan. Of
    documents that share an id the one with the least text is taken: one row per id.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    mine = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = mine.count()
    picked = mine.where(dice("doc_id") < min(1.0, max_rows / max(n, 1)))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def place() -> Column:
    """A hash of a row's place in its partition: it parts equal rows, and is the same again when a task is repeated.

    That holds where the partition's rows come from files in their order, not from a shuffle.
    """
    return F.xxhash64(F.monotonically_increasing_id())


def salted_join(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 1000, how: str = "inner", mark: Column | None = None) -> DataFrame:
    """rows joined with groups, which have one row for each key and the number of rows with it in `size`.

    Keys with more than one in `most` of all rows, fewer than `most` keys, are broadcast with a number of salts;
    their rows are dealt over as many tasks by their places, so rows that repeat are parted too, and their groups are
    repeated. rows must be a written table, or what a scan of files gives without a shuffle; for others, whose rows
    must not repeat, `mark` is a hash to deal them by.
    """
    groups = written(groups, False)
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.where(F.col(size) * most > total).select(
        F.col(key).alias("_key"), F.ceil(F.col(size) * most / F.lit(max(total, 1))).cast("int").alias("_salts")
    )
    placed = rows.withColumn("_place", place() if mark is None else mark)
    salted = placed.join(F.broadcast(large), placed[key] == F.col("_key"), "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod("_place", F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    )
    salts = F.when(F.col(size) * most > total, F.ceil(F.col(size) * most / F.lit(max(total, 1))).cast("int")).otherwise(F.lit(1))
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_key", "_salts", "_place").join(dealt, [key, "_salt"], how).drop("_salt")


def text_slices(batch: pa.RecordBatch, column: str = "text", chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a batch with about `chars` characters each; null becomes ''.

    A single longer text forms a slice of its own, so memory follows the longest text and not the batch.
    """
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset : values.offset + len(values) + 1]) if len(values) else np.zeros(0, int)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > chars:
            yield start, [x or "" for x in values.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, [x or "" for x in values.slice(start).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each text starts, with the end."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is changed in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD_POWERS = powers(0xD6E8FEB86659FD93, 64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes of all words; per text the index of its first word, with the end; words' byte starts and ends; the bytes.

    The texts are joined by a space, so that no word spans two of them. A word of up to 64 bytes is a sum of its bytes
    times powers; such sums of longer words can be made to agree by a rule, so these are digested by BLAKE2b.
    """
    raw = " ".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    text_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=text_at[1:])
    first = np.searchsorted(starts, text_at)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends, raw
    length = ends - starts
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _RANDOM[data]
    value *= _WORD_POWERS[np.minimum(place, len(_WORD_POWERS) - 1)]
    value[_IS_SPACE[data]] = 0
    hashes = np.add.reduceat(value, starts)
    hashes ^= length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in np.flatnonzero(length > len(_WORD_POWERS)).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return mix(hashes), first, starts, ends, raw


def rows_like(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
