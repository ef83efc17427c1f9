"""Exact deduplication by Grace hash partitioning.

A first pass in each input partition keeps one body per distinct content, so that a group that
holds a third of all rows sends one row per task. Spark deals the bodies out by digest; inside a
task an open-addressing table compares whole contents, and what does not fit its memory bound is
partitioned to spill files by the next bits of the hash, recursively.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, salted_join, written

_BODY = pa.schema(
    [("digest", pa.binary()), ("body", pa.binary()), ("copies", pa.int64()), ("n_best", pa.int64()), ("id_best", pa.int64()), ("ties", pa.int64())]
)
_CLASS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n_best", pa.int64()), ("ties", pa.int64()), ("group_size", pa.int64())])
_BODY_SQL = "digest binary, body binary, copies long, n_best long, id_best long, ties long"
_CLASS_SQL = "digest binary, keep_id long, n_best long, ties long, group_size long"
_DROP = SPACE.encode()


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _DROP)


def better(n: int, doc: int | None, m: int, other: int | None) -> bool:
    """Whether (n, doc) stays rather than (m, other): more code points, then the smaller id, null last."""
    return n > m or n == m and doc is not None and (other is None or doc < other)


class ContentTable:
    """Open addressing with linear probing over the digest's low bits; a hit must have the same bytes."""

    def __init__(self, max_bytes: int) -> None:
        self.max_bytes, self.used, self.entries = max_bytes, 0, []
        self.slots = array("q", [-1]) * 1024

    def find(self, digest: bytes, body: bytes) -> tuple[int, int]:
        """(slot, entry or -1)."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0:
            if self.entries[k][0] == digest:
                if self.entries[k][1] != body:
                    raise ValueError(f"two contents share the SHA-256 digest {digest.hex()}")
                return at, k
            at = (at + 1) & mask
        return at, -1

    def add(self, digest: bytes, body: bytes, copies: int, n: int, doc: int | None, ties: int = 1) -> bool:
        """Merge a record into its class; False if it would be a new class and memory is used up.

        ties counts the rows that are as good as the best one.
        """
        at, k = self.find(digest, body)
        if k >= 0:
            e = self.entries[k]
            e[2] += copies
            if (n, doc) == (e[3], e[4]):
                e[5] += ties
            elif better(n, doc, e[3], e[4]):
                e[3], e[4], e[5] = n, doc, ties
            return True
        if self.entries and self.used + len(body) > self.max_bytes:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([digest, body, copies, n, doc, ties])
        self.used += len(body) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = array("q", [-1]) * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for i, e in enumerate(self.entries):
                at = int.from_bytes(e[0][:8], "little") & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i
        return True


def grace(records: Iterator[tuple], max_bytes: int, fan_out: int = 8, level: int = 0) -> Iterator[list]:
    """The classes of records (digest, body, copies, n, doc, ties).

    Classes that fit are merged in place; other records go to one of fan_out spill files by a digest byte
    that no level above has used. Each level settles at least one class, so it ends. The files are private
    to the running task and go with it; a task that runs again writes its own.
    """
    table, files = ContentTable(max_bytes), None
    for r in records:
        if not table.add(*r):
            files = files or [tempfile.TemporaryFile() for _ in range(fan_out)]
            pickle.dump(r, files[r[0][8 + level % 24] % fan_out], protocol=5)
    yield from table.entries
    del table
    for f in files or ():
        f.seek(0)
        yield from grace(_unpickled(f), max_bytes, fan_out, level + 1)
        f.close()


def _unpickled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _bodies(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(max_bytes)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py() or ""
                body = normalised(text)
                record = hashlib.sha256(body).digest(), body, 1, len(text), doc, 1
                if not table.add(*record):
                    yield from _sent(table.entries, _BODY)
                    table = ContentTable(max_bytes)
                    table.add(*record)
        yield from _sent(table.entries, _BODY)

    return run


def _sent(entries, schema: pa.Schema, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(entries), rows):
        part = entries[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in part], f.type) for k, f in enumerate(schema)], schema=schema)


def _settle(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (tuple(x.as_py() for x in r) for b in batches for r in zip(*b.columns, strict=True))
        out = []
        for digest, _, copies, n, doc, ties in grace(records, max_bytes):
            out.append((digest, doc, n, ties, copies))
            if len(out) >= 5000:
                yield from _sent(out, _CLASS)
                out = []
        yield from _sent(out, _CLASS)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256(normalised(t.as_py())).digest() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary())], names=["doc_id", "digest"])


def content_classes(docs: DataFrame, table_bytes: int = 48 << 20) -> DataFrame:
    """digest, keep_id, n_best, ties, group_size of each distinct content of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bodies = rows.mapInArrow(_bodies(table_bytes // 3), _BODY_SQL)
    return bodies.repartition("digest").mapInArrow(_settle(table_bytes), _CLASS_SQL)


def exact_dedup(docs: DataFrame, table_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs(doc_id, text).

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as empty, so null,
    empty and blank texts form one group. Of a group stays the row with the most code points, then the
    smallest doc_id, a null id last. Rows that repeat a doc_id within a group are one document: they share `kept`.
    An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    light = written(rows.mapInArrow(_digests, "doc_id long, digest binary"), False)
    joined = salted_join(light, content_classes(docs, table_bytes), "digest", "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return joined.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame, table_bytes: int = 48 << 20) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each content, as exact_dedup chooses.

    Each row is decided by its own content, so rows with a null or repeated doc_id of other texts stay. Of rows
    that tie, with one doc_id and one length, one stays. Null and empty texts are one content. Empty tables give
    no rows; columns may have any names.
    """
    body = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), SPACE, "")
    length = F.length(F.coalesce(docs["text"].cast("string"), F.lit("")))
    key = {"_id": docs["doc_id"].cast("long"), "_digest": F.unhex(F.sha2(body.cast("binary"), 256)), "_n": length}
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    rows = docs.select(row, *(c.alias(n) for n, c in key.items()))
    best = written(content_classes(docs, table_bytes).select("digest", "keep_id", "n_best", (F.col("ties") > 1).alias("_tied")), False)
    same = (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("n_best"))
    kept = rows.join(best, same).select("_row", "digest", "_tied")
    alone = kept.where("not _tied").select("_row")
    one = kept.where("_tied").groupBy("digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return alone.unionByName(one.select("_row")).select("_row.*")
