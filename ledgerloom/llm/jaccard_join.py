"""N-gram Jaccard self-join by chosen paths.

A document is its set of five-word shingles; equal sets become one node. In each run a node follows a path:
at every level a random order of tokens samples the node's first one, and nodes that share it stay together.
Spark counts the nodes of each path; a path with few nodes is a bucket, one with many is split by the next
level. Buckets are compared exactly in blocks of bounded size, and no pair leaves its task: a task emits
link counts and a spanning forest of what it linked. Runs repeat until a pair at the threshold is found
with the target recall even at the deepest level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, salted_join, text_slices, word_hashes, written

_KEY_SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03))


def runs_for(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for fewer than n words."""
    h, first, _, _, _ = word_hashes(texts)
    if len(h) < n:
        return [np.zeros(0, np.uint64)] * len(texts)
    size = len(h) - n + 1
    s = np.zeros(size, np.uint64)
    for k in range(n):
        s *= np.uint64(0x9FB21C651E98DF25)
        s += h[k : k + size]
    mix(s)
    return [np.unique(s[a : max(b - n + 1, a)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def set_ids(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that stand for each set; None for an empty one."""
    out: list[bytes | None] = []
    for s in sets:
        if not len(s):
            out.append(None)
            continue
        a = np.bitwise_xor.reduce(mix(s * _KEY_SEEDS[0]))
        b = np.add.reduce(mix(s ^ _KEY_SEEDS[1]))
        out.append(int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big"))
    return out


def paths(sets: list[np.ndarray], runs: int, depth: int) -> np.ndarray:
    """For each set that isn't empty its path after each level of each run: shape (sets, runs * depth)."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), runs * depth), np.uint64)
    if not full:
        return out
    tokens = np.concatenate(full)
    starts = np.cumsum([0, *(len(s) for s in full[:-1])])
    odd = mix(np.arange(1, runs * depth + 1, dtype=np.uint64)) | np.uint64(1)
    for r in range(runs):
        path = np.full(len(full), r + 1, np.uint64)
        for d in range(depth):
            k = r * depth + d
            path = mix(path * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(tokens * odd[k], starts))
            out[:, k] = path
    return out


def _sketches(n: int, runs: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sizes = [], [], []
            for _, texts in text_slices(batch):
                sets = shingle_sets(texts, n)
                some = iter(paths(sets, runs, depth).view(np.int64))
                ids += set_ids(sets)
                sizes += [len(s) for s in sets]
                keys += [next(some).astype("<i8").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "h", "node", "n_shingles", "paths"])

    return run


_LEVEL = pa.schema([("node", pa.binary()), ("run", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])
_LEVEL_SQL = "node binary, run int, bucket long, n long"


def _at_level(depth: int, level: int):
    """Rows (node, run, bucket, n) of each run from (node, paths, n), or from (node, paths, n, run) of that run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            if not keys:
                continue
            table = np.stack([np.frombuffer(k, "<i8") for k in keys])[:, level::depth]
            at = np.arange(len(keys))
            if batch.num_columns == 4:
                runs = batch.column(3).to_numpy(zero_copy_only=False)
                buckets = table[at, runs]
            else:
                at, runs, buckets = np.repeat(at, table.shape[1]), np.tile(np.arange(table.shape[1]), len(keys)), table.ravel()
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(runs, pa.int32()), pa.array(buckets, pa.int64()), batch.column(2).take(rows)], schema=_LEVEL
            )

    return run


def buckets(nodes: DataFrame, depth: int, first_level: int, small: int) -> DataFrame:
    """(node, bucket, size, weight): the leaves of the recursion with two nodes or more, the same set of nodes only once.

    weight is the number of shingles of all of a bucket's nodes.
    """
    paths_of = nodes.select("node", "paths", F.col("n_shingles").alias("n"))
    rows = paths_of.mapInArrow(_at_level(depth, first_level), _LEVEL_SQL)
    leaves = None
    for level in range(first_level, depth):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
        sized = written(salted_join(rows, sizes, "bucket", "size", mark=F.xxhash64("node", "run")))
        last = level == depth - 1
        done = sized if last else sized.where(F.col("size") <= small)
        leaves = done if leaves is None else leaves.unionByName(done)
        if not last:
            big = sized.where(F.col("size") > small).select("node", "run")
            again = big.join(paths_of, "node").select("node", "paths", "n", "run")
            rows = again.mapInArrow(_at_level(depth, level + 1), _LEVEL_SQL)
    marks = leaves.groupBy("bucket", "size", "weight").agg(
        F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")
    )
    once = marks.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("size").alias("_n"))
    return salted_join(leaves.select("node", "bucket", "size", "weight"), once, "bucket", "_n").drop("_n")


def blocks_of(size: int, weight: int, block: int, most_shingles: int = 4 << 20) -> int:
    """Into how many blocks a bucket of `size` nodes with `weight` shingles is split; each two blocks are a cell.

    A node is sent to as many cells as there are blocks. Blocks have `block` nodes while 16 suffice, then grow to
    eight times that, so that the hottest buckets send each node less often; their shingles fit a task in any case.
    """
    return max(-(-size // min(max(block, -(-size // 16)), 8 * block)), -(-weight // most_shingles))


_CELL = pa.schema(
    [("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("node", pa.binary()), ("copies", pa.int64()),
     ("tokens", pa.binary()), ("others", pa.list_(pa.int64()))]
)
_CELL_SQL = "bucket long, i int, j int, own int, node binary, copies long, tokens binary, others array<long>"


def _cells(n: int, block: int):
    """Rows of (doc_id, text, node, copies, in) -> one for each cell of each bucket that the node takes part in.

    Repeated rows that follow each other, as a join leaves them, count once.
    """

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CELL, strict=True)], schema=_CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows, held = None, [], 0
        for batch in batches:
            nodes, copies, member = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for start, texts in text_slices(batch):
                sets = shingle_sets(texts, n)
                for k, (s, found) in enumerate(zip(sets, set_ids(sets), strict=True), start):
                    if found != nodes[k] or found == before:
                        continue
                    before, raw = found, s.astype("<u8").tobytes()
                    names = sorted(m["bucket"] for m in member[k])
                    for m in member[k]:
                        g = blocks_of(m["size"], m["weight"], block)
                        own = int.from_bytes(found[:8], "big") % g
                        lower = [b for b in names if b < m["bucket"]]
                        for other in range(g):
                            rows.append((m["bucket"], min(own, other), max(own, other), own, found, copies[k], raw, lower))
                            held += len(raw) + 100
                            if held > 4 << 20:
                                yield sent(rows)
                                rows, held = [], 0
        if rows:
            yield sent(rows)

    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each list of a shares with each of b: incidence matrices, some columns at a time."""
    known = np.intersect1d(np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64))
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(known):
        return out

    def places(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, rows = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        hit = known[at] == values
        at, rows = at[hit], rows[hit]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    at_a, rows_a = places(a)
    at_b, rows_b = (at_a, rows_a) if a is b else places(b)
    for c in range(0, len(known), columns):
        x, y = np.zeros((len(a), columns), np.float32), np.zeros((len(b), columns), np.float32)
        lo, hi = np.searchsorted(at_a, [c, c + columns])
        x[rows_a[lo:hi], at_a[lo:hi] - c] = 1
        lo, hi = np.searchsorted(at_b, [c, c + columns])
        y[rows_b[lo:hi], at_b[lo:hi] - c] = 1
        out += x @ y.T
    return out


def compare(rows: list[tuple], threshold: float, tile: int = 512) -> Iterator[tuple[bytes, bytes | None, int]]:
    """Of one cell: (node, None, weight of links) for each linked node and (node, node, 0) for a forest of the links.

    A pair that also meets in a bucket of lower number is left to that one. Pairs are compared in tiles.
    """
    rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: (r[3], r[4]))
    i, j = rows[0][1], rows[0][2]
    sets = [np.frombuffer(r[6], "<u8") for r in rows]
    size = np.array([len(s) for s in sets])
    own = np.array([r[3] for r in rows])
    copies = np.array([r[5] for r in rows], np.int64)
    weight = np.zeros(len(rows), np.int64)
    root = list(range(len(rows)))
    forest: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in range(0, len(rows), tile):
        for q in range(p, len(rows), tile):
            left, right = slice(p, p + tile), slice(q, q + tile)
            if i != j and own[left][0] == own[right][-1]:
                continue  # rows are in order of own: a tile pair within one block belongs to another cell
            common = shared_counts(sets[left], sets[left] if p == q else sets[right])
            link = common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-9
            if p == q:
                link = np.triu(link, 1)
            if i != j:
                link &= own[left][:, None] != own[right][None, :]
            if not link.any():
                continue
            others = [[np.array(r[7], np.int64) for r in rows[part]] for part in (left, right)]
            link &= shared_counts(*others) == 0
            weight[left] += link @ copies[right]
            weight[right] += link.T @ copies[left]
            for a, b in zip(*np.nonzero(link), strict=True):
                x, y = find(p + int(a)), find(q + int(b))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    forest.append((p + int(a), q + int(b)))
    for k in np.flatnonzero(weight):
        yield rows[k][4], None, int(weight[k])
    for a, b in forest:
        yield rows[a][4], rows[b][4], 0


def _compare_cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], names=["a", "b", "links"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    out.extend(compare(held, threshold))
                    held = []
                    if len(out) > 5000:
                        yield batch_of()
                held.append(row)
        if held:
            out.extend(compare(held, threshold))
        yield batch_of()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b): the least node that it is connected with.

    Alternates large and small stars until nothing changes; every round is one written table. A star's centre may
    have any number of neighbours: their rows are dealt over several tasks.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        sign = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign == before or not sign[0]:
            break
        before = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        near = salted_join(both, least, "u", "_n").where("v > u")
        large = written(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), False)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def jaccard_join(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id, n_links of each row of docs(doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Two documents are linked if the Jaccard similarity of their sets of
    five-word shingles is at least the threshold; class_id is the least doc_id connected by links, n_links the
    number of other rows linked with this one, copies included. A text that is null or has fewer than five words
    has no shingles and no links, and is a class of its own. Repeated rows count as copies; rows with a null
    doc_id take part and have the class of their copies, null if no row with an id is in it. Links that the join
    reports are exact; a link at the threshold is found with probability `recall` at least. An empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    return _linked(docs, **parameters).select("doc_id", "class_id", "n_links")


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def _linked(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.998, depth: int = 4, first_level: int = 1, small: int = 64, block: int = 512
) -> DataFrame:
    """jaccard_join with h, the hash of the row's text, and keeps: the (doc_id, h) that stays of the row's class.

    (doc_id, h) names a row's content also where ids repeat or are null. Of a class stays the least doc_id, nulls
    last, then the least h.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _text_hash(docs).alias("h"))
    runs = runs_for(threshold, depth, recall)
    sketches = written(rows.mapInArrow(_sketches(words, runs, depth), "doc_id long, h long, node binary, n_shingles long, paths binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    nodes = sketches.where("node is not null").groupBy("node").agg(
        first.alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("paths").alias("paths")
    )
    nodes = written(nodes)
    member = buckets(nodes, depth, first_level, small).groupBy("node").agg(F.collect_list(F.struct("bucket", "size", "weight")).alias("in"))
    chosen = nodes.select("node", "first", "copies").join(member, "node")
    met = rows.join(chosen, (F.col("h") == F.col("first.h")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    cells = met.select("doc_id", "text", "node", "copies", "in").mapInArrow(_cells(words, block), _CELL_SQL)
    dealt = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    linked = written(dealt.mapInArrow(_compare_cells(threshold), "a binary, b binary, links long"))
    links = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(linked.where("b is not null"))
    known = written(nodes.select("node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), False)
    least = known.groupBy("root").agg(F.min("first").alias("keeps"), F.count("*").alias("_n"))
    by_node = salted_join(known, least, "root", "_n").join(links, "node", "left")
    by_node = by_node.select("node", "copies", "keeps", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    light = sketches.select("doc_id", "h", "node")
    grouped = salted_join(light.where("node is not null"), by_node, "node", "copies").select("doc_id", "h", "keeps", "n_links")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h").alias("keeps")
    alone = light.where("node is null").select("doc_id", "h", own, F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone).select("doc_id", "h", F.col("keeps.doc_id").alias("class_id"), "n_links", "keeps")


def keep_one_of_each_class(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of linked documents.

    It is the one with the least doc_id, null last. Each row decides by its own content: of rows with a null or
    repeated doc_id only those go that are linked with the one that stays. Of rows equal in doc_id and text one
    stays; so every text without shingles, null ones too, that repeats under one doc_id stays once. An empty
    table gives no rows; columns may have any names.
    """
    joined = _linked(docs, **parameters)
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    decided = joined.groupBy("doc_id", "h").agg(F.max(me != F.col("keeps")).alias("_goes"), F.count("*").alias("_times"))
    marked = written(decided.select(F.col("doc_id").alias("_did"), F.col("h").alias("_hid"), "_goes", "_times").where("_goes or _times > 1"))
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("_id"), _text_hash(docs).alias("_h"))
    same = F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_h") == F.col("_hid"))
    plain = rows.join(marked, same, "left_anti").select("_row")
    tied = rows.join(marked.where("not _goes"), same).groupBy("_id", "_h").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return plain.unionByName(tied.select("_row")).select("_row.*")
