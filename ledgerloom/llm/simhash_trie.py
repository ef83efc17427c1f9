"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits are the leaves of a trie. The join visits pairs of nodes of one depth together, from the pair
of the root with itself, adds up the bits in which their paths differ, and leaves a pair as soon as there are more
than the budget of its depth. With a budget of e errors the bits form e + 1 blocks, and the join runs once for each block
put first: of two fingerprints with at most e errors, one such order has, for every j, at most j - 1 errors in its
first j blocks (else errors would exceed e), so that is the budget of j blocks, and pairs part early without any
being lost.

Spark holds pairs of nodes as cells, from the equal first blocks on. A cell of too many fingerprints is split into the
pairs of its nodes' children, so a dense or hot part of the trie is spread over tasks; a cell within the bound is
joined by one task, level by level over arrays. Cells report forests that span what they link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, written
from .jaccard_join import components

BITS = 64
_SPACES = b" \t\n\x0b\x0c\r"


def _pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end between words."""
    at = 0
    while len(raw) - at > size:
        cuts = [c for s in _SPACES if (c := raw.find(s, at + size, at + 2 * size)) >= 0]
        to = min(cuts) if cuts else next((k for k in range(at + 2 * size, len(raw)) if raw[k] in _SPACES), len(raw))
        yield raw[at:to]
        at = to
    yield raw[at:]


def fingerprint(raw: bytes, words: int = 4, size: int = 1 << 20) -> int:
    """The SimHash of a text in UTF-8: a bit is set if more than half of the shingles' hashes have it.

    Shingles are of `words` words in lower case (A-Z only), joined by a space, repeats included; a text of fewer words
    is one shingle, one without words has fingerprint 0. Long texts are read in pieces that share words - 1 words.
    """
    votes, n, held = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(raw, size):
        found = held + piece.lower().split()
        if len(found) >= words:
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
            n += len(hashes)
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
            held = found[len(found) - words + 1 :]
        else:
            held = found
    if not n:
        return digest(b" ".join(held), 42) if held else 0
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


class Tries:
    """The trie join's shape: the blocks of the fingerprint and the budget of each depth, for each block put first."""

    def __init__(self, errors: int) -> None:
        self.errors, self.blocks = errors, errors + 1
        edge = [BITS * k // self.blocks for k in range(self.blocks + 1)]
        self.shift = edge[:-1]
        self.budget, self.first = [], []
        for r in range(self.blocks):
            sizes = [edge[k % self.blocks + 1] - edge[k % self.blocks] for k in range(r, r + self.blocks)]
            self.first.append(sizes[0])
            self.budget.append([0] + [j for j, size in enumerate(sizes) for _ in range(size)])

    def turned(self, fp: np.ndarray, r: int) -> np.ndarray:
        """Fingerprints with block r first."""
        s = np.uint64(self.shift[r])
        return fp if not s else fp << s | fp >> np.uint64(BITS) - s


def join_cells(tries: Tries, r: np.ndarray, depth: np.ndarray, errors: np.ndarray, a: list[np.ndarray], b: list[np.ndarray | None], small: int = 64, wide: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of fingerprints, in parts, of cells given by block order, depth, errors so far and their two sides.

    The sides are sorted in the cell's block order; b is None if the cell pairs a node with itself.
    """
    sides, bounds = [], [0]
    pairs = []
    for k in range(len(a)):
        at = bounds[-1]
        sides.append(a[k])
        bounds.append(at + len(a[k]))
        if b[k] is None:
            pairs.append((at, bounds[-1], at, bounds[-1]))
        else:
            sides.append(b[k])
            bounds.append(bounds[-1] + len(b[k]))
            pairs.append((at, bounds[-2], bounds[-2], bounds[-1]))
    leaves = np.concatenate(sides) if sides else np.zeros(0, np.uint64)
    budget = np.array(tries.budget, np.int64)
    node = np.array(pairs, np.int64).reshape(-1, 4)
    # A pair of nodes: the ranges of leaves below each, depth, errors, block order.
    todo = [np.column_stack((node, depth, errors, r)).astype(np.int64)]
    while todo:
        now = todo.pop()
        if len(now) > wide:
            todo.extend(np.array_split(now, -(-len(now) // wide)))
            continue
        alo, ahi, blo, bhi = now[:, :4].T
        both = (ahi - alo) * (bhi - blo)
        flat = (both <= small) | (now[:, 4] >= BITS)
        if flat.any():
            yield from _leaves(leaves, now[flat], tries.errors)
        now = now[~flat]
        if not len(now):
            continue
        alo, ahi, blo, bhi, d, e, order = now.T
        mask = np.uint64(1) << (63 - d).astype(np.uint64)
        amid, bmid = _split(leaves, alo, ahi, mask), _split(leaves, blo, bhi, mask)
        same = alo == blo
        limit = budget[order, d + 1]
        down = []
        for x0, x1, y0, y1, more, keep in ((alo, amid, blo, bmid, 0, True), (amid, ahi, bmid, bhi, 0, True), (alo, amid, bmid, bhi, 1, True), (amid, ahi, blo, bmid, 1, ~same)):
            good = (x1 > x0) & (y1 > y0) & (e + more <= limit) & keep
            good &= ~((x0 == y0) & (x1 - x0 < 2))
            down.append(np.column_stack((x0, x1, y0, y1, d + 1, e + more, order))[good])
        now = np.concatenate(down)
        if len(now):
            todo.append(now)


def _split(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """In each range of leaves, which share all bits before the mask's, the first with that bit set."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (leaves[np.where(open_, mid, 0)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaves(leaves: np.ndarray, pairs: np.ndarray, errors: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs below small pairs of nodes: each leaf of one with each of the other, most at a time."""
    alo, ahi, blo, bhi = pairs[:, :4].T
    count = (ahi - alo) * (bhi - blo)
    at = 0
    total = np.cumsum(count)
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        part = np.repeat(np.arange(at, to), count[at:to])
        k = np.arange(len(part)) - np.repeat(total[at:to] - count[at:to] - (total[at - 1] if at else 0), count[at:to])
        width = (bhi - blo)[part]
        x, y = alo[part] + k // width, blo[part] + k % width
        near = (x < y) & (np.bitwise_count(leaves[x] ^ leaves[y]) <= errors)
        if near.any():
            yield leaves[x[near]], leaves[y[near]]
        at = to


class Forest:
    """Union-find over the fingerprints of one group of cells; keeps the links that joined two trees."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.kept.append((x, y))


def _join(errors: int, rows: int = 1 << 16):
    """Joins cells whose rows (r, depth, pa, pb, e, side, fp) come one after another; small cells share a pass."""
    tries = Tries(errors)

    def emit(cells: list) -> pa.RecordBatch:
        turned = [tuple(np.sort(tries.turned(np.array(x, np.int64).view(np.uint64), key[0])) if x else None for x in side) for key, *side in cells]
        forest = Forest()
        keys = np.array([c[0] for c in cells], np.int64)
        some = [k for k, s in enumerate(turned) if s[0] is not None and (len(s[0]) > 1 or s[1] is not None) and (cells[k][0][5] == 0 or s[1] is not None)]
        for order in range(tries.blocks):
            mine = [k for k in some if cells[k][0][0] == order]
            if mine:
                back = np.uint64((BITS - tries.shift[order]) % BITS)
                for a, b in join_cells(tries, keys[mine, 0], keys[mine, 1], keys[mine, 4], [turned[k][0] for k in mine], [turned[k][1] for k in mine]):
                    a, b = ((x if not back else x << back | x >> np.uint64(BITS) - back).view(np.int64) for x in (a, b))
                    forest.add(a, b)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in forest.kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list = []
        held, last = 0, None
        for batch in batches:
            for *key, side, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if held >= rows:
                        yield emit(cells)
                        cells, held = [], 0
                    cells.append(([*key, side], [], []))
                    last = key
                cells[-1][2 if side == 2 else 1].append(fp)
                held += 1
        if cells:
            yield emit(cells)

    return run


_CELL = ("r", "depth", "pa", "pb", "e")


def cells_of(fps: DataFrame, tries: Tries, bound: int, step: int = 4) -> DataFrame:
    """r, depth, pa, pb, e, side, fp: distinct fingerprints dealt to cells of at most `bound` rows, where bits are left.

    A cell is a pair of nodes by their paths pa and pb, with e errors between them; side says of which node a row is
    (0: both are one node). Cells begin with a node paired with itself below each block order's first block.
    """
    orders = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(tries.shift[r]).alias("s"), F.lit(tries.first[r]).alias("depth")) for r in range(tries.blocks)))
    rows = fps.select("fp", F.explode(orders).alias("o")).select("fp", "o.r", "o.s", "o.depth")
    rows = rows.withColumn("t", F.expr("CASE WHEN s = 0 THEN fp ELSE shiftleft(fp, s) | shiftrightunsigned(fp, 64 - s) END"))
    rows = rows.withColumn("pa", F.expr("shiftrightunsigned(t, 64 - depth)"))
    rows = rows.select("r", "depth", "pa", F.col("pa").alias("pb"), F.lit(0).alias("e"), F.lit(0).alias("side"), "fp", "t")
    ready = None
    while True:
        sizes = rows.groupBy(*_CELL).agg(F.count("*").alias("_n"))
        large = sizes.where((F.col("_n") > bound) & (F.col("depth") < BITS - step))
        if large.isEmpty():
            part = rows.drop("t")
            return part if ready is None else ready.unionByName(part)
        rows = written(rows)
        sizes = rows.groupBy(*_CELL).agg(F.count("*").alias("_n"), F.count(F.when(F.col("side") != 2, 1)).alias("_na"), F.count(F.when(F.col("side") == 2, 1)).alias("_nb"))
        key = F.xxhash64(*_CELL).alias("_cell")
        sized = salted_join(rows.withColumn("_cell", key), sizes.select(*(F.col(c).alias(f"_{c}") for c in _CELL), "_n", "_na", "_nb", key), "_cell", "_n")
        sized = sized.where(" AND ".join(f"{c} = _{c}" for c in _CELL)).where("(side = 0 AND _n > 1) OR (_na > 0 AND _nb > 0)")
        sized = written(sized.withColumn("_large", (F.col("_n") > bound) & (F.col("depth") < BITS - step)).select(*_CELL, "side", "fp", "t", "_large"))
        discard(rows)
        part = sized.where("NOT _large").select(*_CELL, "side", "fp")
        ready = part if ready is None else ready.unionByName(part)
        budgets = F.array(*(F.array(*map(F.lit, b)) for b in tries.budget))
        mine = F.expr(f"CAST(shiftrightunsigned(t, 64 - depth - {step}) & {(1 << step) - 1} AS BIGINT)")
        wide = sized.where("_large").select("*", mine.alias("x"), F.explode(F.array(*(F.lit(y).cast("long") for y in range(1 << step)))).alias("y"))
        wide = wide.withColumn("e2", (F.col("e") + F.expr("bit_count(x ^ y)")).cast("int")).where(F.col("e2") <= budgets[F.col("r")][F.col("depth") + step])
        # side 0: its own child with itself, and with each other child, the lesser path first.
        new_side = F.expr("CASE WHEN side = 0 AND x = y THEN 0 WHEN side = 0 AND x > y THEN 2 WHEN side = 0 THEN 1 ELSE side END").cast("int")
        down = lambda path, bit: F.expr(f"shiftleft({path}, {step}) | {bit}")
        swap = F.expr("side = 2 OR (side = 0 AND x > y)")
        rows = wide.select(
            "r", (F.col("depth") + step).alias("depth"), F.when(swap, down("pa", "y")).otherwise(down("pa", "x")).alias("pa"), F.when(swap, down("pb", "x")).otherwise(down("pb", "y")).alias("pb"),
            F.col("e2").alias("e"), new_side.alias("side"), "fp", "t",
        )


def links(fps: DataFrame, errors: int = 4, bound: int = 200_000) -> DataFrame:
    """(a, b) links that span what links of at most `errors` differing bits connect, of distinct fps(fp)."""
    cells = cells_of(fps, Tries(errors), bound)
    dealt = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return dealt.select(*_CELL, "side", "fp").mapInArrow(_join(errors), "a long, b long")


def simhash_near_duplicates(docs: DataFrame, errors: int = 4, words: int = 4, bound: int = 200_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs(doc_id, text).

    Rows are linked if their fingerprints differ in at most `errors` bits; component_id is the smallest doc_id that
    links reach. Texts that are null or have no word have fingerprint 0 and are linked like any other. Equal texts
    and equal fingerprints are one leaf of the trie, whatever their number. Rows with a null doc_id take part; a
    component of only such rows has a null component_id. Repeated rows give equal rows. An empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    light = written(rows.mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    leaves = written(light.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")), False)
    found = written(links(leaves.select("fp"), errors, bound))
    roots = components(found)
    known = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = written(known, False)
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_m"))
    by_fp = salted_join(known, least, "root", "_m").select("fp", "component_id", "_n")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return salted_join(light, by_fp, "fp", "_n").select("doc_id", digits, "component_id")
