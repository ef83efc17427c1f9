"""The trie of conversation prefixes, by truncation peeling.

A rebuilt conversation is a path of turn digests. Spark deals the paths out in lexicographic ranges of bounded size;
in a task a range is peeled from its maximum depth down: at each depth the conversations that end there merge with
the nodes that survive from below, equal prefixes group, their node is complete and is emitted, its last turn is
stripped, and it goes on to the depth above as a child. So nodes are found and aggregated in the same pass.

A prefix of a range's first or last path may go on in a neighbouring range. What a range knows of those nodes becomes
one row for each end, a path with counts for each depth. These rows, two for a range, are peeled in the same way,
in ranges again while they are many, and last in one; so a prefix that a third of all conversations share is
split over as many tasks as its conversations need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, written

#: Bytes of a turn's digest.
WIDTH = 32
_EMPTY = hashlib.sha256(b"").hexdigest()
_HEAD = "array<struct<depth:int,n:long,first:long,children:long,leaves:long,saved:long>>"
_SQL = (
    "kind string, conv_id long, depth long, parent_conv_id long, parent_id binary, node_id binary, n_convs long, n_children long, n_leaves long, "
    f"saved_tokens long, ends_sha256 string, path binary, chars binary, counts {_HEAD}, place long, ids string"
)
_LEVEL = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]))
_ARROW = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_id", pa.binary()), ("node_id", pa.binary()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.binary()), ("chars", pa.binary())]
    + [("counts", _LEVEL), ("place", pa.int64()), ("ids", pa.string())]
)


def crc_of(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary"))


def rebuilt_conversations(conversations: DataFrame, group: int = 100, most_heads: int = 6) -> DataFrame:
    """conv_id, path (binary, WIDTH bytes a turn), chars (array<int>, code points of each turn's text) of each conversation.

    The first h turns are those of the group's first conversation, h by the conv_id's checksum; the rest are its own
    turns after its first h.
    """
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    named = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    turn = F.struct(conversations["turn"].cast("long").alias("turn"), F.sha2(named.cast("binary"), 256).alias("digest"), F.length(text("text")).alias("chars"))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = written(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns")), False)
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most_heads - 1).alias("_head"))
    h = (crc_of(F.col("conv_id")) % most_heads).cast("int")
    both = own.withColumn("_of", F.col("conv_id") - F.col("conv_id") % group).join(base, F.col("_of") == F.col("_base"), "left")
    none = F.array().cast("array<struct<digest:string,chars:int>>")
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    made = both.select("conv_id", turns.alias("turns"))
    return made.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.chars").alias("chars"))


class Paths:
    """Sorted paths of a range, and for each the number of turns that it shares with the one before it."""

    def __init__(self, paths: list[bytes], chars: list[np.ndarray]) -> None:
        self.paths, self.chars = paths, chars
        self.length = np.array([len(p) // WIDTH for p in paths], np.int64)
        self.shared = np.zeros(len(paths), np.int64)
        for i in range(1, len(paths)):
            self.shared[i] = self._common(paths[i - 1], paths[i])
        self.shared[:1] = -1
        self.at = np.zeros(len(paths) + 1, np.int64)
        np.cumsum(self.length, out=self.at[1:])
        self.all_chars = np.concatenate(chars) if chars else np.zeros(0, np.int64)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b)) // WIDTH
        if a[: n * WIDTH] == b[: n * WIDTH]:
            return n
        x, y = (np.frombuffer(p, f"V{WIDTH}", n) for p in (a, b))
        return int(np.argmax(x != y))

    def ids(self, row: int) -> list[bytes]:
        """The name of each prefix of a path, the empty one first."""
        h, out = hashlib.sha256(), []
        out.append(h.digest())
        for k in range(int(self.length[row])):
            h.update(self.paths[row][k * WIDTH : (k + 1) * WIDTH])
            out.append(h.copy().digest())
        return out


def peel(p: Paths, rows: np.ndarray, depths: np.ndarray, counts: np.ndarray, ended: dict | None, ends_open: bool, chunk: int = 1 << 16) -> Iterator[dict]:
    """Records of the nodes of a range.

    counts has a row (n, first, children, leaves, saved) for each place (rows, depths), what is known of the prefix of
    that depth of that path beside deeper places. ended gives the ids of conversations that end at a row. If ends_open,
    prefixes of the first and the last path aren't complete.
    """
    last = len(p.paths) - 1
    left = p.ids(0) if ends_open else []
    right = p.ids(last) if ends_open else []
    known: dict[int, list[bytes]] = {}
    chains: tuple[list, list] = ([], [])
    order = np.argsort(-depths, kind="stable")
    rows, depths, counts = rows[order], depths[order], counts[order]
    # Columns of what comes up from below: the row of its first path, n, first, children, leaves, saved, and 1 for a
    # complete node, 2 for the place of one that is open, whose counts stay with its own depth.
    alive = np.zeros((0, 7), np.int64)
    below: dict | None = None
    top = int(p.length.max(initial=0))
    bound = np.searchsorted(-depths, np.arange(-top, 2), "left")
    for d in range(top, -1, -1):
        here = slice(bound[top - d], bound[top - d + 1])
        fresh = np.column_stack((rows[here], counts[here], np.zeros(here.stop - here.start, np.int64)))
        items = np.concatenate((alive, fresh))
        if not len(items):
            continue
        items = items[np.lexsort((-items[:, 6], items[:, 0]))]
        row, kind = items[:, 0], items[:, 6]
        new = np.ones(len(items), bool)
        new[1:] = (row[1:] != row[:-1]) & (p.shared[row[1:]] < d)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n, leaves, saved = (np.add.reduceat(items[:, k], start) for k in (1, 4, 5))
        first = np.minimum.reduceat(items[:, 2], start)
        children = np.add.reduceat(np.where(kind == 1, 1, items[:, 3]), start)
        at = row[start]
        state = np.zeros(len(start), np.int8)  # 1: open to the left, 2: open to the right
        if ends_open:
            if p.length[last] >= d:
                state[-1] = 2
            if at[0] == 0:
                state[0] = 1
        if below is not None:
            # The children, in the order of their rows, meet their parents' groups.
            parent = group[kind == 1]
            yield from _nodes(below, d + 1, first[parent], state[parent], tuple(x[d] if d < len(x) else None for x in (left, right)))
        for k in {0, len(start) - 1}:
            if state[k] and n[k]:
                chains[state[k] - 1].append((d, int(n[k]), int(first[k]), int(children[k]), int(leaves[k]), int(saved[k])))
        done = state == 0
        ends: list[str | None] = [None] * len(start)
        names: list[bytes | None] = [None] * len(start)
        if ended is not None:
            for g, r in zip(group[kind == 0].tolist(), row[kind == 0].tolist(), strict=True):
                ends[g] = ended[r]  # equal paths are one row
            for g in np.flatnonzero(~done).tolist():
                if ends[g] is not None:
                    yield from _chunks((left if state[g] == 1 else right)[d], ends[g], chunk)
        else:
            for g in np.flatnonzero(done).tolist():
                if (r := int(at[g])) not in known:
                    known[r] = p.ids(r)
                names[g] = known[r][d]
        chars = p.all_chars[p.at[at] + d - 1] if d else np.zeros(len(at), np.int64)
        leaves = np.where(children == 0, 1, leaves)
        saved = saved + (n - 1) * chars
        keep = np.flatnonzero(done)
        digest = [None if ended is None else _EMPTY if ends[g] is None else hashlib.sha256(ends[g].encode()).hexdigest() for g in keep.tolist()]
        below = {"conv_id": first[keep], "n_convs": n[keep], "n_children": children[keep], "n_leaves": leaves[keep], "saved_tokens": saved[keep], "ends_sha256": digest, "node_id": [names[g] for g in keep.tolist()]}
        up = np.column_stack((at, n, first, children, leaves, saved, np.ones(len(at), np.int64)))
        up[~done, 1:] = (0, np.iinfo(np.int64).max, 0, 0, 0, 2)
        alive = up
    if below is not None:
        yield from _nodes(below, 0, None, None, (None, None))
    for side, levels in enumerate(chains):
        if levels:
            r = 0 if side == 0 else last
            d = levels[0][0]
            yield {"kind": "chain", "path": p.paths[r][: d * WIDTH], "chars": p.chars[r][:d].astype("<i4").tobytes(), "counts": [dict(zip(("depth", "n", "first", "children", "leaves", "saved"), x, strict=True)) for x in levels]}


def _nodes(below: dict, depth: int, parents, state, ids: tuple) -> Iterator[dict]:
    """Complete nodes of one depth: with the parent's conv_id if it is complete too, else with its name."""
    for k in range(len(below["conv_id"])):
        open_ = 0 if state is None else int(state[k])
        yield {
            "kind": "node", "conv_id": int(below["conv_id"][k]), "depth": depth, "parent_conv_id": None if parents is None or open_ else int(parents[k]), "parent_id": ids[open_ - 1] if open_ else None,
            "node_id": below["node_id"][k], "n_convs": int(below["n_convs"][k]), "n_children": int(below["n_children"][k]), "n_leaves": int(below["n_leaves"][k]),
            "saved_tokens": int(below["saved_tokens"][k]), "ends_sha256": below["ends_sha256"][k],
        }


def _chunks(node: bytes, ids: str, size: int) -> Iterator[dict]:
    """The ids that end at an open node, as records of about `size` characters, cut at commas."""
    while ids:
        cut = ids.find(",", size)
        part, ids = (ids, "") if cut < 0 else (ids[:cut], ids[cut + 1 :])
        yield {"kind": "ends", "node_id": node, "place": int(part.split(",", 1)[0]), "ids": part}


def _batches(records: Iterator[dict], rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for r in records:
        held.append(r)
        held_bytes += len(r.get("ids") or "") + len(r.get("path") or b"") + 48 * len(r.get("counts") or ())
        if len(held) >= rows or held_bytes > size:
            yield pa.RecordBatch.from_arrays([pa.array([x.get(f.name) for x in held], f.type) for f in _ARROW], schema=_ARROW)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x.get(f.name) for x in held], f.type) for f in _ARROW], schema=_ARROW)


def _peel_conversations(ends_open: bool):
    """Peels conversations (conv_id, path, chars), sorted by path and conv_id; equal paths count as one with several ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, chars, n, first, ended = [], [], [], [], []
        for batch in batches:
            for conv, path, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if paths and paths[-1] == path:
                    n[-1] += 1
                    first[-1] = min(first[-1], conv)
                    ended[-1].append(conv)
                else:
                    paths.append(path)
                    chars.append(sizes.values.to_numpy(zero_copy_only=False).astype(np.int64))
                    n.append(1)
                    first.append(conv)
                    ended.append([conv])
        if not paths:
            return
        p = Paths(paths, chars)
        zero = np.zeros(len(paths), np.int64)
        counts = np.column_stack((np.array(n, np.int64), np.array(first, np.int64), zero, zero, zero))
        ids = {i: ",".join(map(str, e)) for i, e in enumerate(ended)}
        yield from _batches(peel(p, np.arange(len(paths)), p.length, counts, ids, ends_open))

    return run


def _peel_chains(ends_open: bool):
    """Peels rows (path, chars, counts) that stand for the open ends of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, chars, rows, depths, counts = [], [], [], [], []
        for batch in batches:
            for path, sizes, levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not paths or paths[-1] != path:
                    paths.append(path)
                    chars.append(np.frombuffer(sizes, "<i4").astype(np.int64))
                for x in levels:
                    rows.append(len(paths) - 1)
                    depths.append(x["depth"])
                    counts.append((x["n"], x["first"], x["children"], x["leaves"], x["saved"]))
        if paths:
            yield from _batches(peel(Paths(paths, chars), np.array(rows, np.int64), np.array(depths, np.int64), np.array(counts, np.int64), None, ends_open))

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node_id, ends_sha256) of chunks (node_id, place, ids) that come sorted by node_id and place."""
    node, h, out = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name == node:
                h.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((node, h.hexdigest()))
            node, h = name, hashlib.sha256(ids.encode())
            if len(out) > 5000:
                yield pa.RecordBatch.from_pydict({"_node": [x[0] for x in out], "_ends": [x[1] for x in out]})
                out = []
    if node is not None:
        out.append((node, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["_node", "_ends"])


def prefix_trie(conversations: DataFrame, turns_a_range: int = 500_000) -> DataFrame:
    """One row for each distinct prefix, or node, of rebuilt conversations(conv_id, turn, role, text).

    conv_id, the node's smallest member; depth, its number of turns; parent_conv_id, the parent's conv_id, null for the
    root; n_convs, members; n_children; n_leaves, childless nodes in its subtree, itself included; saved_tokens, the
    sum over its subtree of (n_convs - 1) times the code points of the node's last text; ends_sha256, of the
    members' ids that end here.

    Turns of a conversation come in the order of turn, null first, then of the SHA-256 digest of role and text; a null
    role or text counts as empty; a repeated row is a turn more. Rows without a conv_id belong to no conversation and
    are left out. Turns are equal if the SHA-256 digests of role and text are. An empty table gives no rows; other
    columns, whatever their names, are ignored. A conversation must fit into a row as digests, about 100 bytes a turn,
    and may have any depth: the rounds do not follow the depth.
    """
    made = written(rebuilt_conversations(conversations))
    turns, convs = made.agg(F.sum(F.size("chars") + 1), F.count("*")).first()
    n = max(1, -(-(turns or 0) // turns_a_range))
    dealt = made.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = written(dealt.mapInArrow(_peel_conversations(True), _SQL))
    discard(made)
    tables, chains = [found], found.where("kind = 'chain'")
    while True:
        size, levels = chains.agg(F.count("*"), F.sum(F.size("counts"))).first()
        small = (levels or 0) <= turns_a_range or size <= 4
        rows = chains.select("path", "chars", "counts")
        rows = rows.coalesce(1) if small else rows.repartitionByRange(-(-levels // turns_a_range), "path")
        more = written(rows.sortWithinPartitions("path").mapInArrow(_peel_chains(not small), _SQL), False)
        tables.append(more)
        if small:
            break
        chains = more.where("kind = 'chain'")
    done = found.where("kind = 'node'")
    late = None
    for t in tables[1:]:
        nodes = t.where("kind = 'node'")
        late = nodes if late is None else late.unionByName(nodes)
    ends = found.where("kind = 'ends'").select("node_id", "place", "ids").repartition("node_id").sortWithinPartitions("node_id", "place")
    ends = ends.mapInArrow(_hash_ends, "_node binary, _ends string")
    late = written(late.join(ends, F.col("node_id") == F.col("_node"), "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(_EMPTY))).drop("_node", "_ends"), False)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    parents = late.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    every = done.unionByName(late)
    waiting = every.where("parent_id IS NOT NULL").drop("parent_conv_id").select("parent_id", *(c for c in columns if c != "parent_conv_id"))
    met = salted_join(waiting, parents, "parent_id", "_rows")
    return every.where("parent_id IS NULL").select(*columns).unionByName(met.select(*columns))
