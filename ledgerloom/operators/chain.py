"""Chain operators: cumulative work, the best tip, the canonical chain, forks and reorganisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import block_work
from ..plans.scratch import discard, written


#: Pointer doubling ends within this many rounds, unless the links form a cycle.
_MOST_ROUNDS = 64
#: So many doublings of sums pass a trillion blocks, and in a cycle end before the sums overflow.
_MOST_DOUBLINGS = 40


def _followed(now: DataFrame) -> DataFrame:
    """Blocks (block_hash, up, work, hops) moved on by what the block at `up` knows; those at a root stay as they are."""
    above = now.select(F.col("block_hash").alias("up"), F.col("up").alias("_up"), F.col("work").alias("_w"), F.col("hops").alias("_h"))
    summed = (F.col("work") + F.col("_w")).cast("decimal(38,0)").alias("work")
    moved = now.where("up IS NOT NULL").join(above, "up").select("block_hash", F.col("_up").alias("up"), summed, (F.col("hops") + F.col("_h")).alias("hops"))
    return now.where("up IS NULL").unionByName(moved)


def _doubled(now: DataFrame) -> DataFrame:
    """now with each block's sums up to its root, by doublings of all blocks, two to a round."""
    for _ in range(_MOST_DOUBLINGS // 2):
        if now.where("up IS NOT NULL").isEmpty():
            return now
        before, now = now, written(_followed(_followed(now)), False)
        discard(before)
    raise ValueError("the links between blocks form a cycle")


def _rooted(now: DataFrame, few: int, level: int = 0) -> DataFrame:
    """now with each block's sums up to its root: one block in eight, by its hash, is a mark at which the others stop.

    Stretches between marks are short, so a few doublings reach them, each of those only that aren't there yet. The
    marks alone, an eighth of the blocks, are taken on in the same way; at `few` blocks all are doubled.
    """
    n = now.count()
    if n <= few:
        return _doubled(now)
    mark = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(8)) == 0
    active = F.col("up").isNotNull() & ~mark("up")
    for _ in range(_MOST_DOUBLINGS):
        going = now.where(active)
        if going.isEmpty():
            break
        # What is pointed to is no mark.
        above = now.where(~mark("block_hash")).select(F.col("block_hash").alias("up"), F.col("up").alias("_up"), F.col("work").alias("_w"), F.col("hops").alias("_h"))
        summed = (F.col("work") + F.col("_w")).cast("decimal(38,0)").alias("work")
        moved = going.join(above, "up").select("block_hash", F.col("_up").alias("up"), summed, (F.col("hops") + F.col("_h")).alias("hops"))
        before, now = now, written(now.where(~active).unionByName(moved), False)
        discard(before)
    else:
        raise ValueError("the links between blocks form a cycle")
    marks = written(now.where(mark("block_hash")), False)
    if marks.count() * 2 > n:
        return _doubled(now)
    ends = _rooted(marks, few, level + 1)
    above = ends.select(F.col("block_hash").alias("up"), F.col("work").alias("_w"), F.col("hops").alias("_h"))
    rest = now.where("up IS NOT NULL").join(above, "up")
    done = rest.select("block_hash", F.lit(None).cast(now.schema["up"].dataType).alias("up"), (F.col("work") + F.col("_w")).cast("decimal(38,0)").alias("work"), (F.col("hops") + F.col("_h")).alias("hops"))
    rows = written(now.where("up IS NULL").unionByName(done), False)
    discard(now, ends)
    return rows


def cumulative_work(chain: DataFrame, few: int = 100_000) -> DataFrame:
    """(block_hash, prev_hash, height, work) of all blocks that reach a block without prev_hash, by pointer doubling.

    After k doublings a block knows the sum over up to 2**k ancestors; of more than `few` blocks only those between
    marks are doubled, and then the marks, so that the rows moved grow with the blocks alone. A block whose ancestor is missing is left out; a cycle is an error, and so is a block whose work is not
    defined: none of its descendants could be compared. Each round is written, so that no plan grows with the depth.
    """
    work = F.coalesce(block_work(F.col("nbits")), F.raise_error(F.concat(F.lit("no work is defined for the target of block "), F.col("block_hash"))).cast("decimal(38,0)"))
    now = written(chain.select("block_hash", F.col("prev_hash").alias("up"), work.alias("work"), F.lit(1).cast("long").alias("hops")), False)
    now = _rooted(now, few)
    rooted = now.join(chain.select("block_hash", "prev_hash"), "block_hash")
    return rooted.select("block_hash", "prev_hash", (F.col("hops") - 1).alias("height"), "work")


def childless(chain: DataFrame) -> DataFrame:
    parents = chain.select(F.col("prev_hash").alias("_p"))
    return chain.join(parents, F.col("block_hash") == F.col("_p"), "left_anti")


def best_tip(worked: DataFrame) -> DataFrame:
    """The childless block of most work; of equal work the least hash."""
    return childless(worked).orderBy(F.desc("work"), "block_hash").limit(1)


def canonical_chain(worked: DataFrame) -> DataFrame:
    """(height, block_hash) of the best tip and its ancestors, of what cumulative_work gives.

    Up to the best tip's height a block that is alone at its height is one of them. Of heights with several blocks
    one is, which links tell: from the next height with a single block down, by jumps of 2**k steps within such heights.
    """
    best = best_tip(worked).select(F.col("block_hash").alias("_best"), F.col("height").alias("_top"))
    low = worked.crossJoin(F.broadcast(best)).where("height < _top OR block_hash = _best")  # best is one row
    alone = low.groupBy("height").agg(F.count("*").alias("_n"), F.min("block_hash").alias("block_hash")).withColumn("sure", F.col("_n") == 1)
    sure = written(alone.where("sure").select("height", "block_hash"), False)
    several = low.join(alone.where("NOT sure").select("height"), "height", "left_semi").select("height", "block_hash", "prev_hash")
    several = written(several, False)
    if several.isEmpty():
        return sure
    heads = worked.join(several.select(F.col("block_hash").alias("prev_hash")), "prev_hash", "left_semi").join(sure.select("block_hash"), "block_hash", "left_semi")
    marked = heads.select(F.col("prev_hash").alias("block_hash")).distinct()
    jump = several.join(several.select(F.col("block_hash").alias("_p")), F.col("prev_hash") == F.col("_p"), "left_semi").select("block_hash", F.col("prev_hash").alias("up"))
    jump = written(jump, False)
    for _ in range(_MOST_ROUNDS):
        marked = written(marked, False)
        if jump.isEmpty():
            break
        marked = marked.unionByName(marked.join(jump, "block_hash").select(F.col("up").alias("block_hash"))).distinct()
        step = jump.select(F.col("block_hash").alias("up"), F.col("up").alias("_up"))
        jump = written(jump.join(step, "up").select("block_hash", F.col("_up").alias("up")), False)
    else:
        raise ValueError("the links between blocks form a cycle")
    return sure.unionByName(several.join(marked, "block_hash", "left_semi").select("height", "block_hash"))


def fork_points(chain: DataFrame, canonical: DataFrame) -> DataFrame:
    """(tip_hash, tip_height, fork_hash, fork_height, depth) of each tip of a side branch, from the links, all tips at once.

    A tip's fork is its nearest ancestor on the canonical chain (height, block_hash), depth the number of blocks
    between them, the tip included. Jumps double within the side blocks, so a branch of n blocks takes log n rounds. A
    branch that doesn't reach the canonical chain has no row; side blocks that form a cycle are an error.
    """
    side = written(side_blocks(chain, canonical).select("block_hash", "prev_hash"), False)
    main = canonical.select(F.col("block_hash").alias("up"), F.col("height").alias("_main"))
    now = written(side.select("block_hash", F.col("prev_hash").alias("up"), F.lit(1).cast("long").alias("depth")).join(main, "up", "left"), False)
    met = [now.where("_main IS NOT NULL")]
    for _ in range(_MOST_ROUNDS):
        waiting = now.where("_main IS NULL")
        above = now.select(F.col("block_hash").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("_main").alias("_m"))
        moved = waiting.drop("_main").join(above, "up").select("block_hash", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_m").alias("_main"))
        moved = written(moved, False)
        if moved.isEmpty():
            break
        met.append(moved.where("_main IS NOT NULL"))
        # Those that have met the chain stay as places to jump to.
        now = written(now.where("_main IS NOT NULL").unionByName(moved), False)
    else:
        raise ValueError("the links between blocks form a cycle")
    rows = reduce(DataFrame.unionByName, met)
    tips = childless(chain).select(F.col("block_hash").alias("tip_hash"))
    joined = rows.join(tips, F.col("block_hash") == F.col("tip_hash"))
    return joined.select("tip_hash", (F.col("_main") + F.col("depth")).alias("tip_height"), F.col("up").alias("fork_hash"), F.col("_main").alias("fork_height"), "depth")


def side_blocks(chain: DataFrame, canonical: DataFrame) -> DataFrame:
    return chain.join(canonical.select("block_hash"), "block_hash", "left_anti")


def fork_point(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the greatest height at which two chains (height, block_hash) agree; null if nowhere."""
    return a.join(b, ["height", "block_hash"]).agg(F.max("height").alias("fork_height"))


def reorg_height(local_height: Column, remote_height: Column, same_hash: Column) -> Column:
    """The height to return to, or null: same_hash compares the remote chain's block at the lower tip with ours."""
    return F.when(remote_height < local_height, remote_height).when(~same_hash, local_height - 1)


def neighbours(canonical: DataFrame) -> DataFrame:
    """(height, block_hash, prev_block, next_block) by two equi-joins."""
    lower = canonical.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("prev_block"))
    upper = canonical.select((F.col("height") - 1).alias("height"), F.col("block_hash").alias("next_block"))
    return canonical.join(lower, "height", "left").join(upper, "height", "left")


def contiguity(heights: DataFrame) -> DataFrame:
    return heights.agg(F.min("height").alias("lowest"), F.max("height").alias("highest"), F.count("*").alias("n")).withColumn("complete", (F.col("lowest") == 0) & (F.col("n") == F.col("highest") + 1))
