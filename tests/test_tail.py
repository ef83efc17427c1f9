"""The orphan tail by hand: each transition, heights through captured parents, eviction by the tip, and a stream."""

import time

import pytest

from ledgerloom.streaming.tail import OrphanTail


class Tail:
    """A tail with Python lists as its feeds."""

    def __init__(self, spark, root, **options):
        self.spark, self.tail = spark, OrphanTail(spark, root, **options)

    def tick(self, captured, canonical, now):
        blocks = self.spark.createDataFrame([(*c, now) if len(c) == 2 else c for c in captured], "block_hash string, prev_hash string, seen long")
        self.tail.tick(blocks, self.map(canonical), now)
        return {r.block_hash: (r.height, r.state) for r in self.tail.table("records").collect()}

    def map(self, canonical):
        return self.spark.createDataFrame(list(canonical), "height long, block_hash string")

    def changes(self):
        return [(r.block_hash, r.was, r.state) for r in self.tail.table("changes").orderBy("tick", "block_hash").collect()]


@pytest.fixture
def tail(spark, tmp_path):
    return Tail(spark, str(tmp_path), retain=20, settle=5)


def main(top, **other):
    """The map B0 .. B<top>, with other blocks at some heights."""
    return [(h, other.get(f"h{h}", f"B{h}")) for h in range(top + 1)]


def test_a_side_branch_takes_its_heights_from_its_parents(tail):
    """A branch of six, captured in any order: only its first block's parent is canonical."""
    branch = [("X6", "B5"), ("X7", "X6"), ("X8", "X7"), ("X9", "X8"), ("X10", "X9"), ("X11", "X10")]
    got = tail.tick([branch[k] for k in (3, 0, 5, 1, 4, 2)], main(8), 100)
    assert got == {f"X{h}": (h, "orphan" if h <= 8 else "pending") for h in range(6, 12)}
    got = tail.tick([("Y12", "X11")], main(11), 130)  # the parent is a record of an earlier tick
    assert got["Y12"] == (12, "pending") and got["X11"] == (11, "orphan")


def test_states_follow_the_map_both_ways(tail):
    assert tail.tick([("B6", "B5"), ("X6", "B5")], main(5), 100) == {"B6": (6, "pending"), "X6": (6, "pending")}
    assert tail.tick([], main(6), 110) == {"B6": (6, "canonical"), "X6": (6, "orphan")}
    assert tail.tick([], main(7, h6="X6"), 120) == {"B6": (6, "orphan"), "X6": (6, "canonical")}  # a demotion and a promotion
    assert tail.tick([("B6", "B5")], main(6), 130) == {"B6": (6, "canonical"), "X6": (6, "orphan")}
    assert tail.changes()[:4] == [("B6", None, "pending"), ("X6", None, "pending"), ("B6", "pending", "canonical"), ("X6", "pending", "orphan")]


def test_waiting_ends_as_unresolved(tail):
    """A block ahead of the map and one of unknown parent wait for 600 seconds after they were seen, not after the last tick."""
    first = [("A7", "B6"), ("Z", "nobody")]
    assert tail.tick(first, main(6), 1000) == {"A7": (7, "pending"), "Z": (None, "pending")}
    assert tail.tick(first, main(6), 1600) == {"A7": (7, "pending"), "Z": (None, "pending")}
    # Unresolved is evicted with what lies far below the tip, unknown heights before all.
    assert tail.tick([], main(6), 1601) == {"A7": (7, "unresolved")}
    assert tail.tick([("child", "A7")], main(6), 1602)["child"] == (None, "pending")  # an unresolved parent lends no height
    assert tail.tick([], main(7), 1700) == {"A7": (7, "orphan"), "child": (8, "pending")}  # the map settles it all the same
    assert ("Z", "pending", "unresolved") in tail.changes()


def test_a_late_parent_gives_heights_to_what_waited(tail):
    got = tail.tick([("X8", "X7"), ("X9", "X8")], main(6), 100)
    assert got == {"X8": (None, "pending"), "X9": (None, "pending")}
    assert tail.tick([("X7", "B6")], main(8), 300) == {"X7": (7, "orphan"), "X8": (8, "orphan"), "X9": (9, "pending")}


def test_eviction_goes_by_the_tip_and_spares_what_is_pending(tail):
    tail.tick([("X5", "B4"), ("B5", "B4"), ("X9", "B8")], main(9), 100)
    assert set(tail.tick([], main(25), 5000)) == {"X5", "B5", "X9"}
    assert set(tail.tick([], main(26), 9000)) == {"X9"}  # 5 is more than 20 below 26, whatever the time
    assert {(r.block_hash, r.height) for r in tail.tail.table("orphans").collect()} == {("X5", 5), ("X9", 9)}  # the log keeps them
    gap = [r for r in main(60) if r[0] != 30]
    tail.tick([("P30", "B29")], gap[:40], 9100)
    assert tail.tick([], gap, 9200)["P30"] == (30, "pending")


def test_orphans_are_read_from_the_map(tail):
    tail.tick([("X5", "B4"), ("B5", "B4")], main(6), 100)
    assert [r.block_hash for r in tail.tail.orphans(tail.map(main(6))).collect()] == ["X5"]
    assert [r.block_hash for r in tail.tail.orphans(tail.map(main(6, h5="X5"))).collect()] == ["B5"]


def test_a_stream_ticks_without_blocks(spark, tmp_path):
    """Two files of captured blocks, then only the clock: what waits becomes unresolved."""
    made = Tail(spark, f"{tmp_path}/tail", retain=20, patience=3)
    now = int(time.time())
    for k, rows in enumerate(([("X5", "B4", now), ("B5", "B4", now)], [("A7", "B6", now)])):
        spark.createDataFrame(rows, "block_hash string, prev_hash string, seen long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema("block_hash string, prev_hash string, seen long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    q = made.tail.follow(stream, lambda: made.map(main(6)), f"{tmp_path}/ck", "1 second")
    try:
        for _ in range(60):
            if q.exception() or made.tail.table("records").where("state = 'unresolved'").count():
                break
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    got = {r.block_hash: (r.height, r.state) for r in made.tail.table("records").collect()}
    assert got == {"X5": (5, "orphan"), "B5": (5, "canonical"), "A7": (7, "unresolved")}
