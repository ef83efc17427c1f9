"""Cumulative work of many blocks, which is taken from mark to mark."""

import random

import pytest

from ledgerloom.operators import chain as H

EASY = 0x1B0FFFFF
SCHEMA = "block_hash string, prev_hash string, nbits long"


@pytest.mark.parametrize("few", [4, 10_000])
def test_work_from_mark_to_mark(spark, few):
    """A long chain with branches, and blocks of an unknown root: the same heights whether marks are used or not."""
    draw = random.Random(7)
    parent = {"b0": None} | {f"b{k}": f"b{k - 1 if k % 9 else draw.randrange(k)}" for k in range(1, 700)} | {"z1": "nobody", "z2": "z1", "z3": "z2"}
    height = {"b0": 0}
    for k in range(1, 700):
        height[f"b{k}"] = height[parent[f"b{k}"]] + 1
    rows = H.cumulative_work(spark.createDataFrame([(b, p, EASY) for b, p in parent.items()], SCHEMA), few).collect()
    assert {r.block_hash: r.height for r in rows} == height
    one = next(r.work for r in rows if r.height == 0)
    assert all(r.work == one * (r.height + 1) for r in rows)


def test_a_cycle_is_an_error(spark):
    links = [("g", None), *((f"c{k}", f"c{(k + 1) % 40}") for k in range(40))]
    with pytest.raises(ValueError, match="cycle"):
        H.cumulative_work(spark.createDataFrame([(*x, EASY) for x in links], SCHEMA), 4)
