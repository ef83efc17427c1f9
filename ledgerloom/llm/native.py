"""Small idioms of DataFrame expressions that the operators without Python code share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE_CLASS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of values the sum of those before it (0 for the first), or what merge makes of them from 0 on.

    Sums are built in chunks of 256, so that long arrays aren't copied once per element.
    """
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))
    last_chunk = lambda xs: F.floor((F.size(xs) - 1) / 256).cast("int")
    cut = lambda xs: F.transform(F.sequence(F.lit(0), last_chunk(xs)), lambda c: F.slice(xs, c * 256 + 1, F.lit(256)))

    def joined(inner: Column, before: Column) -> Column:
        own = lambda r: F.slice(r, F.lit(1), F.size(r) - 1)
        return F.flatten(F.transform(inner, lambda r, c: F.transform(own(r), lambda v: merge(v, F.get(before, c)))))

    return let(
        F.transform(let(values, cut), grow),
        lambda inner: let(grow(F.transform(inner, lambda r: F.element_at(r, -1))), lambda before: joined(inner, before)),
    )


#: Long texts are cut into chunks of this many code points before parts of them are taken out.
CHUNK = 4096


def chunks_of(text: Column) -> Column:
    """text in chunks of CHUNK code points: taking a part out of a string reads all that stands before it."""

    def cut(x: Column, n: int) -> Column:
        last = F.floor((F.length(x) - 1) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(x, i * n + 1, F.lit(n)))

    long = lambda x: F.flatten(F.transform(cut(x, 64 * CHUNK), lambda part: cut(part, CHUNK)))
    return let(text, lambda x: F.when(F.length(x) > CHUNK, long(x)).otherwise(F.array(x)))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, exclusive, of a text given by chunks_of."""
    first = F.floor(start / CHUNK).cast("int")
    count = F.floor(F.greatest(end - 1, start) / CHUNK).cast("int") - first + 1
    part = F.array_join(F.slice(chunks, first + 1, count), "")
    return F.substring(part, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))
