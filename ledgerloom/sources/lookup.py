"""Tables for lookups by key: sorted, with Bloom filters, so that a few keys touch a few row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many keys or fewer are written into the scan's filter; Spark pushes lists of up to ten values down as equalities.
MOST_KEYS, IN_LIST = 500, 10


def write_sorted(df: DataFrame, path: str, key: str, rows_a_file: int = 5_000_000, group_bytes: int = 8 << 20) -> None:
    """df as Parquet, dealt to files by ranges of the key and sorted by it, with row groups of about group_bytes.

    A row group's least and greatest key tell most lookups that it can't have theirs, its Bloom filter nearly all others.
    """
    n = max(1, -(-df.count() // rows_a_file))
    ordered = df.repartitionByRange(n, key).sortWithinPartitions(key)
    options = {"parquet.block.size": group_bytes, "parquet.page.size": 64 << 10, f"parquet.bloom.filter.enabled#{key}": "true"}
    ordered.write.options(**options).parquet(path)


def rows_of(spark: SparkSession, path: str, asked: DataFrame, key: str, most: int = MOST_KEYS) -> DataFrame:
    """The rows of a table by write_sorted whose key asked(key) names, each once however often it is asked for.

    Up to `most` keys stand in the scan as equalities that skip files, row groups and pages; more are joined.
    """
    table = spark.read.parquet(path)
    keys = asked.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in keys.limit(most + 1).collect()]
    if len(few) > most:
        return table.join(keys, key, "left_semi")
    if not few:
        return table.limit(0)
    few.sort()
    return table.where(reduce(lambda a, b: a | b, (F.col(key).isin(few[k : k + IN_LIST]) for k in range(0, len(few), IN_LIST))))
