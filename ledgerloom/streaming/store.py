"""The live lane's stored state: tables under one commit log, and keyed runs that a batch reads in part.

A commit is one small file that names the data folders of all tables and the lane's own numbers. It is moved to its
place in one step once all it names is written, so tables change together or not at all, and what a crash left behind
is named by nothing. Cutting runs at a height is a commit that names the same folders with a lower bound.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys are dealt to so many slots; a run's buckets are a power of two of at most as many.
SLOTS = 1 << 16


def slot(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


@dataclass
class Run:
    """A folder of rows of heights lo to hi; the rows above hi, if the folder has any, are cut off.

    last is the greatest date, where rows have one. Rows lie in `buckets` folders by their key's slot, `empty` names
    those that don't exist. extra is what else a table says of a run.
    """

    path: str
    lo: int
    hi: int
    rows: int
    cut: bool = False
    last: str | None = None
    buckets: int = 1
    empty: list[int] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


class Files:
    """The few calls on the shared file system that the store needs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A new file, complete at once; an error if the name is taken."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        if self.fs.exists(self.path(name)) or not self.fs.rename(draft, self.path(name)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{name} was committed by another writer")


@dataclass
class Commit:
    version: int = 0
    watermark: int = -1
    #: Table name -> its runs.
    tables: dict[str, list[Run]] = field(default_factory=dict)

    def runs(self, table: str) -> list[Run]:
        return self.tables.get(table, [])


class Store:
    """Tables of runs under `root`. Only one writer may commit; any number may read."""

    def __init__(self, spark: SparkSession, root: str, rows_a_bucket: int = 500_000, most_runs: int = 8, sparing: int = 4) -> None:
        """A run has a bucket for each rows_a_bucket rows. More than most_runs runs are merged, those of up to
        `sparing` times the size of the younger ones' sum: a row is rewritten a logarithmic number of times."""
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        self.rows_a_bucket, self.most_runs, self.sparing = rows_a_bucket, most_runs, sparing

    # --- the log

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("log") if re.fullmatch(r"\d+\.json", n))

    def read(self, version: int | None = None) -> Commit:
        """The last commit, or that of a version; one of no tables at the start."""
        known = self.versions() if version is None else [version]
        if not known:
            return Commit()
        data = json.loads(self.files.text(f"log/{known[-1]:020d}.json"))
        return Commit(data["version"], data["watermark"], {k: [Run(**r) for r in v] for k, v in data["tables"].items()})

    def commit(self, was: Commit, watermark: int, tables: dict[str, list[Run]]) -> Commit:
        """The version after `was`, with the given tables in place of its own; an error if another writer came first."""
        made = Commit(was.version + 1, watermark, {**was.tables, **tables})
        text = json.dumps({"version": made.version, "watermark": watermark, "tables": {k: [asdict(r) for r in v] for k, v in made.tables.items()}})
        self.files.put(f"log/{made.version:020d}.json", text)
        return made

    def vacuum(self, keep: int = 10) -> int:
        """Remove all but the last `keep` versions and the data folders that those don't name; how many folders went.

        It must not run beside a writer: data that a commit is about to name looks like what a crash left.
        """
        known = self.versions()
        for v in known[:-keep]:
            self.files.remove(f"log/{v:020d}.json")
        named = {r.path.split("/")[1] for v in known[-keep:] for runs in self.read(v).tables.values() for r in runs}
        gone = [n for n in self.files.names("data") if n not in named]
        for n in gone:
            self.files.remove(f"data/{n}")
        self.files.remove("drafts")
        return len(gone)

    # --- runs

    def write(self, rows: DataFrame, lo: int, hi: int, key: str | None = None, dated: bool = False, n: int | None = None) -> list[Run]:
        """Rows as a new run, none if there are no rows. With a key they are dealt to buckets by it, and sorted.

        n, if known, is an upper bound of the number of rows.
        """
        path = f"data/{uuid.uuid4().hex}"
        buckets = 1
        if key:
            n = rows.count() if n is None else n
            while buckets < SLOTS and buckets * self.rows_a_bucket < n:
                buckets *= 2
        schema, empty, seen = rows.schema, [], Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max("date" if dated else F.lit(None).cast("string")).alias("last"))
        if buckets > 1:
            dealt = rows.withColumn("bucket", slot(key) % buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", key)
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{path}")
            there = {int(n.split("=")[1]) for n in self.files.names(path) if n.startswith("bucket=")}
            empty = sorted(set(range(buckets)) - there)
        else:
            (rows.repartition(1).sortWithinPartitions(key) if key else rows).write.parquet(f"{self.root}/{path}")
        try:
            count, last = seen.get["n"], seen.get["last"]
        except Py4JJavaError:  # a plan that was found to be empty reports nothing
            back = self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
            count, last = back.agg(F.count("*"), F.max("date") if dated else F.lit(None)).first()
        if not count:
            self.files.remove(path)
            return []
        return [Run(path, lo, hi, count, False, last, buckets, empty)]

    def rows(self, runs: list[Run], schema, slots: list[int] | None = None, height: str = "height") -> DataFrame:
        """The rows of runs, all or those of the given slots' buckets only: other buckets' folders aren't even listed."""
        found = None
        for r in runs:
            if r.buckets == 1:
                df = self.spark.read.schema(schema).parquet(f"{self.root}/{r.path}")
            else:
                wanted = range(r.buckets) if slots is None else sorted({s % r.buckets for s in slots})
                paths = [f"{self.root}/{r.path}/bucket={b}" for b in wanted if b not in set(r.empty)]
                if not paths:
                    continue
                df = self.spark.read.schema(schema).parquet(*paths)
            df = df.where(F.col(height) <= r.hi) if r.cut else df
            found = df if found is None else found.unionByName(df)
        return self.spark.createDataFrame([], schema) if found is None else found

    def rows_of(self, runs: list[Run], schema) -> DataFrame:
        """The rows of whole runs without buckets, however many, in one scan."""
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{r.path}" for r in runs))

    def merged(self, runs: list[Run], schema, key: str | None = None, dated: bool = False, better=None) -> list[Run]:
        """The runs, with young ones merged if they are many; `better` may thin out the rows that are merged."""
        if len(runs) <= self.most_runs:
            return runs
        runs = sorted(runs, key=lambda r: r.lo)
        at, total = len(runs) - 1, runs[-1].rows
        while at > 0 and runs[at - 1].rows <= self.sparing * total:
            at -= 1
            total += runs[at].rows
        at = min(at, len(runs) - 2)
        young = runs[at:]
        rows = self.rows(young, schema)
        made = self.write(better(rows) if better else rows, young[0].lo, max(r.hi for r in young), key, dated, sum(r.rows for r in young))
        return runs[:at] + made


def cut(runs: list[Run], height: int) -> list[Run]:
    """Runs without the rows above a height."""
    return [r if r.hi <= height else replace(r, hi=height, cut=True) for r in runs if r.lo <= height]


def slots_of(keys: DataFrame, key: str) -> list[int]:
    """The slots that keys name: at most SLOTS numbers, whatever the number of keys."""
    return [r[0] for r in keys.select(slot(key).alias("s")).distinct().collect()]
