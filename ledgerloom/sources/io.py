"""Readers and writers of stored tables, exports and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "block": "block_hash string, prev_hash string, height int, ntime bigint, nbits bigint, version int, size bigint",
    "tx": "txid string, height int, tx_index int, version int, lock_time bigint, raw_len bigint",
    "tx_in": "txid string, vin int, prev_txid string, prev_vout bigint, script_sig binary, sequence bigint, is_coinbase boolean",
    "tx_out": "txid string, vout int, value bigint, script binary, addresses array<string>",
}


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table by its fixed schema; rows at negative heights are filtered in the scan."""
    df = spark.read.schema(SCHEMAS[table]).parquet(path)
    return df.where("height >= 0") if table == "tx" else df


def write_daily(daily: DataFrame, path: str) -> None:
    """One partition per date; only the dates in daily are replaced."""
    daily.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_snapshot(snapshot: DataFrame, path: str, as_of_height: int) -> None:
    snapshot.withColumn("as_of_height", F.lit(as_of_height)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_height").parquet(path)


def export_txids(tx: DataFrame, path: str) -> None:
    tx.select(F.col("txid").cast("string").alias("value")).distinct().write.mode("overwrite").text(path)


def export_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """df with the fields (name -> type) of a JSON column; what is missing or broken is 0."""
    parsed = F.from_json(column, ", ".join(f"`{n}` {t}" for n, t in fields.items()))
    return df.withColumns({n: F.coalesce(parsed[n], F.lit(0).cast(t)) for n, t in fields.items()})


def write_events(stream: DataFrame, path: str, checkpoint: str):
    """The typed feed as JSON files; a started query that stops when its input is read."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
