"""Readers and sinks of the feed's files.

A vendor's bars are parallel arrays in one JSON object for each symbol; ticks are (gzipped) JSON lines
in a folder for each day. Rows that cannot be read are skipped, as the schemas are fixed.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAYLOAD = "symbol string, t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<bigint>"


def read_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, o, h, l, c, v of payloads with parallel arrays; bars with a missing number go."""
    rows = spark.read.schema(_PAYLOAD).option("multiLine", True).json(path)
    rows = rows.select("symbol", F.inline(F.arrays_zip("t", "o", "h", "l", "c", "v")))
    return rows.dropna().select("symbol", F.timestamp_seconds("t").alias("ts"), "o", "h", "l", "c", "v")


def read_ticks_json(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of ticks in <day>/<SYMBOL>.json(.gz): symbol and d come from the path."""
    rows = spark.read.schema("time string, price string, vol string, side string, acc string").json(path)
    name = F.split(F.col("_metadata.file_path"), "/")
    rows = rows.withColumns({"symbol": F.regexp_replace(F.element_at(name, -1), r"\.json(\.gz)?$", ""), "d": F.to_date(F.element_at(name, -2))})
    clock = F.split("time", ":")
    return rows.withColumn("sec", (clock[0].cast("int") * 3600 + clock[1].cast("int") * 60 + clock[2].cast("int"))).drop("time")


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """symbol, company_name, exchange of enabled items, symbols trimmed and in upper case."""
    rows = spark.read.schema("items array<struct<symbol: string, company_name: string, exchange: string, enabled: boolean>>").option("multiLine", True).json(path)
    rows = rows.select(F.inline("items")).where("coalesce(enabled, true)")
    return rows.select(F.upper(F.trim("symbol")).alias("symbol"), "company_name", "exchange").where("symbol <> ''")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet by year, so that a range of dates reads few files; only the years at hand are replaced."""
    rows = bars.withColumn("year", F.year("d")).repartition("year")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON line a row, for pages that read it."""
    rows.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Settings:
    """Parameters of the daily jobs."""

    spike_vol_mult: float = 2.0
    spike_min_pct: float = 0.03
    p_min: float = 0.58
    max_bins: int = 60
    va_pct: float = 0.70
    windows: tuple[int, ...] = (10, 20, 40)

    def overlaid(self, *layers: dict) -> Settings:
        """Later layers win; unknown names are ignored."""
        known = {f.name for f in fields(self)}
        out = self
        for layer in layers:
            out = replace(out, **{k: v for k, v in layer.items() if k in known and v is not None})
        return out
