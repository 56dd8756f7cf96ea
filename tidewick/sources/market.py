"""Daily bars and ticks, derived from the star-schema tables as stand-ins for a market feed.

Every price is an exponential of an integer running sum, so that two engines agree to the last digit
that is kept. The operators of this package take any DataFrames of these schemas:

    bars(symbol STRING, d DATE, o, h, l, c DOUBLE, v BIGINT)
    ticks(symbol STRING, d DATE, sec INT, price DOUBLE, vol BIGINT, side STRING, acc BIGINT)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Symbol that stands for the index.
INDEX = "S0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str, least: int, each: int) -> int:
    """How many symbols the tables stand for: one for every so many suppliers, so that they grow with the data and their histories do not."""
    return max(least, table(spark, sf_dir, "supplier").count() // each)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, d, seq, price, vol: one row per line item, walked in the order of its shipping date."""
    items = table(spark, sf_dir, "lineitem").withColumn("symbol", F.concat(F.lit("S"), (F.col("l_suppkey") % symbols(spark, sf_dir, 10, 10)).cast("string")))
    order = Window.partitionBy("symbol").orderBy(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    step = F.round(F.col("l_discount") * 100).cast("long") - 5
    return items.select(
        "symbol",
        F.col("l_shipdate").cast("date").alias("d"),
        F.row_number().over(order).alias("seq"),
        F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        (F.col("l_quantity") * 100).cast("long").alias("vol"),
    ).select("symbol", "d", "seq", F.round(20 * F.exp(F.col("cum").cast("double") * 0.004), 4).alias("price"), "vol")


def bars_of(rows: DataFrame) -> DataFrame:
    """Daily bars of trades: first, highest, lowest and last price, summed volume."""
    return rows.groupBy("symbol", "d").agg(
        F.min_by("price", "seq").alias("o"),
        F.max("price").alias("h"),
        F.min("price").alias("l"),
        F.max_by("price", "seq").alias("c"),
        F.sum("vol").alias("v"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(trades(spark, sf_dir))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d: the dates of bars(), without their trades being walked."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the event stream: the side from the event's type, price and size from its payload."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), (F.col("user_id") % symbols(spark, sf_dir, 5, 20)).cast("string")).alias("symbol"),
        F.col("ts").cast("date").alias("d"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("int").alias("sec"),
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_type",
    )
    order = Window.partitionBy("symbol").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("symbol", "d").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    vol = (1 + F.col("k") % 10) * 100
    kind = F.col("event_type")
    return events.select(
        "symbol",
        "d",
        "sec",
        (30 + F.lit(0.05) * F.sum(F.col("k") % 3 - 1).over(order).cast("double")).alias("price"),
        vol.alias("vol"),
        F.when(kind.isin("view", "purchase"), "PS").when(kind.isin("click", "error"), "PB").otherwise("ATC").alias("side"),
        F.sum(vol).over(day).alias("acc"),
    )


#: The same derivations as SQL.
TRADES_SQL = """
tr0 AS (
  SELECT 'S' || (l_suppkey % (SELECT greatest(10, count(*) // 10) FROM supplier)) AS symbol, CAST(l_shipdate AS date) AS d,
         row_number() OVER w AS seq,
         CAST(sum(CAST(round(l_discount * 100) AS bigint) - 5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS cum,
         CAST(l_quantity * 100 AS bigint) AS vol
  FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey % (SELECT greatest(10, count(*) // 10) FROM supplier) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)
),
tr AS (SELECT symbol, d, seq, round(20 * exp(CAST(cum AS double) * CAST(0.004 AS double)), 4) AS price, vol FROM tr0)"""

BARS_SQL = TRADES_SQL + """,
bars AS (
  SELECT symbol, d, min_by(price, seq) AS o, max(price) AS h, min(price) AS l, max_by(price, seq) AS c, CAST(sum(vol) AS bigint) AS v
  FROM tr GROUP BY symbol, d
)"""

TICKS_SQL = """
ev AS (
  SELECT 'T' || (user_id % (SELECT greatest(5, count(*) // 20) FROM supplier)) AS symbol, CAST(ts AS date) AS d,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS integer) AS sec, event_id,
         CAST(json_extract_string(props, '$.k') AS bigint) AS k, event_type
  FROM events
),
ticks AS (
  SELECT symbol, d, sec,
         30 + CAST(0.05 AS double) * CAST(sum(k % 3 - 1) OVER (PARTITION BY symbol ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS double) AS price,
         (1 + k % 10) * 100 AS vol,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'PS' WHEN event_type IN ('click', 'error') THEN 'PB' ELSE 'ATC' END AS side,
         CAST(sum((1 + k % 10) * 100) OVER (PARTITION BY symbol, d ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS acc
  FROM ev
)"""
