"""Tensors and intervals over the sample tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.operators import folds, intervals, tensor

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_l(spark: SparkSession, d: str) -> DataFrame:
    """Mean price by ship month, the supplier's nation and brand."""
    line = table(spark, d, "lineitem").where("l_shipdate is not null").select("l_suppkey", "l_partkey", "l_extendedprice", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("start"))
    # suppliers and parts are joined by Spark's own choice; both sides are keyed
    line = line.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    line = line.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).withColumn("contig", F.lit("m"))
    return tensor.from_measurements(line, tensor.KEYS, F.col("s_nationkey"), "p_brand", F.col("l_extendedprice"), brands(spark, d))


def brands(spark: SparkSession, d: str) -> DataFrame:
    return tensor.dense_ids(table(spark, d, "part"), "p_brand", "col_id")


def l(spark: SparkSession, d: str) -> DataFrame:  # noqa: E743
    return tensor.with_asinh(tensor.scrub(raw_l(spark, d)))


def raw_e(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value by quarter day, twentieth of the users and event type."""
    ev = table(spark, d, "events").select("user_id", "event_type", "value", F.floor(F.expr(SECONDS) / 21600).cast("long").alias("start"), F.lit("e").alias("contig"))
    return tensor.from_measurements(ev, tensor.KEYS, F.col("user_id") % 20, "event_type", F.col("value"), types(spark, d))


def types(spark: SparkSession, d: str) -> DataFrame:
    return tensor.dense_ids(table(spark, d, "events"), "event_type", "col_id")


def e(spark: SparkSession, d: str) -> DataFrame:
    return tensor.with_asinh(tensor.scrub(raw_e(spark, d)))


def plane(spark: SparkSession, n_rows: int, n_cols: int) -> DataFrame:
    return spark.range(n_rows * n_cols).select(F.floor(F.col("id") / n_cols).cast("int").alias("row_id"), (F.col("id") % n_cols).cast("int").alias("col_id"))


def splits(spark: SparkSession, n_rows: int, n_cols: int) -> DataFrame:
    return plane(spark, n_rows, n_cols).withColumn("split", folds.formula_split(F.col("row_id"), F.col("col_id")))


def windows(spark: SparkSession) -> DataFrame:
    """Quarter hours of thirty days, in seconds from their begin."""
    return intervals.windows(spark, "w", 0, 2880 * 900, 900)


def event_features(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an interval of one second."""
    at = F.expr(SECONDS).cast("long")
    return table(spark, d, "events").select(F.lit("w").alias("contig"), at.alias("start"), (at + 1).alias("end"), "value", "event_type", "event_id")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """The hour after each large error."""
    f = event_features(spark, d).where("event_type = 'error' and value > 200")
    return f.select("contig", "start", (F.col("start") + 3600).alias("end"), F.col("event_id").alias("region_id"))


def axes3(spark: SparkSession, n_rows: int, n_cols: int) -> tuple[DataFrame, DataFrame]:
    """Rank-three row and column factors in closed form."""
    i = F.col("id")
    rows = spark.range(n_rows).select(i.cast("int").alias("id"), F.array(*(F.sin(i * k + 0.5) * 0.3 for k in (1, 2, 3))).alias("factors"), (i * 0.01).alias("bias"))
    cols = spark.range(n_cols).select(i.cast("int").alias("id"), F.array(*(F.cos(i * k + 0.25) * 0.3 for k in (1, 2, 3))).alias("factors"), (i * -0.02).alias("bias"))
    return rows, cols


def bins3(t: DataFrame, phase: float = 0.0) -> DataFrame:
    s = F.col("start")
    return t.select(*tensor.KEYS).distinct().select(*tensor.KEYS, F.array(*(F.sin(s * 0.1 * k + phase) for k in (1, 2, 3))).alias("factors"), (F.cos(s * 0.05) * 0.1).alias("bias"))


SQL_L = """
brand AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS col_id FROM (SELECT DISTINCT p_brand FROM part)),
raw_l AS (SELECT 'm' AS contig, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS start, CAST(s_nationkey AS INTEGER) AS row_id,
                 p_brand, avg(l_extendedprice) AS v
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL GROUP BY ALL),
l AS (SELECT contig, start, row_id, col_id, asinh(v) AS value FROM raw_l JOIN brand USING (p_brand) WHERE v <> 0)"""

SQL_E = """
kind AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS col_id FROM (SELECT DISTINCT event_type FROM events)),
raw_e AS (SELECT 'e' AS contig, CAST(floor((epoch(ts) - 1704067200) / 21600) AS BIGINT) AS start, CAST(user_id % 20 AS INTEGER) AS row_id,
                 event_type, avg(value) AS v FROM events GROUP BY ALL),
e AS (SELECT contig, start, row_id, col_id, asinh(v) AS value FROM raw_e JOIN kind USING (event_type) WHERE v <> 0)"""

SQL_SPLIT = """
{name} AS (SELECT CAST(r AS INTEGER) AS row_id, CAST(c AS INTEGER) AS col_id,
                  CASE WHEN (r * 7 + c * 3) % 10 < 7 THEN 'train' WHEN (r * 7 + c * 3) % 10 < 9 THEN 'valid' ELSE 'test' END AS split
           FROM range({rows}) a(r), range({cols}) b(c))"""

SQL_W = """
w AS (SELECT 'w' AS contig, CAST(i * 900 AS BIGINT) AS start, CAST(i * 900 + 900 AS BIGINT) AS "end" FROM range(2880) t(i)),
f AS (SELECT 'w' AS contig, CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) AS start, CAST(floor(epoch(ts)) - 1704067200 + 1 AS BIGINT) AS "end",
             value, event_type, event_id FROM events),
g AS (SELECT contig, start, start + 3600 AS "end", event_id AS region_id FROM f WHERE event_type = 'error' AND value > 200)"""


def sql_predicted(bins: str, rows: int, cols: int, name: str = "p", phase: float = 0.0, mean: float = 5.0) -> str:
    """Predictions of the closed-form model at all cells of the bins of a CTE."""
    dot = " + ".join(f"sin(r * {k} + 0.5) * 0.3 * (cos(c * {k} + 0.25) * 0.3) * sin(start * 0.1::DOUBLE * {k} + {phase}::DOUBLE)" for k in (1, 2, 3))
    return f"""
{name} AS (SELECT contig, start, CAST(r AS INTEGER) AS row_id, CAST(c AS INTEGER) AS col_id,
      {dot} + (r * 0.01::DOUBLE + c * -0.02::DOUBLE + {mean}::DOUBLE) + cos(start * 0.05::DOUBLE) * 0.1::DOUBLE AS predicted
      FROM (SELECT DISTINCT contig, start FROM {bins}), range({rows}) a(r), range({cols}) b(c))"""
