"""The driver's star-schema tables in the roles of this library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(c: Column | str, n: int = 6) -> Column:
    """c to n places. Means of whole numbers often lie half-way between two such values, where engines round either
    way; a shift of 3 in the second place after that settles it alike everywhere. The SQL adds the same."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 3 * 10.0 ** -(n + 2), n)


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels (field, date, pixel, value): a user is a pixel, its daily mean the value; three fields."""
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("field"), F.col("ts").cast("date").alias("date"), F.col("user_id").alias("pixel"), "value")
    return own.groupBy("field", "date", "pixel").agg(F.avg("value").alias("value"))


def item_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels (field, date, pixel, row, col, value): a supplier is a pixel on a grid of ten columns, the value its daily mean quantity."""
    own = table(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("field"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("pixel"), "l_quantity")
    mean = own.groupBy("field", "date", "pixel").agg(F.avg("l_quantity").alias("value"))
    return mean.withColumns({"row": F.floor(F.col("pixel") / 10).cast("int"), "col": (F.col("pixel") % 10).cast("int")})


def block_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_panel with many fields: each hundred suppliers are a field, a grid of ten by ten."""
    own = item_panel(spark, sf_dir)
    at = F.col("pixel")
    return own.withColumns({"field": F.floor(at / 100).cast("long"), "row": F.floor(at % 100 / 10).cast("int"), "col": (at % 10).cast("int")})


def weather_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, date, precip, ta, rs, vpd): a row a day of orders; days without orders are missing."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderpriority")
    return own.groupBy("date").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("precip"),
        (F.avg("o_totalprice") / 1000).alias("ta"), (F.min("o_totalprice") / 1000).alias("rs"), (F.max("o_totalprice") / 1000).alias("vpd"),
    ).withColumn("field", F.lit(0).cast("long"))


def trajectory(spark: SparkSession, sf_dir: str, r: int, per_field: bool = False) -> DataFrame:
    """weights (field, t, w): the first r entries of the embeddings; t counts the vectors of a field."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("field"), F.col("vec_id").alias("t"), F.transform(F.slice("embedding", 1, r), lambda x: F.round(x.cast("double"), 6)).alias("w"))
    if not per_field:
        return own.withColumn("field", F.lit(0).cast("long"))
    return own.withColumn("t", F.row_number().over(Window.partitionBy("field").orderBy("t")).cast("long") - 1)


#: The same roles in SQL, as common table expressions.
SQL = {
    "ev": "ev AS (SELECT user_id % 3 AS field, CAST(ts AS DATE) AS date, user_id AS pixel, avg(value) AS value FROM events GROUP BY ALL)",
    "li": "li AS (SELECT CAST(0 AS BIGINT) AS field, CAST(l_shipdate AS DATE) AS date, l_suppkey AS pixel, CAST(l_suppkey // 10 AS INT) AS row, CAST(l_suppkey % 10 AS INT) AS col, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)",
    # li with many fields, as block_panel.
    "lb": "lb AS (SELECT CAST(pixel // 100 AS BIGINT) AS field, date, pixel, CAST(pixel % 100 // 10 AS INT) AS row, CAST(pixel % 10 AS INT) AS col, value FROM li)",
    "wx": "wx AS (SELECT CAST(0 AS BIGINT) AS field, CAST(o_orderdate AS DATE) AS date, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS precip, avg(o_totalprice) / 1000 AS ta, min(o_totalprice) / 1000 AS rs, max(o_totalprice) / 1000 AS vpd FROM orders GROUP BY ALL)",
    "ev_days": "ev_days AS (SELECT DISTINCT field, date, true AS seen FROM ev)",
    "ev_cal": "ev_cal AS (SELECT field, date, CAST(date - lo AS INT) AS t, seen IS NOT NULL AS observed FROM (SELECT field, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT field, min(date) AS lo, max(date) AS hi FROM ev GROUP BY field)) LEFT JOIN ev_days USING (field, date))",
    "li_days": "li_days AS (SELECT DISTINCT field, date, true AS seen FROM li)",
    "li_cal": "li_cal AS (SELECT field, date, CAST(date - lo AS INT) AS t, seen IS NOT NULL AS observed FROM (SELECT field, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT field, min(date) AS lo, max(date) AS hi FROM li GROUP BY field)) LEFT JOIN li_days USING (field, date))",
    "wx_days": "wx_days AS (SELECT DISTINCT field, date, true AS seen FROM wx)",
    "wx_cal": "wx_cal AS (SELECT field, date, CAST(date - lo AS INT) AS t, seen IS NOT NULL AS observed FROM (SELECT field, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT field, min(date) AS lo, max(date) AS hi FROM wx GROUP BY field)) LEFT JOIN wx_days USING (field, date))",
    # The item archive without frames of 20 valid cells or fewer, which makes gaps.
    "gap_days": "gap_days AS (SELECT field, date, true AS seen FROM li GROUP BY field, date HAVING count(value) > 20)",
    "gap_cal": "gap_cal AS (SELECT field, date, CAST(date - lo AS INT) AS t, seen IS NOT NULL AS observed FROM (SELECT field, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT field, min(date) AS lo, max(date) AS hi FROM gap_days GROUP BY field)) LEFT JOIN gap_days USING (field, date))",
}


def with_sql(names: str, select: str) -> str:
    """select may begin with a comma, and then goes on with table expressions of its own."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + select
