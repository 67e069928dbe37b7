"""Writing forecast maps, reports, models and forcing tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Value of cells outside the common mask in files, and the version of stored models. Fixed values.
NODATA, MODEL_VERSION = -9999.0, 4
_REQUIRED = ("A", "Q", "R")


def forecast_maps(forecasts: DataFrame, truth: DataFrame, scale: DataFrame, std: DataFrame, units: str) -> DataFrame:
    """(field, variant, origin, lead, pixel, forecast, std, error, tags) in the units of the data.

    forecasts (field, variant, origin, lead, pixel, pred) are normalised; scale (field, mean, std) undoes it; std
    (field, origin, lead, pixel, band) is the uncertainty; error is null where there is no frame.
    """
    own = forecasts.withColumn("target", F.expr("date_add(origin, lead)")).join(scale.withColumnRenamed("std", "sd"), "field")
    own = own.withColumn("forecast", F.col("pred") * F.col("sd") + F.col("mean"))
    got = own.join(truth.select("field", F.col("date").alias("target"), "pixel", "value"), ["field", "target", "pixel"], "left")
    got = got.join(std, ["field", *(["variant"] if "variant" in std.columns else []), "origin", "lead", "pixel"], "left")
    tags = F.create_map(
        F.lit("origin"), F.col("origin").cast("string"), F.lit("target"), F.col("target").cast("string"), F.lit("lead"), F.col("lead").cast("string"),
        F.lit("variant"), F.col("variant"), F.lit("units"), F.lit(units),
    )
    return got.select("field", "variant", "origin", "lead", "pixel", "forecast", F.col("band").alias("std"), (F.col("forecast") - F.col("value")).alias("error"), tags.alias("tags"))


def with_nodata(maps: DataFrame) -> DataFrame:
    return maps.withColumns({c: F.coalesce(c, F.lit(NODATA)) for c in ("forecast", "std", "error")})


def write_maps(maps: DataFrame, path: str) -> None:
    """Parquet by field, origin and lead; rows of one map are brought together first, so that there are few files."""
    maps.repartition("field", "origin", "lead").write.mode("overwrite").partitionBy("field", "origin", "lead").parquet(path)


def write_report(report: DataFrame, path: str, as_json: bool = False) -> None:
    """A report table as Parquet, or as one JSON file (reports have a row for each variant and lead, not for each pixel)."""
    if as_json:
        report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    else:
        report.write.mode("overwrite").parquet(path)


def save_model(spark: SparkSession, models: dict, n_pixels: int, path: str) -> None:
    """{field: {name: matrix}} as a table with a row for each matrix."""
    rows = []
    for field, m in models.items():
        for name, x in m.items():
            for i, part in enumerate(x if name == "A" else [x]):
                a = np.atleast_2d(np.asarray(part, float))
                rows.append((field, name, i, a.shape[0], a.shape[1], a.ravel().tolist(), MODEL_VERSION, n_pixels))
    spark.createDataFrame(rows, "field long, name string, part int, rows int, cols int, data array<double>, model_version int, n_pixels long").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, n_pixels: int | None = None) -> dict:
    """Another version, a missing matrix or another grid size is an error: such a model would forecast something else."""
    models: dict = {}
    for r in spark.read.parquet(path).orderBy("field", "name", "part").collect():
        if r.model_version != MODEL_VERSION:
            raise ValueError(f"model version {r.model_version}, this library reads {MODEL_VERSION}")
        if n_pixels is not None and r.n_pixels != n_pixels:
            raise ValueError(f"the model has {r.n_pixels} pixels, the grid {n_pixels}")
        a = np.asarray(r.data).reshape(r.rows, r.cols)
        m = models.setdefault(r.field, {})
        if r.name == "A":
            m.setdefault("A", []).append(a)
        else:
            m[r.name] = a
    for field, m in models.items():
        if lost := [k for k in _REQUIRED if k not in m]:
            raise ValueError(f"field {field}: {lost} are missing")
    return models


def save_forcing(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_forcing(spark: SparkSession, path: str, axis: DataFrame) -> DataFrame:
    """A stored forcing table; an axis of another number of dates is an error."""
    got = spark.read.parquet(path)
    a, b = got.count(), axis.count()
    if a != b:
        raise ValueError(f"the forcing has {a} rows, the axis {b} dates")
    return got
