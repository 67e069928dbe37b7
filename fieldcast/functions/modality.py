"""What kind of field a raster holds: units, valid range and how it is shown, as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: key, label, units, valid range, range for display, decimals. Fixed values.
MODALITIES = [
    ("ndvi", "NDVI", "1", -1.0, 1.0, 0.0, 1.0, 4),
    ("lst", "Land surface temperature", "K", 250.0, 350.0, 283.15, 320.15, 2),
]
SCHEMA = "key string, label string, units string, lo double, hi double, show_lo double, show_hi double, digits int"


def modalities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODALITIES, SCHEMA)


def get(name: str) -> tuple:
    """The row of a key, label or prefix; an unknown name is an error."""
    n = name.strip().lower()
    for row in MODALITIES:
        if n in (row[0], row[1].lower()) or n.startswith(row[0]):
            return row
    raise KeyError(name)


def resolve(name: Column, fallback: str = "ndvi") -> Column:
    """The key of a name given as key, label or with a key as its beginning; else the fallback."""
    n = F.lower(F.trim(name))
    out = F.lit(fallback)
    for row in reversed(MODALITIES):
        out = F.when((n == row[0]) | (n == row[1].lower()) | F.startswith(n, F.lit(row[0])), row[0]).otherwise(out)
    return out


def shown(value: Column, digits: int) -> Column:
    return F.format_number(value, digits)
