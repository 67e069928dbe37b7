"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fieldcast.sources.stages import stored  # noqa: F401  the operators take it from here

#: The characters [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Column names that do not clash with `columns` in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored_count(df: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """stored(), and in how many rows `what` held while they were written (or more, if a task ran twice)."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(what).alias("n")), name)
    return out, seen.get["n"]


def map_arrow(df: DataFrame, task, schema: StructType) -> DataFrame:
    """df.mapInArrow(task, schema), for columns of any name: inside, those of df and of the result are c0, c1, and so on."""
    inside = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(task, inside).toDF(*schema.names)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def in_fold(doc_id: Column) -> Column:
    """True for the held-out fold: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
