"""Reading frames, weather records and forcing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcast.functions.dates import parse_date
from fieldcast.functions.names import plain

#: Spellings of each channel in weather files, in the order in which they are tried. Fixed values.
ALIASES = {
    "precip": ("precip_mm", "precipitation", "precipitation_sum", "precip", "p", "p_mm", "rain", "rain_mm", "prcp"),
    "rs": ("swrad_mj_m2", "sw_rad_mj_m2", "shortwave_radiation_sum", "shortwave_radiation", "swr", "rs", "sw_rad", "srad", "solar_radiation", "par"),
    "ta": ("ta_mean_c", "ta_c", "ta", "temperature_2m_mean", "temperature_2m", "air_temperature", "t2m", "tair", "temp_c"),
    "vpd": ("vpd_mean_kpa", "vpd_kpa", "vpd", "vapour_pressure_deficit_mean", "vapour_pressure_deficit", "vapor_pressure_deficit"),
    "ta_max": ("ta_max_c", "temperature_2m_max", "tmax", "t_max_c"),
    "ta_min": ("ta_min_c", "temperature_2m_min", "tmin", "t_min_c"),
    "vpd_max": ("vpd_max_kpa", "vapour_pressure_deficit_max", "vpd_max"),
    "date": ("date", "time", "datetime", "day", "timestamp"),
}
#: Date formats of a text column, in the order of preference. Fixed values.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyyMMdd")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the rasters under a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").option("recursiveFileLookup", "true").load(path).select("path")


def dated(files: DataFrame) -> DataFrame:
    return files.withColumn("date", parse_date(F.col("path")))


def duplicate_dates(files: DataFrame) -> DataFrame:
    """(keys, date, n_files) of dates with several files; keys: field, where files have it."""
    keys = [c for c in ("field",) if c in files.columns]
    return files.where("date is not null").groupBy(*keys, "date").agg(F.count("*").alias("n_files")).where("n_files > 1")


def frame_catalog(files: DataFrame, strict: bool = True) -> DataFrame:
    """files (path) with date, by date. Undated files are left out; two files of one date, no file, or none dated is an error.

    strict=False allows several files of one date.
    """
    got = dated(files)
    n = got.agg(F.count("*").alias("n"), F.count("date").alias("dated")).first()
    if not n.n or not n.dated:
        raise ValueError("no raster found" if not n.n else f"none of {n.n} rasters has a date in its name")
    twice = duplicate_dates(got).limit(3).collect() if strict else []
    if twice:
        raise ValueError(f"several files of one date, such as {[str(r.date) for r in twice]}")
    return got.where("date is not null").orderBy("date")


def read_pixels(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of pixels that is flat already."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def decode_rasters(files: DataFrame, decode: Callable, schema: str | StructType) -> DataFrame:
    """Pixels of raster files (path, content) by a user's function from a batch of rows to rows; a raster is read by one task."""
    return files.mapInPandas(lambda frames: (decode(f) for f in frames), schema)


def resolve_columns(columns: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str]:
    """{column: its canonical name} by the first alias that is there; case and punctuation do not count."""
    own = {plain(c): c for c in reversed(columns)}
    return {own[a]: name for name, tries in aliases.items() for a in [next((t for t in map(plain, tries) if t in own), None)] if a}


def pick_date_format(table: DataFrame, column: str, position: str, formats: tuple[str, ...] = DATE_FORMATS) -> str:
    """The format that parses every row; of several the one under which dates do not go back in file order, else the first.

    One pass over the column, dealt out by ranges of position, which orders the rows of the file: a row for each task
    reaches the driver.
    """
    names = [f"f{i}" for i in range(len(formats))]
    tries = [F.unix_micros(F.try_to_timestamp(column, F.lit(f))).alias(n) for n, f in zip(names, formats, strict=True)]
    placed = table.select(F.col(position).alias("pos"), *tries).repartitionByRange("pos").sortWithinPartitions("pos")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, rows = None, 0
        bad, back, first, last = ([0] * len(formats), [0] * len(formats), [None] * len(formats), [None] * len(formats))
        for b in batches:
            begin = b.column(0)[0].as_py() if begin is None and b.num_rows else begin
            rows += b.num_rows
            for i in range(len(formats)):
                seen = b.column(i + 1).drop_null().to_pylist()
                bad[i] += b.num_rows - len(seen)
                if seen:
                    back[i] += sum(y < x for x, y in zip([seen[0] if last[i] is None else last[i], *seen], seen, strict=False))
                    first[i], last[i] = seen[0] if first[i] is None else first[i], seen[-1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (bad, back, first, last))], ["pos", "bad", "back", "first", "last"])

    parts = sorted(placed.mapInArrow(task, "pos long, bad array<long>, back array<long>, first array<long>, last array<long>").collect(), key=lambda r: r.pos)
    whole = [i for i in range(len(formats)) if not sum(r.bad[i] for r in parts)]
    if not whole:
        raise ValueError(f"no format parses all of column {column}")
    between = lambda i: sum(y.first[i] < x.last[i] for x, y in zip(parts, parts[1:], strict=False))
    steady = [i for i in whole if not sum(r.back[i] for r in parts) + between(i)]
    return formats[steady[0] if len(steady) == 1 else whole[0]]


def read_weather_csv(spark: SparkSession, path: str, field: str = "") -> DataFrame:
    """(field, date, channels..): known channels by alias, other columns under their own names; what is no number is null."""
    raw = spark.read.option("header", True).csv(path)
    names = resolve_columns(raw.columns)
    if "date" not in names.values():
        raise ValueError(f"no date column among {raw.columns}")
    date = next(c for c, n in names.items() if n == "date")
    placed = raw.withColumn("file_pos", F.monotonically_increasing_id())
    fmt = pick_date_format(placed, date, "file_pos")
    others = [F.col(f"`{c}`").try_cast("double").alias(names.get(c, c)) for c in raw.columns if c != date]
    return placed.select(F.lit(field).alias("field"), F.to_date(F.to_timestamp(date, fmt)).alias("date"), *others).orderBy("date")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018  resolves the path
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_irrigation(spark: SparkSession, path: str | None, axis: DataFrame, columns: list[str], how: str = "sum") -> DataFrame:
    """Irrigation on the windows of the axis; without a path, or a file there, all channels are zero, without a named column
    it is an error."""
    from fieldcast.operators.weather import forward_window

    if path is None or not _exists(spark, path):
        return axis.select("field", "date").distinct().select("*", *[F.lit(0.0).alias(c) for c in columns])
    raw = spark.read.option("header", True).csv(path)
    lost = [c for c in ("date", *columns) if c not in raw.columns]
    if lost:
        raise ValueError(f"columns {lost} are missing from {path}")
    daily = raw.select(F.to_date("date").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in columns])
    fields = axis.select("field").distinct()
    return forward_window(axis, daily.crossJoin(fields), columns, how)
