"""Dates, crop seasons and annual phase as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season by month, months of its first and last day, and its printed name. Fixed values.
SEASONS = {
    "kharif": (6, 9, "Summer (Kharif)"),
    "zaid": (3, 5, "Spring (Zaid)"),
    "rabi": (10, 2, "Winter (Rabi)"),
}
YEAR_DAYS = 365.25


def parse_date(path: Column) -> Column:
    """The date in a file's base name: year-month-day, else year and day of year, else null."""
    name = F.element_at(F.split(path, "/"), -1)
    ymd = r"(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})"
    day = F.try_to_date(F.concat(*[F.regexp_extract(name, ymd, i) for i in (1, 2, 3)]), "yyyyMMdd")
    doy = r"(\d{4})[-_.]?(\d{3})(?!\d)"
    year, nth = F.regexp_extract(name, doy, 1), F.regexp_extract(name, doy, 2)
    by_day = F.when((year != "") & (year.try_cast("int") >= 1), F.date_add(F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)), nth.try_cast("int") - 1))
    return F.coalesce(day, by_day)


def season_of(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.between(6, 9), "kharif").when(m.between(3, 5), "zaid").otherwise("rabi")


def season_year(date: Column) -> Column:
    """The year in which the season instance starts: January and February belong to the rabi of the year before."""
    return F.when(F.month(date) <= 2, F.year(date) - 1).otherwise(F.year(date))


def season_start(season: Column, year: Column) -> Column:
    month = F.when(season == "kharif", 6).when(season == "zaid", 3).otherwise(10)
    return F.make_date(year, month, F.lit(1))


def season_end(season: Column, year: Column) -> Column:
    return (
        F.when(season == "kharif", F.make_date(year, F.lit(9), F.lit(30)))
        .when(season == "zaid", F.make_date(year, F.lit(5), F.lit(31)))
        .otherwise(F.last_day(F.make_date(year + 1, F.lit(2), F.lit(1))))
    )


def season_days(season: Column, year: Column) -> Column:
    return F.datediff(season_end(season, year), season_start(season, year)) + 1


def season_label(season: Column, year: Column) -> Column:
    name = F.when(season == "kharif", SEASONS["kharif"][2]).when(season == "zaid", SEASONS["zaid"][2]).otherwise(SEASONS["rabi"][2])
    years = F.when(season == "rabi", F.format_string("%d/%02d", year, (year + 1) % 100)).otherwise(year.cast("string"))
    return F.concat(name, F.lit(" "), years)


def phase(date: Column) -> Column:
    return (F.dayofyear(date) - 1) * (2 * math.pi / YEAR_DAYS)


def harmonics(date: Column, order: int = 2) -> list[Column]:
    """1, cos and sin of the annual phase and its multiples."""
    out = [F.lit(1.0)]
    for k in range(1, order + 1):
        out += [F.cos(phase(date) * k), F.sin(phase(date) * k)]
    return out
