"""Column, file and unit names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(name: str) -> str:
    """Lower case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def plain_col(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def forecast_name(modality: Column, origin: Column, lead: Column) -> Column:
    return F.format_string("%s_forecast_%s_t+%d", F.upper(modality), F.date_format(origin, "yyyy-MM-dd"), lead)
