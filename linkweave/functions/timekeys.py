"""Time keys (F15, F16). Stored times are UTC wall-clock ``timestamp_ntz``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions.util import as_col


def month_of(ts) -> Column:
    """'YYYY-MM' month key."""
    return F.date_format(as_col(ts), "yyyy-MM")


def as_of(value=None) -> Column:
    """F16: ingest stamp. An explicit value keeps runs deterministic; None means now (UTC)."""
    if value is None:
        # UTC wall clock of the current instant, whatever the session time zone.
        return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        # Through text: a Python datetime literal would be shifted by the session time zone.
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    raise TypeError(f"unsupported as_of value: {value!r}")


def bytes_to(size, unit: str, digits: int) -> Column:
    """bytes -> MB (unit='MB') or GB (unit='GB'), rounded."""
    power = {"KB": 1, "MB": 2, "GB": 3}[unit]
    return F.round(as_col(size).cast("double") / float(1024 ** power), digits)
