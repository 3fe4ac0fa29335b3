"""Timestamp parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FIRST = "dd/MM/yyyy HH:mm:ss"
MONTH_FIRST = "MM/dd/yyyy HH:mm:ss"


def parse_timestamp(raw: Column, formats: Sequence[str] = (DAY_FIRST,)) -> Column:
    """The first format that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)) for f in formats])
