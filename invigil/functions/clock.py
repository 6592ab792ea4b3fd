"""Time of day as microseconds, which Parquet and every Spark client can carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE


def micros_of_day(moment: Column) -> Column:
    """Microseconds since midnight of a zone-less timestamp."""
    seconds = F.extract(F.lit("SECOND"), moment) * F.lit(1_000_000)
    return (
        F.hour(moment).cast("long") * MICROS_PER_HOUR
        + F.minute(moment).cast("long") * MICROS_PER_MINUTE
        + seconds.cast("long")
    )


def at_time(day: Column, micros: Column) -> Column:
    """The timestamp ``micros`` microseconds into ``day``."""
    return F.timestamp_add("MICROSECOND", micros, day.cast("timestamp_ntz"))
