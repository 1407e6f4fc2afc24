"""100 ns ticks since year 1 to and from wall-clock timestamps, without touching the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ticks between year 1 and 1970.
TICKS_AT_EPOCH = 621355968000000000

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, as written on the wall clock."""
    gap = ts - F.expr(_EPOCH)
    part = {unit: F.extract(F.lit(unit), gap) for unit in ("DAY", "HOUR", "MINUTE")}
    whole = (part["DAY"].cast("long") * 24 + part["HOUR"]) * 60 + part["MINUTE"]
    return whole * 60_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def ts_of_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def ticks_to_ts(ticks: Column) -> Column:
    """100 ns is cut to 1 microsecond."""
    return ts_of_micros(F.call_function("div", ticks - F.lit(TICKS_AT_EPOCH), F.lit(10)))


def ts_to_ticks(ts: Column) -> Column:
    return micros_of(ts) * 10 + F.lit(TICKS_AT_EPOCH)


def minutes_before(ts: Column, minutes: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
