"""Numbers and days as they stand on the wire."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296
_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_HEX = r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
_INFINITE = r"[+-]?(?i:inf|infinity)"


def parse_float(c: Column) -> Column:
    """A float literal; null where it is none, is NaN, or is finite but beyond a double's range."""
    x = c.try_cast("double")
    return F.when(c.rlike(rf"^(?:{_DECIMAL}|{_HEX})\z") & (F.abs(x) < float("inf")), x).when(
        c.rlike(rf"^{_INFINITE}\z"), F.when(F.startswith(c, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )


def is_number(value: Column) -> Column:
    """Whether a source takes the value: not null and not NaN; infinite ones are taken."""
    return value.isNotNull() & ~F.isnan(value)


def wrap_u32(c: Column) -> Column:
    """A 64-bit integer as the wire keeps it: its lowest 32 bits, unsigned."""
    return F.pmod(c, F.lit(U32))


def seconds_of_ms(c: Column) -> Column:
    """Division by 1000 toward zero."""
    return F.call_function("div", c, F.lit(1000))


def utc_day(time: Column) -> Column:
    return F.date_from_unix_date(F.floor(time / 86400).try_cast("int"))


def local_day(time: Column, zone: str) -> Column:
    """The calendar day of the epoch second in the given zone, whatever the session's zone is."""
    utc = F.timestamp_add("SECOND", time, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month(day: Column) -> Column:
    """yyyymm, by which the tables are partitioned."""
    return F.year(day) * 100 + F.month(day)
