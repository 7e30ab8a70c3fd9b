"""Clock and calendar expressions; the session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from freshet.constants import ZONE_BY_CODE

def hour() -> Column:
    return F.expr("INTERVAL '1' HOUR")


def local_to_utc(local: Column, zone: Column | str) -> Column:
    """UTC instant of a local clock reading; a repeated hour means standard time."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    daylight = F.to_utc_timestamp(local, zone)
    standard = daylight + hour()
    return F.when(F.from_utc_timestamp(standard, zone) == local, standard).otherwise(daylight)


def code_number(code: Column) -> Column:
    """Place of a clock code in the fixed table, 0 for any other text. Numbers aggregate without sorting."""
    return F.coalesce(F.array_position(F.lit(list(ZONE_BY_CODE)), code), F.lit(0)).cast("int")


def code_to_utc(local: Column, number: Column, owner: Column) -> Column:
    """As `local_to_utc` for a clock code's number; one branch per zone keeps each zone a constant.

    A code outside the table fails the query, naming the owner of the row.
    """
    codes, out = list(ZONE_BY_CODE), None
    for zone in dict.fromkeys(ZONE_BY_CODE.values()):
        hit = number.isin([codes.index(c) + 1 for c, z in ZONE_BY_CODE.items() if z == zone])
        out = F.when(hit, local_to_utc(local, zone)) if out is None else out.when(hit, local_to_utc(local, zone))
    unknown = F.concat(F.lit("unknown clock code at the start of "), owner.cast("string"))
    return out.otherwise(F.raise_error(unknown).cast("timestamp"))


def ceil_to_hour(ts: Column) -> Column:
    """Next full hour unless the minute is already zero."""
    floor = F.date_trunc("hour", ts)
    return F.when(F.minute(ts) == 0, floor).otherwise(floor + hour())


def round_to_hour(ts: Column) -> Column:
    """Nearest hour; exact half hours go to the even hour."""
    return F.timestamp_seconds(F.bround(F.unix_micros(ts) / F.lit(3.6e9)) * 3600)


def shift_offset(ts: Column, hours: Column) -> Column:
    """Subtract a fixed UTC offset given in (possibly fractional) hours."""
    return F.timestamp_micros(F.unix_micros(ts) - F.round(hours * F.lit(3.6e9)).cast("bigint"))


def hydrologic_year(day: Column) -> Column:
    """Year that ends on 30 September."""
    return F.year(day) + F.when(F.month(day) >= 10, 1).otherwise(0)


def in_snow_season(day: Column) -> Column:
    """True from 1 October to 15 July."""
    stamp = F.month(day) * 100 + F.dayofmonth(day)
    return (stamp >= 1001) | (stamp <= 715)


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    angle = value.cast("double") * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
