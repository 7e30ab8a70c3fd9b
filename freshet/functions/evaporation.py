"""Temperature-based potential evaporation (FAO-56 radiation, Hargreaves-Samani)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from freshet.functions.numbers import clip_low


def _declination(doy: Column) -> Column:
    return F.lit(0.409) * F.sin(F.lit(2.0) * F.pi() / F.lit(365.0) * doy - F.lit(1.39))


def _sunset_angle(latitude: Column, doy: Column) -> Column:
    cosine = -F.tan(F.radians(latitude)) * F.tan(_declination(doy))
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def extraterrestrial_radiation(latitude: Column, doy: Column) -> Column:
    """Daily radiation above the atmosphere in mm of depth."""
    phi, delta, angle = F.radians(latitude), _declination(doy), _sunset_angle(latitude, doy)
    distance = F.lit(1.0) + F.lit(0.033) * F.cos(F.lit(2.0) * F.pi() / F.lit(365.0) * doy)
    shape = angle * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(angle)
    return F.lit(24.0 * 60.0) / F.pi() * F.lit(0.0820) * distance * shape * F.lit(0.408)


def hargreaves_pet(tmin: Column, tmax: Column, latitude: Column, doy: Column,
                   tmean: Column | None = None) -> Column:
    """Daily potential evaporation in mm, never negative."""
    mean = (tmin + tmax) / F.lit(2.0) if tmean is None else tmean
    spread = F.sqrt(clip_low(tmax - tmin, 0.0))
    radiation = extraterrestrial_radiation(latitude, doy)
    return clip_low(F.lit(0.0023) * radiation * spread * (mean + F.lit(17.8)), 0.0)


def _with(value: Column, body) -> Column:
    """Work out a value once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def daylight_weights(latitude: Column, doy: Column) -> Column:
    """The 24 hourly shares of a day's evaporation, a half sine over daylight that sums to one.

    The sine is not cut outside sunrise and sunset, so very short days get some weight at night. Days without
    daylight use equal shares.
    """
    hours = F.sequence(F.lit(0), F.lit(23))

    def raw(daylight: Column) -> Column:
        sunrise = F.lit(12.0) - daylight / F.lit(2.0)
        return F.transform(hours, lambda h: F.greatest(
            F.sin(F.pi() * (h.cast("double") + F.lit(0.5) - sunrise) / daylight), F.lit(0.0)))

    def shares(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        return _with(total, lambda t: F.when(t > 0.0, F.transform(weights, lambda x: x / t)).otherwise(uniform_weights()))

    daylight = F.lit(24.0) / F.pi() * _sunset_angle(latitude, doy)
    return _with(daylight, lambda d: F.when(d > 0.0, _with(raw(d), shares)).otherwise(uniform_weights()))


def uniform_weights() -> Column:
    return F.array_repeat(F.lit(1.0 / 24.0), 24)
