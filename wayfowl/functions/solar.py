"""Solar position as column expressions (NOAA / Meeus), and the threshold estimate of a place from two twilights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sun:
    solar_time: Column  # degrees
    sin_dec: Column
    cos_dec: Column


def with_sun(df: DataFrame, name: str, seconds: Column) -> tuple[DataFrame, Sun]:
    """df with the sun's terms for a time in seconds since the epoch, built in layers of columns, so that no term is written out
    more than once. The coefficients are the published ones of the NOAA calculator."""
    rad, deg = F.radians, F.degrees
    c = lambda k: F.col(f"{name}_{k}")

    def layer(d: DataFrame, **terms: Column) -> DataFrame:
        return d.withColumns({f"{name}_{k}": v for k, v in terms.items()})

    d = layer(df, jd=seconds / 86400.0 + 2440587.5)
    d = layer(d, jc=(c("jd") - 2451545.0) / 36525.0)
    jc = c("jc")
    d = layer(
        d, l0=rad(F.pmod(280.46646 + jc * (36000.76983 + 0.0003032 * jc), F.lit(360.0))), m=rad(357.52911 + jc * (35999.05029 - 0.0001537 * jc)),
        e=0.016708634 - jc * (0.000042037 + 0.0000001267 * jc), om=rad(125.04 - 1934.136 * jc),
    )
    m = c("m")
    centre = F.sin(m) * (1.914602 - jc * (0.004817 + 0.000014 * jc)) + F.sin(2 * m) * (0.019993 - 0.000101 * jc) + F.sin(3 * m) * 0.000289
    tilt = 23 + (26 + (21.448 - jc * (46.815 + jc * (0.00059 - 0.001813 * jc))) / 60) / 60 + 0.00256 * F.cos(c("om"))
    d = layer(d, lam=c("l0") + rad(centre - 0.00569 - 0.00478 * F.sin(c("om"))), tilt=rad(tilt))
    d = layer(d, y=F.pow(F.tan(c("tilt") / 2), 2.0), sin=F.sin(c("tilt")) * F.sin(c("lam")))
    y, e, l0 = c("y"), c("e"), c("l0")
    eot = 4 * deg(y * F.sin(2 * l0) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * e * e * F.sin(2 * m))
    d = layer(d, time=(F.pmod(c("jd") - 0.5, F.lit(1.0)) * 1440 + eot) / 4, cos=F.sqrt(1 - c("sin") * c("sin")))
    return d.drop(*(f"{name}_{k}" for k in ("jd", "jc", "l0", "m", "e", "om", "lam", "tilt", "y"))), Sun(c("time"), c("sin"), c("cos"))


def without_sun(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(f"{n}_{k}" for n in names for k in ("time", "sin", "cos")))


def zenith(s: Sun, lon: Column, lat: Column) -> Column:
    cos_z = F.sin(F.radians(lat)) * s.sin_dec + F.cos(F.radians(lat)) * s.cos_dec * F.cos(F.radians(s.solar_time + lon - 180))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_z))))


def threshold_lon(rise: Sun, set_: Sun) -> Column:
    lon = -(rise.solar_time + set_.solar_time + F.when(rise.solar_time < set_.solar_time, 360.0).otherwise(0.0)) / 2
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def threshold_lat(s: Sun, lon: Column, zenith_deg: Column, tol: Column) -> Column:
    """Null near the equinox (|sin declination| <= tol) and where the sun never has that zenith."""
    a, b = s.sin_dec, s.cos_dec * F.cos(F.radians(s.solar_time + lon - 180))
    cos_z = F.cos(F.radians(zenith_deg))
    root = a * a + b * b - cos_z * cos_z
    ratio = (a * cos_z - F.signum(a) * b * F.sqrt(F.greatest(root, F.lit(0.0)))) / (a * a + b * b)
    return F.when((F.abs(a) > tol) & (root >= 0) & (F.abs(ratio) <= 1), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def destination(lon: Column, lat: Column, bearing: Column, km: float) -> tuple[Column, Column]:
    """The point in that bearing (degrees) at that distance."""
    d, b, phi = km / 6371.0, F.radians(bearing), F.radians(lat)
    lat2 = F.asin(F.sin(phi) * F.cos(F.lit(d)) + F.cos(phi) * F.sin(F.lit(d)) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(F.lit(d)) * F.cos(phi), F.cos(F.lit(d)) - F.sin(phi) * F.sin(lat2))
    return F.pmod(F.degrees(lon2) + 180.0, F.lit(360.0)) - 180.0, F.degrees(lat2)
