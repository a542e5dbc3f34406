"""Integer E5 coordinates, cells and distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def to_e5(deg: Column) -> Column:
    return F.round(deg * fixed.E5).cast("int")


def from_e5(e5: Column) -> Column:
    return e5 / F.lit(float(fixed.E5))


def cell(e5: Column) -> Column:
    """Nearest 0.001-degree cell of an E5 coordinate, ties upward."""
    half = fixed.CELL_E5 // 2
    return F.floor((e5 + half) / float(fixed.CELL_E5)).cast("int")


def grid(e5: Column, size: int | Column) -> Column:
    return F.floor(e5 / (float(size) if isinstance(size, int) else size)).cast("int")


def cell_id(lat_e5: Column, lng_e5: Column) -> Column:
    """Stable 'lat_lng' text with four decimals, ties upward."""
    four = [F.floor((c + 5) / 10.0) / 10000.0 for c in (lat_e5, lng_e5)]
    return F.format_string("%.4f_%.4f", *four)


def planar_sq(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared planar metres between E5 points, longitude scaled at the first point."""
    dy = (lat1 - lat2) * fixed.E5_METRES
    dx = (lng1 - lng2) * fixed.E5_METRES * F.cos(F.radians(from_e5(lat1)))
    return dy * dy + dx * dx


def planar_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt(planar_sq(lat1, lng1, lat2, lng2))


def equirect_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between E5 points, longitude scaled at the mean latitude."""
    x = F.radians(from_e5(lng2) - from_e5(lng1)) * F.cos(
        F.radians((from_e5(lat1) + from_e5(lat2)) / 2)
    )
    y = F.radians(from_e5(lat2) - from_e5(lat1))
    return F.sqrt(x * x + y * y) * fixed.EARTH_RADIUS_M


def mercator_tile(lat_e5: Column, lng_e5: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2 ** zoom)
    rad = F.radians(from_e5(lat_e5))
    x = F.floor((from_e5(lng_e5) + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * n)
    return x.cast("int"), y.cast("int")


def hex_axial(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial hexagon address of a planar point, by rounding cube coordinates."""
    q = x * (2.0 / 3.0) / size
    r = (x * (-1.0 / 3.0) + y * (3.0 ** 0.5 / 3.0)) / size
    s = -q - r
    rq, rr, rs = (F.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_worst = (dq > ds) & (dq > dr)
    s_worst = ~q_worst & (ds > dr)
    hq = F.when(q_worst, -rs - rr).otherwise(rq)
    hr = F.when(q_worst | s_worst, rr).otherwise(-rq - rs)
    return hq.cast("int"), hr.cast("int")


#: Metres that weigh as much as a year in an image's score.
IMAGE_METRES = 40


def image_score(age_years: Column, metres: Column, pano: Column) -> Column:
    return age_years + metres / IMAGE_METRES + F.when(pano, 1.5).otherwise(0.0)
