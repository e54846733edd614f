"""Geography, units and small statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaza.functions.text import either

EARTH_M = 6_371_000.0


def metres(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (haversine); null if a coordinate is."""
    a, b, c, d = (F.radians(either(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def valid_coordinates(lat, lon) -> Column:
    return F.coalesce(either(lat).between(-90, 90) & either(lon).between(-180, 180), F.lit(False))


def in_box(lat, lon, box) -> Column:
    """Within (south, west, north, east)."""
    return either(lat).between(box[0], box[2]) & either(lon).between(box[1], box[3])


def area_of(lat, lon, boxes, other: str) -> Column:
    """The name of the first box that holds the point."""
    out = None
    for name, box in boxes:
        inside = in_box(lat, lon, box)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(other)


def probability(value, unit: str) -> Column:
    """A share from percent or fraction; null out of bounds."""
    share = either(value) / 100 if unit == "percent" else either(value)
    return F.when(share.between(0, 1), share)


# The physical bounds of each variable, in its unit.
BOUNDS = {"temperature": (-90.0, 60.0), "dew_point": (-100.0, 40.0), "wind_speed": (0.0, 120.0), "wind_gust": (0.0, 150.0), "precipitation": (0.0, 2000.0), "snow": (0.0, 500.0), "cloud_cover": (0.0, 100.0), "pressure": (850.0, 1100.0)}


def bounded(value, variable: str) -> Column:
    low, high = BOUNDS[variable]
    return F.when(either(value).between(low, high), either(value))


def celsius(kelvin) -> Column:
    return either(kelvin) - 273.15


def price(column) -> Column:
    """The first amount after a dollar sign; null without one."""
    found = F.regexp_extract(either(column), "\\$ ?([0-9]+(?:\\.[0-9]{1,2})?)", 1)
    return F.when(found != "", found).cast("double")


def percent(part, total, digits: int = 1) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(either(total) == 0, F.lit(0.0)).otherwise(F.round(100.0 * either(part) / either(total), digits))


def lcg_draws(seed, n: int) -> Column:
    """The first ``n`` numbers of ``lcg`` after ``seed``, as an array."""
    step = lambda drawn, _: F.array_append(drawn, (F.coalesce(F.try_element_at(drawn, F.lit(-1)), either(seed)) * 1_664_525 + 1_013_904_223) % 4_294_967_296)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast("array<bigint>"), step)


def lcg(seed: int, n: int) -> list[int]:
    """The 32-bit linear congruential sequence 1664525 x + 1013904223."""
    out = []
    for _ in range(n):
        seed = (seed * 1_664_525 + 1_013_904_223) & 0xFFFFFFFF
        out.append(seed)
    return out


def quantile(values: list[float], p: float) -> float:
    """Linear between the two nearest ranks."""
    ordered = sorted(values)
    at = (len(ordered) - 1) * p
    low = math.floor(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF, JPEG or WebP file; None if it is none of them."""
    if not data or len(data) < 16:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and data[12:16] == b"VP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return None
