"""Points: a struct of lng and lat, its text codec, and distances."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.vocabulary import NO_LOCATION_LABEL

POINT = "struct<lng:double,lat:double>"
EARTH_RADIUS_M = 6371008.8
_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"


def point(lng: Column, lat: Column) -> Column:
    """Null unless both coordinates are there."""
    return F.when(lng.isNotNull() & lat.isNotNull(), F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat")))


def is_valid_point(p: Column) -> Column:
    return p["lng"].between(-180, 180) & p["lat"].between(-90, 90)


def to_wkt(p: Column) -> Column:
    return F.when(p.isNotNull(), F.concat(F.lit("SRID=4326;POINT("), p["lng"].cast("string"), F.lit(" "), p["lat"].cast("string"), F.lit(")")))


def from_wkt(text: Column) -> Column:
    pattern = rf"^\s*(?:SRID=4326;)?\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$"
    return point(F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("double"))


def point_text(p: Column) -> Column:
    """lat, lng with five decimals, or words for none."""
    return F.when(p.isNotNull(), F.format_string("%.5f, %.5f", p["lat"], p["lng"])).otherwise(F.lit(NO_LOCATION_LABEL))


def distance_m(a: Column, b: Column) -> Column:
    """Great-circle distance in metres."""
    lat1, lat2 = F.radians(a["lat"]), F.radians(b["lat"])
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((F.radians(b["lng"]) - F.radians(a["lng"])) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(half))


def in_box(p: Column, west: float, south: float, east: float, north: float) -> Column:
    return p["lng"].between(west, east) & p["lat"].between(south, north)


def within(p: Column, lng: float, lat: float, metres: float, cell: Column | None = None) -> Column:
    """A box that Parquet statistics can use comes before the exact distance. cell: the points' cells, whose ranges come first."""
    centre = F.struct(F.lit(lng).alias("lng"), F.lit(lat).alias("lat"))
    box = box_around(lng, lat, metres)
    near = in_box(p, *box) & (distance_m(p, centre) <= metres)
    return near if cell is None else in_ranges(cell, place_ranges(*box)) & near


#: Halvings of each axis that a cell's number holds: cells of some 600 m at the equator.
PLACE_BITS = 16


def _spread(x: Column) -> Column:
    """Bits of a 16-bit number, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _axis(value: Column, least: float, most: float) -> Column:
    cells = 1 << PLACE_BITS
    return F.least(F.greatest(F.floor((value - least) / (most - least) * cells), F.lit(0)), F.lit(cells - 1)).cast("long")


def place_cell(p: Column) -> Column:
    """A point's number on a Z-order curve over longitudes and latitudes: points of one square have numbers in one range. Null without both coordinates."""
    return _spread(_axis(p["lng"], -180, 180)).bitwiseOR(F.shiftleft(_spread(_axis(p["lat"], -90, 90)), 1))


def _numbers(value: float, least: float, most: float) -> int:
    cells = 1 << PLACE_BITS
    return min(max(math.floor((value - least) / (most - least) * cells), 0), cells - 1)


def place_ranges(west: float, south: float, east: float, north: float, most: int = 16) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cell numbers that hold all points of a box: squares of the curve, halved while their number allows."""
    box = _numbers(west, -180, 180), _numbers(south, -90, 90), _numbers(east, -180, 180), _numbers(north, -90, 90)
    squares = [(0, 0, PLACE_BITS)]
    while True:
        finer = []
        for x, y, level in squares:
            size = 1 << level
            inside = box[0] <= x and x + size - 1 <= box[2] and box[1] <= y and y + size - 1 <= box[3]
            if level == 0 or inside:
                finer.append((x, y, level))
                continue
            half = size >> 1
            for a, b in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
                if a <= box[2] and a + half - 1 >= box[0] and b <= box[3] and b + half - 1 >= box[1]:
                    finer.append((a, b, level - 1))
        found: list[tuple[int, int]] = []
        for low, size in sorted((sum(((x >> i & 1) | (y >> i & 1) << 1) << 2 * i for i in range(PLACE_BITS)), 1 << 2 * level) for x, y, level in finer):
            if found and found[-1][1] + 1 == low:
                found[-1] = (found[-1][0], low + size - 1)
            else:
                found.append((low, low + size - 1))
        if len(found) > most:
            return ranges
        ranges = found
        if finer == squares:
            return ranges
        squares = finer


def in_ranges(cell: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a cell lies in one of the ranges: bounds that reach the scan."""
    return reduce(or_, [(cell >= low) & (cell <= high) for low, high in ranges])


def box_around(lng: float, lat: float, metres: float) -> tuple[float, float, float, float]:
    """West, south, east and north of a box that holds all points within ``metres``; the whole circle of longitudes where it meets a pole or the date line."""
    dlat = math.degrees(metres / EARTH_RADIUS_M)
    dlng = 180.0 if abs(lat) + dlat >= 90 else math.degrees(metres / (EARTH_RADIUS_M * math.cos(math.radians(abs(lat) + dlat))))
    # A hair more than the distance, so that rounding loses no point of the rim.
    dlat, dlng = dlat * 1.000001 + 1e-9, dlng * 1.000001 + 1e-9
    if lng - dlng < -180 or lng + dlng > 180:
        return -180.0, max(lat - dlat, -90.0), 180.0, min(lat + dlat, 90.0)
    return lng - dlng, max(lat - dlat, -90.0), lng + dlng, min(lat + dlat, 90.0)
