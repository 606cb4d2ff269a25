"""Great-circle and planar geometry as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, js_round_long

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; NULL in gives NULL out."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = F.radians(col(lat2) - col(lat1)), F.radians(col(lon2) - col(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * F.lit(1000.0)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def distance_text(meters: Column | str) -> Column:
    """Feet below a tenth of a mile, else miles with one decimal."""
    m = col(meters)
    miles = m / F.lit(1609.344)
    return (F.when(miles < 0.1, F.concat(js_round_long(m * F.lit(3.28084)).cast("string"), F.lit(" ft")))
            .otherwise(F.concat(F.format_string("%.1f", miles), F.lit(" mi"))))


def cell(value: Column | str, size: float) -> Column:
    return F.floor(col(value) / F.lit(size)).cast("bigint")


def segment_share(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Share along a segment of the point nearest to (lat, lon), measured in degrees."""
    dx, dy = col(lon2) - col(lon1), col(lat2) - col(lat1)
    length2 = dx * dx + dy * dy
    along = ((col(lon) - col(lon1)) * dx + (col(lat) - col(lat1)) * dy) / F.when(length2 > 0, length2)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))


# Fixed value: metres of one degree of latitude on the sphere used here.
METRES_PER_DEGREE = EARTH_KM * 1000 * math.pi / 180


# ---- a grid for radius searches ----------------------------------------------------------
#
# Bands of latitude are as high as the radius. Each band has its own whole number of columns around the globe, none
# narrower than the radius at the band's far side, one band further still. So points within the radius lie in the same or in
# neighbouring cells, at every latitude and across the antimeridian.


def _band_height(metres: float) -> float:
    return metres / METRES_PER_DEGREE * 1.0001


def _columns(band: Column, metres: float) -> Column:
    """Number of columns of a band."""
    height = _band_height(metres)
    far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * height + height, F.lit(90.0))
    reach = F.sin(F.lit(metres / (2000 * EARTH_KM))) / F.cos(F.radians(far))
    width = F.degrees(2 * F.asin(F.least(reach, F.lit(1.0)))) * 1.0001
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("bigint")


def _column(lon: Column, columns: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * columns), columns - 1).cast("bigint")


def grid_cell(lat: Column | str, lon: Column | str, metres: float) -> Column:
    """The cell of a point: struct (_cy, _cx)."""
    band = cell(lat, _band_height(metres))
    return F.struct(band.alias("_cy"), _column(col(lon), _columns(band, metres)).alias("_cx"))


def cells_of_box(lat1, lon1, lat2, lon2, metres: float) -> Column:
    """Cells, each once, that hold every point within ``metres`` of a box given by two corners; the shorter way around the globe."""
    height = _band_height(metres)
    turn = F.abs(col(lon1) - col(lon2)) > 180.0
    west = F.when(turn, F.greatest(col(lon1), col(lon2))).otherwise(F.least(col(lon1), col(lon2)))
    east = F.when(turn, F.least(col(lon1), col(lon2)) + 360.0).otherwise(F.greatest(col(lon1), col(lon2)))
    bands = F.sequence(cell(F.least(col(lat1), col(lat2)), height) - 1, cell(F.greatest(col(lat1), col(lat2)), height) + 1)

    def of_band(band: Column) -> Column:
        columns = _columns(band, metres)
        first = F.floor((west + 180.0) / 360.0 * columns) - 1
        last = F.least(F.floor((east + 180.0) / 360.0 * columns) + 1, first + columns - 1 + F.lit(2))
        return F.array_distinct(F.transform(F.sequence(first, F.greatest(last, first)), lambda x: F.struct(
            band.alias("_cy"), F.pmod(x, columns).cast("bigint").alias("_cx"))))

    return F.flatten(F.transform(bands, of_band))


def cells_around(lat, lon, metres: float) -> Column:
    """Cells, each once, that hold every point within ``metres`` of a point."""
    return cells_of_box(lat, lon, lat, lon, metres)
