"""Column expressions for point text, distances and neighbourhood cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EARTH_DIAMETER = 12742000.0
METRES_PER_DEGREE = 111194.9  # rounded down, so a cell is never smaller than asked for

# The three accepted shapes of point text.
STRICT_POINT = r"^POINT \((-?\d+(?:\.\d+)?) (-?\d+(?:\.\d+)?)\)$"
WHOLE_POINT = r"^POINT\s*\(\s*([-+\d.eE]+)\s+([-+\d.eE]+)\s*\)$"
LOOSE_POINT = r"POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)"


def point_part(text: Column, pattern: str, part: int) -> Column:
    """Longitude (1) or latitude (2) of point text, null where it does not read."""
    return F.nullif(F.regexp_extract(text, pattern, part), F.lit("")).try_cast("double")


def in_range(lon: Column, lat: Column) -> Column:
    """True for finite coordinates on the globe; false (never null) otherwise."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def metres_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6,371 km."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dphi = F.sin((phi2 - phi1) / 2)
    half_dlam = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_dphi * half_dphi + F.cos(phi1) * F.cos(phi2) * half_dlam * half_dlam
    return F.lit(EARTH_DIAMETER) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def band_of(lat: Column, metres: float) -> Column:
    """Latitude band; points within `metres` of each other are in touching bands."""
    return F.floor((lat + 90.0) / (metres * 1.001 / METRES_PER_DEGREE)).cast("bigint")


def cells_in_band(band: Column, metres: float) -> Column:
    """How many columns divide a band so that each is at least `metres` wide.

    The narrowest circle of the band and its neighbours sets the width, so the
    neighbouring column always suffices however close to a pole the band lies.
    """
    height = metres * 1.001 / METRES_PER_DEGREE
    edge = F.least(
        F.lit(90.0),
        F.greatest(F.abs((band - 1) * height - 90.0), F.abs((band + 2) * height - 90.0)),
    )
    around = F.cos(F.radians(edge)) * F.lit(360.0 * METRES_PER_DEGREE / (metres * 1.001))
    return F.greatest(F.lit(1), F.floor(around).cast("bigint")).cast("bigint")


def column_of(lon: Column, count: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * count).cast("bigint"), count)


def cell_of(lon: Column, lat: Column, metres: float) -> Column:
    band = band_of(lat, metres)
    return F.struct(band.alias("band"), column_of(lon, cells_in_band(band, metres)).alias("col"))


def explode_neighbour_cells(points: DataFrame, lon: str, lat: str, metres: float) -> DataFrame:
    """Repeat each point for every cell that can hold another within `metres`: at most nine.

    Bands are exploded before columns, so each band's width is worked out once.
    """
    own = band_of(F.col(lat), metres)
    bands = points.withColumn("_band", F.explode(F.array(own - 1, own, own + 1))).withColumn(
        "_count", cells_in_band(F.col("_band"), metres)
    )
    middle = column_of(F.col(lon), F.col("_count"))
    sides = F.array_distinct(F.array(*[F.pmod(middle + side, F.col("_count")) for side in (-1, 0, 1)]))
    return (
        bands.withColumn("_col", F.explode(sides))
        .withColumn("cell", F.struct(F.col("_band").alias("band"), F.col("_col").alias("col")))
        .drop("_band", "_count", "_col")
    )
