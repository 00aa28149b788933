"""Geography as column expressions: a sphere of 6,371,000 m, degrees, metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6_371_000.0
#: Metres of a degree of latitude, as bounding boxes and local planes take it.
DEGREE_M, DEGREE_PLANE_M = 111_000.0, 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * R * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first place to the second, 0 to 360."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def cardinal(course: Column) -> Column:
    """The nearest of eight winds."""
    winds = F.array(*[F.lit(w) for w in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(winds, (F.floor((course + 22.5) / 45.0) % 8 + 1).cast("int"))


def planar_course(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Course on a local plane, as for one segment of a line."""
    dx = (lon2 - lon1) * DEGREE_PLANE_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(dx, (lat2 - lat1) * DEGREE_PLANE_M)) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two courses, 0 to 180."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def project_t(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """How far along a segment the nearest point to a place lies, 0 to 1, on the plane at the segment's mid-latitude."""
    k = F.cos(F.radians((lat1 + lat2) / 2))
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    n = dx * dx + dy * dy
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - lon1) * k * dx + (lat - lat1) * dy) / F.when(n != 0, n))))


def cross_track(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a place to a segment: across the great circle while the foot lies on it, else to the nearer end."""
    d13 = haversine(lat1, lon1, lat, lon) / R
    b13, b12 = F.radians(bearing(lat1, lon1, lat, lon)), F.radians(bearing(lat1, lon1, lat2, lon2))
    across = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d13) * F.sin(b13 - b12))))
    along = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(d13) / F.cos(across))))
    whole = haversine(lat1, lon1, lat2, lon2)
    return F.when(along * R <= whole, F.abs(across) * R).otherwise(F.least(haversine(lat, lon, lat1, lon1), haversine(lat, lon, lat2, lon2)))


def box(lat: Column, lon: Column, radius_m: Column | float) -> dict[str, Column]:
    """Bounds around a place."""
    dlat = F.lit(radius_m) / DEGREE_M if not isinstance(radius_m, Column) else radius_m / DEGREE_M
    dlon = dlat / F.cos(F.radians(lat))
    return {"south": lat - dlat, "north": lat + dlat, "west": lon - dlon, "east": lon + dlon}


def in_box(lat: Column, lon: Column, bounds: dict[str, Column]) -> Column:
    return lat.between(bounds["south"], bounds["north"]) & lon.between(bounds["west"], bounds["east"])


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a place lies in a closed ring of (lat, lon) structs, by counting crossings."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def ring_distance(lat: Column, lon: Column, ring: Column) -> Column:
    """Metres to the nearest edge of a ring."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def away(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = project_t(lat, lon, a["lat"], a["lon"], b["lat"], b["lon"])
        return haversine(lat, lon, a["lat"] + (b["lat"] - a["lat"]) * t, a["lon"] + (b["lon"] - a["lon"]) * t)

    return F.array_min(F.transform(edges, away))


def ring_centre(ring: Column) -> Column:
    """The mean of a closed ring's corners, the closing one left out."""
    corners = F.slice(ring, 1, F.size(ring) - 1)
    mean = lambda part: F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[part]) / F.size(corners)
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def closed(ring: Column) -> Column:
    """The ring, with its first corner repeated at the end unless it is there."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def to_wkt(points: Column, kind: str = "LINESTRING") -> Column:
    """Well-known text of an array of (lat, lon) structs, longitude first, six decimals."""
    inner = F.array_join(F.transform(points, lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])), ", ")
    return F.concat(F.lit(f"{kind}({'(' if kind == 'POLYGON' else ''}"), inner, F.lit("))" if kind == "POLYGON" else ")"))


def from_wkt(wkt: Column) -> Column:
    """The (lat, lon) structs of a LINESTRING or POLYGON text."""
    body = F.regexp_extract(wkt, r"\(+([^()]*)\)+", 1)
    return F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("lat"), F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("lon")))


def to_geojson(points: Column) -> Column:
    inner = F.array_join(F.transform(points, lambda p: F.format_string("[%.6f,%.6f]", p["lon"], p["lat"])), ",")
    return F.concat(F.lit('{"type":"LineString","coordinates":['), inner, F.lit("]}"))


def walk_minutes(metres: Column, per_minute: float = 83.33) -> Column:
    return F.ceil(metres / per_minute)


def cell(lat: Column, lon: Column, size_m: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are at least size_m wide below 60 degrees of latitude."""
    step = size_m / DEGREE_M
    return F.floor(lat / step).cast("bigint"), F.floor(lon / (2 * step)).cast("bigint")


def neighbour_cells(row: Column, column: Column) -> Column:
    """The cell and the eight around it, as structs."""
    return F.array(*[F.struct((row + i).alias("row"), (column + j).alias("column")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
