"""Vector and set-vector expressions over arrays, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.array(x, y, z)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle_deg(a: Column, b: Column) -> Column:
    """Angle in degrees; null where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / length)))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def rmsd(a: Column, b: Column) -> Column:
    """Root mean square of the differences of two equally long vectors, without alignment."""
    delta = subtract(a, b)
    return F.sqrt(dot(delta, delta) / F.size(a))


def _counts(a: Column, b: Column, threshold: float) -> tuple[Column, Column]:
    both = F.zip_with(a, b, lambda x, y: F.when((x > threshold) & (y > threshold), 1).otherwise(0))
    either = F.zip_with(a, b, lambda x, y: F.when((x > threshold) | (y > threshold), 1).otherwise(0))
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    return total(both), total(either)


def tanimoto(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Similarity of the sets of elements above the threshold; 0 for two empty sets."""
    c, u = _counts(a, b, threshold)
    return F.when(u == 0, 0.0).otherwise(c / u)


def jaccard_distance(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Distance of the sets of elements above the threshold; 0 for two empty sets."""
    c, u = _counts(a, b, threshold)
    return F.when(u == 0, 0.0).otherwise(1 - c / u)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(a: Column) -> Column:
    """The vector of length 1 in the same direction; null where there is none."""
    length = norm(a)
    return F.when(length > 0, scale(a, 1 / length))


def centroid(points: Column) -> Column:
    """Mean of an array of points of three coordinates; null for an empty one."""
    n = F.size(points)
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[i]) / n
    return F.when(n > 0, vec(mean(0), mean(1), mean(2)))


def placed_beyond(anchor: Column, origin: Column, length: float) -> Column:
    """The point ``length`` beyond the anchor, seen from the origin; null where they coincide."""
    return add(anchor, scale(unit(subtract(anchor, origin)), F.lit(length)))


def placed_in_plane(anchor: Column, origin: Column, normal: Column, length: float) -> Column:
    """As placed_beyond, with the direction projected on the plane of the (unit) normal."""
    way = subtract(anchor, origin)
    return add(anchor, scale(unit(subtract(way, scale(normal, dot(way, normal)))), F.lit(length)))


def face(normal: Column, center: Column, point: Column, small: float = 1e-6) -> Column:
    """Which face of a ring a point lies on: toward, away, or ambiguous (in the plane); null where a part is."""
    d = dot(normal, subtract(point, center))
    return F.when(F.abs(d) < small, "ambiguous").when(d > 0, "toward").when(d <= 0, "away")


def weighted_vector(text: Column) -> Column:
    """Numbers written as a JSON list, as a JSON object (by sorted key) or with blanks or commas between them, as an
    array; null where a part is no number, or nothing is there."""
    t = F.trim(text)
    as_list = F.from_json(t, "array<string>")
    as_map = F.from_json(t, "map<string,string>")
    parts = F.filter(F.split(F.translate(t, ",", " "), r"\s+"), lambda x: x != "")
    raw = F.when(t.startswith("["), as_list).when(t.startswith("{"), F.transform(F.array_sort(F.map_keys(as_map)), lambda k: F.element_at(as_map, k))).otherwise(parts)
    numbers = F.transform(raw, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x)), numbers)
