"""Points on the globe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, null
from . import register

#: Fixed value: the radius in metres that distances are given for.
EARTH_RADIUS = 6_378_140.0


@register("point")
def point(m: Val) -> Val:
    if m.type == T.NULL:
        return null(T.POINT)
    if T.kind(m.type) != "map" or {k for k, _ in m.type[1]} != {"latitude", "longitude"}:
        raise T.TypeProblem("point() takes {latitude, longitude}")
    lat, lon = (m.col[k].cast("double") for k in ("latitude", "longitude"))
    bad = (F.abs(lat) > 90) | (F.abs(lon) > 180) | F.isnan(lat) | F.isnan(lon)
    made = F.struct(lat.alias("latitude"), lon.alias("longitude"))
    return Val(F.when(lat.isNull() | lon.isNull(), F.lit(None).cast(T.ddl(T.POINT))).when(bad, F.raise_error(F.lit("point(): out of range")).cast(T.ddl(T.POINT))).otherwise(made), T.POINT)


@register("distance")
def distance(p: Val, q: Val) -> Val:
    if p.type != T.POINT or q.type != T.POINT:
        return null(T.FLOAT)
    a, b = F.radians(p.col["latitude"]), F.radians(q.col["latitude"])
    dlon = F.radians(q.col["longitude"]) - F.radians(p.col["longitude"])
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return Val(F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.sqrt(h), F.lit(1.0))), T.FLOAT)
