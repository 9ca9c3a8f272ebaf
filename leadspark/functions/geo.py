"""Great-circle distance and Earth-centred grid cells as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of


def haversine_m(lat1, lon1, lat2, lon2, radius_km: float = 6371.0) -> Column:
    """Haversine distance in metres between two points given in degrees."""
    p1 = F.radians(col_of(lat1))
    p2 = F.radians(col_of(lat2))
    dp = F.radians(col_of(lat2) - col_of(lat1))
    dl = F.radians(col_of(lon2) - col_of(lon1))
    a = F.pow(F.sin(dp / 2.0), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2.0), 2)
    c = F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)) * 2.0
    return c * F.lit(radius_km) * F.lit(1000.0)


def ecef_m(lat, lon, radius_km: float = 6371.0) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z in metres on a sphere."""
    r = radius_km * 1000.0
    phi = F.radians(col_of(lat))
    lam = F.radians(col_of(lon))
    return (F.cos(phi) * F.cos(lam) * r, F.cos(phi) * F.sin(lam) * r, F.sin(phi) * r)


def cell_edge_m(metres: float, radius_km: float = 6371.0) -> float:
    """Grid edge so that any two points closer than ``metres`` along the
    sphere lie in the same or adjacent cells.

    The straight chord is never longer than the arc, so an edge equal to the
    threshold is enough; a small margin absorbs rounding of the trig
    functions.
    """
    return metres * (1.0 + 1e-9) + 1e-6


def cell_index(coord: Column, edge: float) -> Column:
    return F.floor(coord / F.lit(edge)).cast("long")
