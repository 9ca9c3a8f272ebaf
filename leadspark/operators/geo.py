"""Near-duplicate sites: all ordered pairs of distinct keys closer than a
distance, without a cross join.

Points are placed in an Earth-centred 3-D grid whose cell edge is twice the
threshold.  Two points closer than the threshold along the sphere are
closer than it along the chord, so they sit in the same or in adjacent
cells, and along each axis a point can only reach the neighbour on the side
whose face is nearer than the threshold.  One side is therefore copied to
the neighbour cells its threshold ball touches (8 of the 27: 3.4 times fewer
shuffled copies for a few more candidates per cell) and equi-joined with the
other side on the cell; the exact
haversine distance is the residual filter.  Poles and the antimeridian need
no special case in 3-D.

Skew: a cell holding very many sites (one building, a default geocode)
would put all its candidates into one task.  Cells are counted on both sides;
where either count exceeds ``block_rows``, both sides are cut into blocks of
about that many rows, and each pair of blocks is a join key of its own.  A task
then compares at most about ``block_rows`` squared pairs of a cell, however many
dense cells there are and however dense they are.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.functions.geo import cell_edge_m, cell_index, ecef_m, haversine_m
from leadspark.operators.cleanse import first_by
from leadspark.session import freeze

_OFFSETS = list(itertools.product((-1, 0, 1), repeat=3))


def sites(df: DataFrame, key: str = "MDM_CUST_KEY", lat: str = "LATITUDE", lon: str = "LONGITUDE") -> DataFrame:
    """One site per key: rows with a null key or coordinate go first, then the
    smallest (lat, lon) survives, so the pick is reproducible."""
    s = df.select(col_of(key).alias(key), col_of(lat).alias(lat), col_of(lon).alias(lon))
    # distinct sites are few and read several times by the pick: write them once
    s = freeze(s.na.drop(subset=[key, lat, lon]).distinct(), "site_lines")
    return first_by(s, key, [lat, lon])


def rounded_cells(df: DataFrame, lat: str = "LATITUDE", lon: str = "LONGITUDE", digits: int = 0) -> DataFrame:
    """Sites per rounded (lat, lon) cell."""
    return (df.groupBy(F.round(col_of(lat), digits).alias("LAT_ROUND"), F.round(col_of(lon), digits).alias("LON_ROUND"))
              .agg(F.count(F.lit(1)).alias("N_SITES")))


def _with_cells(df: DataFrame, lat: str, lon: str, edge: float, radius_km: float) -> DataFrame:
    x, y, z = ecef_m(lat, lon, radius_km)
    out = df
    for name, c in (("x", x), ("y", y), ("z", z)):
        out = out.withColumn(f"_{name}", c)
        out = out.withColumn(f"_c{name}", cell_index(F.col(f"_{name}"), edge))
    return out


def _reach(axis: str, edge: float, metres: float):
    """Whether the point's threshold ball crosses the lower / upper cell face on
    one axis (a micrometre of margin absorbs rounding; an extra neighbour is
    harmless, the distance filter is exact)."""
    pos = F.col(f"_{axis}") - F.col(f"_c{axis}") * F.lit(edge)     # 0 <= pos < edge
    reach = F.lit(metres + 1e-6)
    return pos < reach, (F.lit(edge) - pos) < reach


def _blocks(n: str, block_rows: int):
    return F.greatest(F.ceil(F.col(n) / F.lit(block_rows)), F.lit(1)).cast("int")


def candidates(df: DataFrame, key: str = "MDM_CUST_KEY", lat: str = "LATITUDE", lon: str = "LONGITUDE",
               metres: float = 5.0, radius_km: float = 6371.0, block_rows: int = 2048,
               cell_factor: float = 2.0) -> DataFrame:
    """Candidate pairs (k1, lat1, lon1, k2, lat2, lon2) of the grid join, before
    the exact distance filter: a superset of the near pairs."""
    edge = max(1.0, cell_factor) * cell_edge_m(metres, radius_km)
    pts = df.select(col_of(key).alias("_k"), col_of(lat).cast("double").alias("_lat"),
                    col_of(lon).cast("double").alias("_lon"))
    pts = pts.filter(F.col("_k").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
    # read several times below (cell counts, probe side, build side): write once
    pts = freeze(_with_cells(pts, "_lat", "_lon", edge, radius_km), "sites")
    cell = ["_cx", "_cy", "_cz"]

    # probe side: each point once, in its own cell
    a = pts.select(F.col("_k").alias("k1"), F.col("_lat").alias("lat1"), F.col("_lon").alias("lon1"), *cell)

    # build side: each point copied to the neighbour cells its threshold ball touches
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"))
                     for dx, dy, dz in _OFFSETS])
    faces = []
    for ax in ("x", "y", "z"):
        lo, hi = _reach(ax, edge, metres)
        faces += [lo.alias(f"_{ax}lo"), hi.alias(f"_{ax}hi")]
    b = pts.select(F.col("_k").alias("k2"), F.col("_lat").alias("lat2"), F.col("_lon").alias("lon2"), *cell, *faces)

    def allowed(o):
        ok = F.lit(True)
        for ax, d in (("x", "dx"), ("y", "dy"), ("z", "dz")):
            ok = ok & ((o[d] == 0) | ((o[d] == -1) & F.col(f"_{ax}lo")) | ((o[d] == 1) & F.col(f"_{ax}hi")))
        return ok
    b = b.select("k2", "lat2", "lon2", *cell, F.explode(F.filter(offs, allowed)).alias("_o"))
    b = b.select("k2", "lat2", "lon2",
                 (F.col("_cx") + F.col("_o.dx")).alias("_cx"),
                 (F.col("_cy") + F.col("_o.dy")).alias("_cy"),
                 (F.col("_cz") + F.col("_o.dz")).alias("_cz"))

    # cells with more than a block on either side: both sides are cut into blocks,
    # and each block of one side meets each block of the other in a task of its own
    na = a.groupBy(*cell).agg(F.count(F.lit(1)).alias("_na"))
    nb = b.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nb"))
    dense = na.join(nb, cell).filter((F.col("_na") > block_rows) | (F.col("_nb") > block_rows))
    dense = freeze(dense.select(*cell, _blocks("_na", block_rows).alias("_pa"),
                                _blocks("_nb", block_rows).alias("_pb")), "dense_cells")

    def blocked(side, key_col, own, other, own_out, other_out):
        d = side.join(dense, cell, "left").withColumn("_own", F.coalesce(own, F.lit(1)))
        d = d.withColumn(own_out, F.pmod(F.xxhash64(key_col), F.col("_own")).cast("int"))
        d = d.withColumn(other_out, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return d.drop("_own", "_pa", "_pb")
    a = blocked(a, "k1", F.col("_pa"), F.col("_pb"), "_ia", "_ib")
    b = blocked(b, "k2", F.col("_pb"), F.col("_pa"), "_ib", "_ia")
    return a.join(b, cell + ["_ia", "_ib"]).filter(F.col("k1") != F.col("k2"))


def near_pairs(df: DataFrame, key: str = "MDM_CUST_KEY", lat: str = "LATITUDE", lon: str = "LONGITUDE",
               metres: float = 5.0, radius_km: float = 6371.0, block_rows: int = 2048,
               suffixes=("_1", "_2"), cell_factor: float = 2.0) -> DataFrame:
    """Ordered pairs (k1, k2), k1 != k2, with haversine distance < ``metres``.

    ``df`` holds one site per key (see ``sites``); rows with null
    coordinates are ignored.  Output: key/lat/lon with suffixes + DISTANCE (m).
    ``cell_factor`` = cell edge / threshold (1 copies every site to all 27
    neighbours; 2 to the 8 its threshold ball touches).
    """
    s1, s2 = suffixes
    j = candidates(df, key, lat, lon, metres, radius_km, block_rows, cell_factor)
    dist = haversine_m("lat1", "lon1", "lat2", "lon2", radius_km)
    j = j.withColumn("DISTANCE", dist).filter(F.col("DISTANCE") < metres)
    return j.select(F.col("k1").alias(key + s1), F.col("lat1").alias(lat + s1), F.col("lon1").alias(lon + s1),
                    F.col("k2").alias(key + s2), F.col("lat2").alias(lat + s2), F.col("lon2").alias(lon + s2),
                    "DISTANCE")
