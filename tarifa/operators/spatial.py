"""Spatial operators: nearest reference point (J6), k-nearest neighbours (J7), kernel
density (J8) and nearest area (J9).

Scale design. No operator emits query × point pair rows. Both sides are binned into grid
cells and each cell is packed into hash chunks of bounded size (a hot cell becomes many
chunks, so one dense spot spreads over many tasks). A query chunk joins the point chunks of
its 3×3 ring of cells — an equi-join on the cell key, which AQE can broadcast or split when
skewed — and ``mapInPandas`` evaluates each (query block, point block) pair as one NumPy
matrix over Arrow batches. Partial results merge with a groupBy on the query key. Results
stay exact:

* nearest / kNN: a query is final when its k-th distance is within the ring's guaranteed
  radius; the rest repeat with doubled cells, until a cell spans the whole extent;
* KDE: sums of Gaussians are carried from box to box as expansions, in work proportional to the rows
  (terms beyond 9 bandwidths, below e^-40 of the self term, are left out); ``exact=True`` pairs all blocks.

Longitudes wrap: with the haversine metric the grid has a whole number of columns around the
globe and the ring of an edge cell continues on the other side. A point set that fits one
block uses a single cell: every query block meets it.
"""

from __future__ import annotations

import contextlib
import math
from fractions import Fraction

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine
from ..session import checkpoint as _ckpt

# Fixed values that must equal the reference's results: built-in reference points used
# when no point file is given, as (latitude, longitude).
FALLBACK_METRO = [(-22.9068, -43.1729), (-22.9511, -43.1837), (-22.9644, -43.1809),
                  (-22.9847, -43.1986), (-23.0075, -43.3117)]
FALLBACK_COAST = [(-23.015, -43.370), (-22.988, -43.200), (-22.971, -43.179), (-22.925, -43.167)]
# Reference defaults for the area attributes when no area table is given.
AREA_DEFAULTS = {"dist_favela_m": 1200.0, "favela_cercana_size": 1000,
                 "favela_densidad_viviendas": 50.0, "favela_vulnerabilidad_salud": 0.5}

SMALL_POINTS = 20000
RING = 32               # point blocks in one row
PAIRS = 1 << 20         # distances a task holds at a time
TASK_PAIRS = 20_000_000  # distances of a task, about, up to eight tasks a core
ORDER = 20              # terms of a box's expansion per dimension
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


# ------------------------------------------------------------------ metrics
def _euclid(qx: Column, qy: Column, px: Column, py: Column) -> Column:
    dx = px - qx
    dy = py - qy
    return F.sqrt(dx * dx + dy * dy)


def _hav(qx: Column, qy: Column, px: Column, py: Column) -> Column:
    # x = longitude, y = latitude
    return haversine(qy, qx, py, px)


METRICS = {"euclid": _euclid, "haversine": _hav}


def _ring_bound(metric: str, cell: float, max_abs_lat: float) -> float:
    """Smallest possible distance from a query to any point outside its 3×3 ring."""
    if metric == "euclid":
        return cell
    r = math.radians(cell)
    lat_bound = EARTH_RADIUS_M * r
    coslat = math.cos(math.radians(min(max_abs_lat + cell, 89.999)))
    lon_bound = 2 * EARTH_RADIUS_M * math.asin(min(1.0, coslat * math.sin(r / 2)))
    return min(lat_bound, lon_bound)


# ------------------------------------------------------------------ blocks
def _columns_around(metric: str, cell: float | None) -> int | None:
    """Whole number of grid columns around the globe, each at least ``cell`` degrees wide."""
    return max(1, math.floor(360.0 / cell)) if metric == "haversine" and cell is not None else None


def _cell_x(x: Column, cell: float, around: int | None) -> Column:
    if around is None:
        return F.floor(x / cell).cast("long")
    return F.pmod(F.floor((x + 180.0) / (360.0 / around)).cast("long"), F.lit(around).cast("long"))


def _blocks(df: DataFrame, x: str, y: str, cols, cell: float | None, chunk: int, prefix: str,
            n_total: int | None = None, around: int | None = None) -> DataFrame:
    """Bin rows into grid cells (one cell when ``cell`` is None) and pack each cell into
    hash chunks of about ``chunk`` rows: ``(cx, cy, blk, <prefix>x, <prefix>y, <prefix><col>…)``
    with one array per column (same element order). A hot cell becomes many chunks."""
    if cell is None:
        cx, cy = F.lit(0).cast("long"), F.lit(0).cast("long")
    else:
        cx = _cell_x(F.col(x), cell, around)
        cy = F.floor(F.col(y) / cell).cast("long")
    cols = [c for c in cols if c not in (x, y)]
    b = df.select(cx.alias("cx"), cy.alias("cy"), F.col(x).alias("_x"), F.col(y).alias("_y"), *cols)
    if cell is None:
        # one cell: the chunk count follows from the known row count
        nchunks = F.lit(max(1, math.ceil((n_total or 1) / chunk)))
    else:
        counts = b.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_n"))
        b = b.join(counts, ["cx", "cy"])
        nchunks = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(chunk)))
    b = b.withColumn("blk", F.pmod(F.xxhash64("_x", "_y", *cols), nchunks))
    packed = b.groupBy("cx", "cy", "blk").agg(F.collect_list(F.struct("_x", "_y", *cols)).alias("_a"))
    return packed.select("cx", "cy", "blk", F.col("_a._x").alias(f"{prefix}x"), F.col("_a._y").alias(f"{prefix}y"),
                         *[F.col(f"_a.{c}").alias(f"{prefix}{c}") for c in cols])


def _block_pairs(queries: DataFrame, qx: str, qy: str, qcols, points: DataFrame, px: str, py: str,
                 payload, cell: float | None, qchunk: int, pchunk: int, n_points: int,
                 n_queries: int | None = None, around: int | None = None) -> DataFrame:
    """Each query block paired with every point block it must meet, by equi-joins only:

    * grid (``cell``): the point blocks of the 3×3 ring of cells (join on the cell key);
    * one cell: each query block is replicated once per point-block id 0…P−1 (P =
      ⌈n_points / pchunk⌉, a bounded fan-out) and joined on that id.

    No query × point rows are formed: a pair of blocks is one row."""
    qb = _blocks(queries, qx, qy, list(qcols), cell, qchunk, "q_", n_total=n_queries, around=around).drop("blk")
    pb = _blocks(points, px, py, list(payload), cell, pchunk, "p_", n_total=n_points, around=around)
    if cell is not None:
        offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                         for dx in ((-1, 0, 1) if around is None or around > 2 else range(around)) for dy in (-1, 0, 1)])
        cx = F.col("cx") + F.col("_o.dx")
        qb = qb.withColumn("_o", F.explode(offs)) \
            .withColumn("cx", cx if around is None else F.pmod(cx, F.lit(around).cast("long"))) \
            .withColumn("cy", F.col("cy") + F.col("_o.dy")).drop("_o")
        return qb.join(pb, ["cx", "cy"]).drop("cx", "cy", "blk")
    nblk = max(1, math.ceil(n_points / pchunk))
    qb = qb.drop("cx", "cy").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nblk - 1).cast("long"))))
    return qb.join(pb.drop("cx", "cy"), "blk").drop("blk")


@contextlib.contextmanager
def _small_arrow_batches(spark, rows: int = 16):
    """One input row carries two blocks of up to a few thousand values: small Arrow batches while the
    pairs are evaluated, the session's own setting afterwards."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def _np_dist(metric: str, qx, qy, px, py):
    """Distances of paired (or broadcast) coordinates with the same operation order as the Column versions."""
    import numpy as np
    if metric == "euclid":
        dx = px - qx
        dy = py - qy
        return np.sqrt(dx * dx + dy * dy)
    dphi = np.radians(py - qy)
    dlmb = np.radians(px - qx)
    a = np.sin(dphi / 2) ** 2 + np.cos(np.radians(qy)) * np.cos(np.radians(py)) * np.sin(dlmb / 2) ** 2
    return EARTH_RADIUS_M * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _near_pairs(metric: str, qx, qy, px, py, k: int):
    """(query, point) places that hold the ``k`` nearest points of each query by (round(d, 9), any tie rule): all points up to the k-th
    smallest straight-line distance and a margin well above its rounding."""
    import numpy as np
    if metric == "euclid":
        q, p, unit = (qx, qy), (px, py), 1.0
    else:
        def sphere(x, y):
            lon, lat = np.radians(x), np.radians(y)
            return np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)
        q, p, unit = sphere(qx, qy), sphere(px, py), EARTH_RADIUS_M
    c = sum((b[None, :] - a[:, None]) ** 2 for a, b in zip(q, p))
    if k >= len(px):
        return np.divmod(np.arange(c.size), len(px))
    top = np.sqrt(np.partition(c, k - 1, axis=1)[:, k - 1])
    return np.nonzero(~(c > ((top * (1 + 1e-12) + 1e-14 + 2e-9 / unit) ** 2)[:, None]))


def _ring_pairs(queries: DataFrame, points: DataFrame, payload, cell: float, qchunk: int, pchunk: int, around: int | None, tasks: int) -> DataFrame:
    """Each query block beside all points of its 3×3 ring of cells, in rows of at most about ``RING`` point blocks: a query's nearest
    points then leave one row, and not one for each point block. ``tasks`` partitions, whatever few bytes the blocks have."""
    qb = _blocks(queries, "qx", "qy", ["key"], cell, qchunk, "q_", around=around).drop("blk")
    pb = _blocks(points, "px", "py", list(payload), cell, pchunk, "p_", around=around)
    cols = [c for c in pb.columns if c.startswith("p_")]
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in ((-1, 0, 1) if around is None or around > 2 else range(around)) for dy in (-1, 0, 1)])
    cx = F.col("cx") + F.col("_o.dx")
    near = pb.withColumn("blk", F.xxhash64("cx", "cy", "blk")).withColumn("_o", F.explode(offs)) \
        .withColumn("cx", cx if around is None else F.pmod(cx, F.lit(around).cast("long"))).withColumn("cy", F.col("cy") + F.col("_o.dy")).drop("_o")
    near = near.join(qb.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    parts = near.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / F.lit(RING)).alias("_parts"))
    rings = near.join(parts, ["cx", "cy"]).groupBy("cx", "cy", F.pmod("blk", F.col("_parts")).alias("_part")) \
        .agg(F.collect_list(F.struct(*cols)).alias("_a")).select("cx", "cy", *[F.flatten(F.col(f"_a.{c}")).alias(c) for c in cols])
    return qb.repartition(tasks, "cx", "cy").join(rings.repartition(tasks, "cx", "cy"), ["cx", "cy"]).drop("cx", "cy")


def _densest_fit(points: DataFrame, x: str, y: str, cell: float, max_points: int, max_halvings: int = 16) -> float:
    """Halve the starting cell until the densest cell holds at most ``max_points`` points. One job: the
    finest grid is counted once and its counts are added up for every coarser one. Dense spots then
    resolve at fine cells while sparse queries climb the doubling levels, so a spot holding a third of
    all points never pairs each of its queries with all of its points."""
    fine = cell / 2 ** max_halvings
    counts = points.groupBy(F.floor(F.col(x) / fine).alias("cx"), F.floor(F.col(y) / fine).alias("cy")) \
        .agg(F.count(F.lit(1)).alias("n"))
    up = counts.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(max_halvings))))
    side = F.pow(F.lit(2.0), F.col("up"))
    densest = {r["up"]: r["n"] for r in up.groupBy("up", F.floor(F.col("cx") / side).alias("cx"), F.floor(F.col("cy") / side).alias("cy"))
               .agg(F.sum("n").alias("n")).groupBy("up").agg(F.max("n").alias("n")).collect()}
    fits = [u for u, n in densest.items() if n <= max_points]
    return fine * 2 ** max(fits, default=0) if densest else cell


def _extent(queries: DataFrame, qx: str, qy: str, points: DataFrame, px: str, py: str) -> dict:
    """Scalars only: bounding box of queries ∪ points and the point count."""
    a = queries.agg(F.min(qx).alias("x0"), F.max(qx).alias("x1"), F.min(qy).alias("y0"),
                    F.max(qy).alias("y1"), F.count(F.lit(1)).alias("n")).first()
    b = points.agg(F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"),
                   F.max(py).alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if b["n"] == 0 or a["n"] == 0:
        return {"n_points": b["n"], "n_queries": a["n"], "extent": 0.0, "max_abs_lat": 0.0, "area": 0.0}
    x0, x1 = min(a["x0"], b["x0"]), max(a["x1"], b["x1"])
    y0, y1 = min(a["y0"], b["y0"]), max(a["y1"], b["y1"])
    return {"n_points": b["n"], "n_queries": a["n"], "extent": max(x1 - x0, y1 - y0, 1e-9),
            "area": max((x1 - x0) * (y1 - y0), 1e-12), "max_abs_lat": max(abs(y0), abs(y1))}


# ------------------------------------------------------------------ top-k nearest (core)
def _topk_kernel(metric: str, k: int, qkey: str, tie: str | None, payload):
    """mapInPandas kernel: per (query block, point block) the k best points of each query,
    ordered by (round(d, 9), tie); emitted as rows (qkey, rd, tie, d, payload…). The straight-line
    distances choose the candidates, only these are measured and sorted."""
    extra = [c for c in payload if c != tie]

    def run(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            outs = []
            for r in pdf.itertuples(index=False):
                qk, qxs, qys = np.asarray(r.q_key), np.asarray(r.q_x, float), np.asarray(r.q_y, float)
                pxs, pys = np.asarray(r.p_x, float), np.asarray(r.p_y, float)
                nq, npt = len(qk), len(pxs)
                if nq == 0 or npt == 0:
                    continue
                ties = np.asarray(getattr(r, f"p_{tie}")) if tie else np.arange(npt)
                kk, step = min(k, npt), max(1, PAIRS // npt)
                for at in range(0, nq, step):
                    rows, cols = _near_pairs(metric, qxs[at:at + step], qys[at:at + step], pxs, pys, kk)
                    rows += at
                    d = _np_dist(metric, qxs[rows], qys[rows], pxs[cols], pys[cols])
                    rd = np.round(d, 9)
                    order = np.lexsort((ties[cols], rd, rows))
                    first = np.searchsorted(rows[order], rows[order])
                    order = order[np.arange(len(order)) - first < kk]
                    rows, cols = rows[order], cols[order]
                    o = {qkey: qk[rows], "rd": rd[order], "d": d[order]}
                    if tie:
                        o["tie"] = ties[cols]
                    for c in extra:
                        o[c] = np.asarray(getattr(r, f"p_{c}"))[cols]
                    outs.append(pd.DataFrame(o))
            if outs:
                yield pd.concat(outs, ignore_index=True)
    return run


def _closest_of_spot(points: DataFrame, px: str, py: str, k: int, tie: str | None) -> DataFrame:
    """Of the points on one coordinate the ``k`` first by ``tie``: the others are nobody's k nearest. The rank limit is
    applied before the shuffle too, so a coordinate that holds a third of all points sends k rows a task."""
    w = Window.partitionBy(px, py).orderBy(tie or px)
    return points.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def nearest_k(queries: DataFrame, qkey: str, qx: str, qy: str, points: DataFrame, px: str, py: str,
              k: int, payload=(), tie: str | None = None, metric: str = "euclid",
              cell: float | None = None, qchunk: int = 256, chunk: int = 2048,
              small_points: int = SMALL_POINTS, out: str = "nn", min_points: int = 0) -> DataFrame:
    """For each query row ``(qkey, …)``: ``out`` = the k nearest points as an array of
    ``struct(rd, tie, d, payload…)`` sorted by (round(d, 9), tie). Exact.

    Points on one coordinate are cut to the k that can count, and each distinct query coordinate is searched once, so
    co-located hotels do not pair with each other."""
    spot = F.concat_ws(",", F.col(qx).cast("double") + F.lit(0.0), F.col(qy).cast("double") + F.lit(0.0))   # one text per coordinate
    asked = queries.select(F.col(qkey), spot.alias("_spot"))
    spots = queries.where(F.col(qx).isNotNull() & F.col(qy).isNotNull()).groupBy(spot.alias("_spot")).agg(F.first(qx).alias("_sx"), F.first(qy).alias("_sy"))
    if min_points and (n := points.count()) < min_points:
        raise ValueError(f"need at least {min_points} points, got {n}")
    nn = _nearest_spots(spots, "_spot", "_sx", "_sy", _closest_of_spot(points, px, py, k, tie), px, py, k, payload, tie, metric, cell, qchunk,
                        chunk, small_points, out)
    kind = nn.schema[out].dataType
    return asked.join(nn, "_spot", "left").select(qkey, F.coalesce(F.col(out), F.array().cast(kind)).alias(out))


def _nearest_spots(queries: DataFrame, qkey: str, qx: str, qy: str, points: DataFrame, px: str, py: str, k: int, payload, tie, metric: str,
                   cell: float | None, qchunk: int, chunk: int, small_points: int, out: str) -> DataFrame:
    payload = list(payload)
    if tie and tie not in payload:
        payload = [tie] + payload
    spark = queries.sparkSession
    # both inputs are read several times (extent, blocks, each level): keep them, spilling
    # to disk when memory is short; the per-level results are checkpointed below
    q = queries.select(F.col(qkey).alias("key"), F.col(qx).alias("qx"), F.col(qy).alias("qy")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    pts = points.select(F.col(px).alias("px"), F.col(py).alias("py"), *payload).persist(StorageLevel.MEMORY_AND_DISK)
    info = _extent(q, "qx", "qy", pts, "px", "py")
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    ktype = dict((f.name, f.dataType.simpleString()) for f in queries.schema.fields)[qkey]
    fields = ["rd double"] + ([f"tie {types[tie]}"] if tie else []) + ["d double"] + \
        [f"`{c}` {types[c]}" for c in payload if c != tie]
    elem = "struct<" + ",".join(f.replace(" ", ":") for f in fields) + ">"
    if info["n_points"] == 0:
        q.unpersist()
        pts.unpersist()
        return queries.select(qkey).withColumn(out, F.array().cast(f"array<{elem}>"))
    schema = f"`{qkey}` {ktype}, " + ", ".join(fields)
    kernel = _topk_kernel(metric, k, qkey, tie, payload)
    struct_cols = [F.col("rd")] + ([F.col("tie")] if tie else []) + [F.col("d")] + \
        [F.col(c) for c in payload if c != tie]
    if info["n_points"] <= min(small_points, chunk) and cell is None:
        levels = [None]  # the points fit in one block: every query block meets it
    else:
        if cell is None:
            # a cell of a few hundred points at uniform density: the 3×3 ring then holds
            # far more than k candidates and each block is a sizeable NumPy matrix
            per_cell = max(4.0 * k / 9.0, chunk / 4.0)
            cell = math.sqrt(per_cell * info["area"] / info["n_points"])
            cell = _densest_fit(pts, "px", "py", cell, 4 * chunk)
        levels = []
    pending, left = q, info["n_queries"]
    done = []
    while True:
        cur = levels[0] if levels else cell
        last = cur is None or cur >= info["extent"]
        if cur is None:
            pairs = _block_pairs(pending, "qx", "qy", ["key"], pts, "px", "py", payload, cur, qchunk, chunk, info["n_points"], info["n_queries"])
        else:
            met = left * min(info["n_points"], 9 * cur * cur * info["n_points"] / info["area"])
            tasks = int(max(1, min(8 * spark.sparkContext.defaultParallelism, math.ceil(met / TASK_PAIRS))))
            pairs = _ring_pairs(pending, pts, payload, cur, qchunk, chunk, _columns_around(metric, cur), tasks)
        best = pairs.mapInPandas(kernel, schema)
        merged = best.groupBy(qkey).agg(F.slice(F.array_sort(F.collect_list(F.struct(*struct_cols))), 1, k).alias(out))
        merged = pending.select(F.col("key").alias(qkey)).join(merged, qkey, "left")
        if last:
            with _small_arrow_batches(spark):
                done.append(merged.withColumn(out, F.coalesce(F.col(out), F.array().cast(f"array<{elem}>")))
                            .transform(_ckpt))
            break
        bound = _ring_bound(metric, cur, info["max_abs_lat"])
        ok = (F.size(out) >= F.lit(min(k, info["n_points"]))) & (F.element_at(out, -1)["d"] <= F.lit(bound))
        with _small_arrow_batches(spark):
            merged = merged.withColumn("_ok", F.coalesce(ok, F.lit(False))).transform(_ckpt)
        done.append(merged.filter("_ok").drop("_ok"))
        pending = merged.filter(~F.col("_ok")).select(F.col(qkey).alias("key")).join(q, "key")
        left = merged.filter(~F.col("_ok")).count()
        if not left:
            break
        cell = cur * 2.0
    q.unpersist()
    pts.unpersist()
    res = done[0]
    for d in done[1:]:
        res = res.unionByName(d)
    return res


# ------------------------------------------------------------------ J6 nearest reference point
def points_from_list(spark, coords, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """S2 fallback: literal (lat, lon) points."""
    return spark.createDataFrame([(float(a), float(b)) for a, b in coords], f"{lat} double, {lon} double")


def nearest_distance_literal(lat: str, lon: str, coords) -> Column:
    """J6 for a fixed, tiny point list: min haversine as one Column expression."""
    ds = [haversine(F.col(lat), F.col(lon), F.lit(a), F.lit(b)) for a, b in coords]
    return F.least(*ds) if len(ds) > 1 else ds[0]


def nearest_distance(df: DataFrame, key: str, points: DataFrame, out: str,
                     lat: str = "latitude", lon: str = "longitude",
                     plat: str = "lat", plon: str = "lon", **kw) -> DataFrame:
    """Metres to the nearest reference point, for each row of ``df`` (keyed by ``key``)."""
    nn = nearest_k(df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), key, lon, lat,
                   points.filter(F.col(plat).isNotNull() & F.col(plon).isNotNull()), plon, plat,
                   k=1, metric="haversine", out="_nn", **kw)
    return df.join(nn.select(key, F.element_at("_nn", 1)["d"].alias(out)), key, "left")


# ------------------------------------------------------------------ J7 kNN features
def knn_features(query: DataFrame, train: DataFrame, key: str = "hid", x: str = "longitude",
                 y: str = "latitude", price: str = "precio_mediano", ks=(5, 10, 20),
                 self_eps: float = 1e-5, min_train: int | None = None, query_key: str | None = None,
                 **kw) -> DataFrame:
    """For every query hotel, mean price and mean distance (degrees, Euclidean) of its
    k nearest train hotels. The first neighbour is skipped when closer than ``self_eps``
    (the hotel itself, or a co-located train hotel). Ties order by (distance, key)."""
    kmax = max(ks) + 1
    qk = query_key or key
    tr = train.select(F.col(key).alias("_tk"), F.col(x), F.col(y), F.col(price).alias("_price"))
    nn = nearest_k(query.select(qk, x, y), qk, x, y, tr, x, y, k=kmax, payload=["_price"],
                   tie="_tk", metric="euclid", out="_nn", min_points=kmax if min_train is None else min_train, **kw)
    skip = F.when(F.element_at("_nn", 1)["d"] < F.lit(self_eps), 2).otherwise(1)
    cols = []
    for k in ks:
        sl = F.slice("_nn", skip, F.lit(k))
        n = F.size(sl).cast("double")
        cols.append((F.aggregate(sl, F.lit(0.0), lambda acc, e: acc + e["_price"]) / n).alias(f"precio_mean_{k}nn"))
        cols.append((F.aggregate(sl, F.lit(0.0), lambda acc, e: acc + e["d"]) / n).alias(f"dist_mean_{k}nn"))
    return nn.select(qk, *cols)


# ------------------------------------------------------------------ J8 KDE
def kde_fit(df: DataFrame, x: str, y: str) -> dict:
    """Gaussian KDE state (Scott's rule, 2-D): scalars only. The sums are whole numbers of 2^-60 of the extent, so they do not
    depend on the order of the rows."""
    e = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate((x, y)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    mid = [0.0 if e[f"lo{i}"] is None else (e[f"lo{i}"] + e[f"hi{i}"]) / 2 for i in (0, 1)]
    wide = [2.0 ** math.ceil(math.log2(w)) if e[f"lo{i}"] is not None and (w := e[f"hi{i}"] - e[f"lo{i}"]) > 0 else 1.0 for i in (0, 1)]
    zx, zy = ((F.col(c) - F.lit(m)) / F.lit(w) for c, m, w in zip((x, y), mid, wide))
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    t = whole.agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.rint(c * F.lit(2.0 ** 60)).cast("decimal(20,0)")).alias(k)
                                                  for k, c in (("x", zx), ("y", zy), ("xx", zx * zx), ("yy", zy * zy), ("xy", zx * zy))]).first()
    m, one = t["m"], 2 ** 60

    def spread(p, q, pq):
        return float((Fraction(int(t[pq]), one) - Fraction(int(t[p]) * int(t[q]), one * one * m)) / (m - 1))
    r = {"n": e["n"]}
    if m > 1:
        r |= {"vx": spread("x", "x", "xx") * wide[0] ** 2, "vy": spread("y", "y", "yy") * wide[1] ** 2, "cxy": spread("x", "y", "xy") * wide[0] * wide[1]}
    n = r["n"]
    if n < 2 or m < 2:
        raise ValueError("KDE needs at least two points")
    fac2 = n ** (-2.0 / 6.0)
    sxx, syy, sxy = r["vx"] * fac2, r["vy"] * fac2, r["cxy"] * fac2
    det = sxx * syy - sxy * sxy
    if not det > 1e-300:
        raise ValueError("KDE covariance is singular (colinear points)")
    return {"n": n, "mid": mid, "ixx": syy / det, "iyy": sxx / det, "ixy": -sxy / det,
            "norm": 1.0 / (n * 2 * math.pi * math.sqrt(det)), "sxx": sxx, "syy": syy, "sxy": sxy}


def _kde_kernel(ixx: float, iyy: float, ixy: float, key: str, weighted: bool = False):
    def run(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            outs = []
            for r in pdf.itertuples(index=False):
                qx, qy = np.asarray(r.q_ox, float), np.asarray(r.q_oy, float)
                px, py = np.asarray(r.p_ox, float), np.asarray(r.p_oy, float)
                if len(qx) == 0 or len(px) == 0:
                    continue
                dx = px[None, :] - qx[:, None]
                dy = py[None, :] - qy[:, None]
                m = ixx * dx * dx + 2.0 * ixy * dx * dy + iyy * dy * dy
                e = np.exp(-0.5 * m)
                s = (e * np.asarray(r.p_w, float)[None, :]).sum(axis=1) if weighted else e.sum(axis=1)
                outs.append(pd.DataFrame({key: np.asarray(r.q_key), "_s": s}))
            if outs:
                yield pd.concat(outs, ignore_index=True)
    return run


def _hermite(order: int, at: float) -> list:
    """h_i(at) = He_i(at) exp(-at²/2) of i = 0 … order - 1."""
    out = [math.exp(-at * at / 2), at * math.exp(-at * at / 2)]
    for i in range(1, order - 1):
        out.append(at * out[i] - i * out[i - 1])
    return out[:order]


def _gauss_blocks(pts: DataFrame, n: int, reach: int, chunk: int, key_type: str) -> DataFrame:
    """``(key, _s)``: the Gaussian sums of all points (whitened ``u``, ``v``) at each of them, without pairs of points.

    Points lie in unit boxes. A box keeps the ORDER × ORDER moments of its points around its centre (Hermite expansion, error below
    1e-15 a point); they are carried to the boxes within ``reach`` along u, added up, then along v, and evaluated at the points as one
    polynomial a box. The work is a constant per point and per box; with Scott's bandwidth there are at most about 3 n^(2/3) boxes.
    Moments are summed as multiples of a power of two in two parts, which is exact, so results do not depend on the order of rows."""
    import numpy as np
    bits = max(1, math.ceil(math.log2(n + 1)))
    first, second = 2.0 ** (51 - bits), 2.0 ** (103 - 2 * bits)
    fact = np.cumprod([1.0, *range(1, ORDER)])
    step = {d: np.array([[(-1) ** b * h[a + b] for b in range(ORDER)] for a in range(ORDER)])
            for d in range(-reach, reach + 1) for h in [_hermite(2 * ORDER, float(d))]}
    blocks = _ckpt(_blocks(pts, "u", "v", ["key"], 1.0, chunk, "p_"))

    def powers(x, cell):
        return np.vander(np.asarray(x, float) - (cell + 0.5), ORDER, increasing=True) / fact

    def moments(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                high, low = np.zeros((2, ORDER, ORDER))
                x, y = powers(r.p_x, r.cx), powers(r.p_y, r.cy)
                for at in range(0, len(x), 256):
                    t = x[at:at + 256, :, None] * y[at:at + 256, None, :]
                    h = np.rint(t * first) / first
                    high += h.sum(axis=0)
                    low += (np.rint((t - h) * second) / second).sum(axis=0)
                rows.append((r.cx, r.cy, high.tobytes(), low.tobytes()))
            yield pd.DataFrame(rows, columns=["cx", "cy", "high", "low"])

    def matrix(b):
        return np.frombuffer(b).reshape(ORDER, ORDER)

    def merge(pdf):
        import pandas as pd
        m = sum(matrix(b) for b in pdf["high"]) + sum(matrix(b) for b in pdf["low"])
        return pd.DataFrame([(pdf["cx"].iloc[0], pdf["cy"].iloc[0], m.tobytes())], columns=["cx", "cy", "m"])

    def carried(axis):
        def add(pdf):
            import pandas as pd
            pdf = pdf.sort_values("d")
            m = np.zeros((ORDER, ORDER))
            for d, b in zip(pdf["d"], pdf["m"]):
                m += step[d].T @ matrix(b) if axis == "cx" else matrix(b) @ step[d]
            return pd.DataFrame([(pdf["cx"].iloc[0], pdf["cy"].iloc[0], m.tobytes())], columns=["cx", "cy", "m"])
        return add

    def near(boxes, axis):
        return boxes.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(axis, F.col(axis) + F.col("d"))

    schema = "cx long, cy long, m binary"
    own = blocks.mapInPandas(moments, "cx long, cy long, high binary, low binary").groupBy("cx", "cy").applyInPandas(merge, schema)
    along = near(own, "cx").groupBy("cx", "cy").applyInPandas(carried("cx"), schema)
    wanted = blocks.select("cx", "cy").distinct()
    local = near(along, "cy").join(wanted, ["cx", "cy"], "left_semi").groupBy("cx", "cy").applyInPandas(carried("cy"), schema)

    def sums(batches):
        import pandas as pd
        for pdf in batches:
            outs = []
            for r in pdf.itertuples(index=False):
                c = matrix(r.m) / np.outer(fact, fact)
                x, y = np.asarray(r.p_x, float) - (r.cx + 0.5), np.asarray(r.p_y, float) - (r.cy + 0.5)
                s = np.zeros(len(x))
                for a in range(ORDER - 1, -1, -1):
                    t = np.full(len(x), c[a, -1])
                    for b in range(ORDER - 2, -1, -1):
                        t = t * y + c[a, b]
                    s = s * x + t
                outs.append(pd.DataFrame({"key": np.asarray(r.p_key), "_s": s}))
            if outs:
                yield pd.concat(outs, ignore_index=True)
    return blocks.join(local, ["cx", "cy"]).drop("blk").mapInPandas(sums, f"key {key_type}, _s double")


def kde2d(df: DataFrame, key: str, x: str, y: str, out: str = "density_kde",
          cutoff: float = 9.0, exact: bool = False, qchunk: int = 256, chunk: int = 1024,
          bin_frac: float | None = None) -> DataFrame:
    """Density of every row under the KDE fitted on all rows of ``df``.

    The sums come from expansions of boxes of points (``_gauss_blocks``), whose work grows with the rows, not with their pairs;
    terms beyond ``cutoff`` bandwidths (below exp(-cutoff²/2)) may be left out. With ``exact`` every block of points meets every
    block, and the binned form pairs blocks of neighbouring cells of side ``cutoff``, both evaluated with NumPy."""
    # the input feeds the fit and both block sides: derive it once
    df = df.select(key, x, y).persist(StorageLevel.MEMORY_AND_DISK)
    st = kde_fit(df, x, y)
    ixx, iyy, ixy, norm = st["ixx"], st["iyy"], st["ixy"], st["norm"]
    ktype = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)[key]
    # whiten with the Cholesky factor of Σ⁻¹ so that Mahalanobis distance is Euclidean:
    # u = a·x + b·y, v = c·y with a = sqrt(ixx), b = ixy / a, c = sqrt(iyy − b²)
    a = math.sqrt(ixx)
    b = ixy / a
    c = math.sqrt(max(iyy - b * b, 1e-300))
    w = df.select(F.col(key).alias("key"), F.col(x).alias("ox"), F.col(y).alias("oy"))
    dx, dy = F.col("ox") - F.lit(st["mid"][0]), F.col("oy") - F.lit(st["mid"][1])
    w = w.withColumn("u", F.lit(a) * dx + F.lit(b) * dy).withColumn("v", F.lit(c) * dy)
    if not exact and not bin_frac:
        part = _gauss_blocks(w.where("u is not null and v is not null").select("key", "u", "v"), st["n"], math.ceil(cutoff) + 1, max(chunk, 1024), ktype)
        with _small_arrow_batches(df.sparkSession):
            res = part.select(F.col("key").alias(key), (F.col("_s") * F.lit(norm)).alias(out)).transform(_ckpt)
        df.unpersist()
        return res
    cell = None if exact else cutoff
    pts = w.select("u", "v", "ox", "oy")
    payload = ["ox", "oy"]
    if bin_frac:
        # binned form: points snap to whitened cells of ``bin_frac`` bandwidths and become
        # weighted cell centroids, so a dense spot costs its number of cells, not points;
        # each term's relative error is at most cutoff × the cell half-diagonal
        pts = pts.groupBy(F.floor(F.col("u") / bin_frac).alias("_bu"), F.floor(F.col("v") / bin_frac).alias("_bv")) \
            .agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.avg("ox").alias("ox"), F.avg("oy").alias("oy"),
                 F.count(F.lit(1)).cast("double").alias("w")).drop("_bu", "_bv")
        payload = ["ox", "oy", "w"]
        n_pts = pts.count() if exact else 0          # the block count of the one-cell form
    else:
        n_pts = st["n"]
    pairs = _block_pairs(w, "u", "v", ["key", "ox", "oy"], pts, "u", "v",
                         payload, cell, qchunk, chunk, n_pts, st["n"])
    part = pairs.mapInPandas(_kde_kernel(ixx, iyy, ixy, key, weighted=bool(bin_frac)), f"`{key}` {ktype}, _s double")
    # materialised here so the persisted input can be released
    with _small_arrow_batches(df.sparkSession):
        res = part.groupBy(key).agg((F.sum("_s") * F.lit(norm)).alias(out)).transform(_ckpt)
    df.unpersist()
    return res


# ------------------------------------------------------------------ J9 nearest area
def nearest_area(df: DataFrame, key: str, areas: DataFrame | None, attrs: dict | None = None,
                 lat: str = "latitude", lon: str = "longitude", vertices: str = "vertices",
                 area_key: str = "area_id", out_dist: str = "dist_favela_m", **kw) -> DataFrame:
    """Distance to the nearest area (min over its polygon vertices) and that area's
    attributes. ``attrs`` maps output name → area column. Without an area table the
    reference's constant defaults are emitted."""
    if areas is None:
        return df.withColumns({k: F.lit(v) for k, v in AREA_DEFAULTS.items()})
    attrs = attrs or {}
    verts = areas.select(area_key, *attrs.values(), F.explode(vertices).alias("_v")) \
        .select(area_key, *attrs.values(), F.col("_v.lat").alias("_plat"), F.col("_v.lon").alias("_plon"))
    nn = nearest_k(df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), key, lon, lat,
                   verts, "_plon", "_plat", k=1, payload=list(attrs.values()), tie=area_key,
                   metric="haversine", out="_nn", **kw)
    first = F.element_at("_nn", 1)
    sel = [first["d"].alias(out_dist)] + [first[src].alias(name) for name, src in attrs.items()]
    return df.join(nn.select(key, *sel), key, "left")
