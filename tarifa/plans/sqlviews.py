"""DuckDB twins of the domain views (``tarifa.sources.domain``), written as CTE text.

The oracle queries are independent re-statements in SQL of what the Spark operators do;
these snippets only re-derive the same input views from the driver tables.
"""

from __future__ import annotations

from ..sources.domain import AMENITY_BITS, RATING_COLS, RATING_MULT


def _f(x: float) -> str:
    return f"({x!r})::DOUBLE"


def geo_k(h: str) -> str:
    return f"(CASE WHEN {h} % 50 = 49 THEN {h} - 1 ELSE {h} END)"


def lat_expr(h: str, off: float = 0.0) -> str:
    return f"({_f(-23.05 + off)} + (({geo_k(h)} * 7919) % 2503) / 10000.0::DOUBLE)"


def lon_expr(h: str, off: float = 0.0) -> str:
    return f"({_f(-43.45 + off)} + (({geo_k(h)} * 104729) % 3001) / 10000.0::DOUBLE)"


def hotel_attr_select(h: str) -> str:
    cols = [
        f"{lon_expr(h)} AS longitude",
        f"CASE WHEN {h} % 97 = 5 THEN NULL ELSE {lat_expr(h)} END AS latitude",
        f"CASE WHEN {h} % 11 = 0 THEN NULL ELSE 1.0::DOUBLE + (({h} * 31) % 9) / 2.0::DOUBLE END AS starRating",
    ]
    for i, (c, m) in enumerate(zip(RATING_COLS, RATING_MULT)):
        null = f"{h} % 7 = {i}"
        if c == "avgService":
            null = f"({null} OR {h} % 9 = 0)"
        cols.append(f"CASE WHEN {null} THEN NULL ELSE 5.0::DOUBLE + (({h} * {m}) % 50) / 10.0::DOUBLE END AS {c}")
    cols.append(f"CASE WHEN {h} % 13 = 0 THEN NULL ELSE CAST(10 + ({h} * 13) % 490 AS DOUBLE) END AS numberOfRooms")
    return ",\n    ".join(cols)


SEARCHES = f"""
  SELECT l_orderkey AS searchid, l_partkey AS hid, l_suppkey AS sid, o_orderdate AS date,
    CAST(l_linenumber * 9 AS INTEGER) AS anticipation,
    CAST(l_linenumber AS INTEGER) AS position,
    CAST(1 + l_suppkey % 3 AS INTEGER) AS adults,
    CAST(l_suppkey % 2 AS INTEGER) AS children,
    CAST(l_orderkey % 2 AS INTEGER) AS infants,
    CAST(1 + l_orderkey % 7 AS INTEGER) AS duration,
    {hotel_attr_select('l_partkey')},
    l_extendedprice / l_quantity AS price_by_night_person,
    (l_extendedprice / l_quantity) * (1 + l_suppkey % 3) AS price_by_night,
    l_extendedprice / l_quantity AS target,
    'g' || CAST(l_partkey % 10 AS VARCHAR) AS geo_id,
    'd' AS detail
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def _amenity_cols() -> str:
    cols = []
    for i in range(AMENITY_BITS):
        cols.append(f"CASE WHEN (p_partkey + {i}) % 17 = 0 THEN NULL ELSE CAST((p_partkey >> {i}) % 2 AS DOUBLE) END AS amenity_{i}")
    cols.append("CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS amenity_pool")
    cols.append("1.0::DOUBLE AS amenity_const")
    cols.append("CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE NULL END AS amenity_sparse")
    return ",\n    ".join(cols)


AMENITIES = f"""
  SELECT p_partkey AS hotel_id,
    CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '  ' ELSE p_name END AS name,
    CAST(p_partkey % 3 AS VARCHAR) AS main_city_oid,
    p_brand AS destination_code,
    CASE WHEN p_partkey % 29 = 0 THEN 'Sao Paulo' ELSE 'Rio de Janeiro' END AS destination_name,
    {_amenity_cols()}
  FROM part
"""

EVENT_SEARCHES = """
  SELECT event_id AS row_id, user_id AS searchid, ts AS date,
    CAST(event_id % 60 AS INTEGER) AS anticipation, value AS price_by_night_person
  FROM events
"""

POINTS = f"""
  SELECT s_suppkey AS point_id, {lat_expr('s_suppkey', 0.0007)} AS lat, {lon_expr('s_suppkey', 0.0007)} AS lon
  FROM supplier
"""

PREDICTIONS = """
  SELECT s.searchid, s.position, s.hid, s.sid, a.name AS hotel, s.price_by_night_person AS precio_real,
    s.price_by_night_person * (1 + ((s.searchid * 7 + s.hid) % 21 - 10) / 100.0::DOUBLE) AS prediccion_huber,
    s.price_by_night_person * (1 + ((s.hid * 3 + s.searchid) % 31 - 15) / 100.0::DOUBLE) AS prediccion_ridge
  FROM searches s LEFT JOIN amenities a ON s.hid = a.hotel_id
"""


def split_expr(key: str = "searchid") -> str:
    b = f"((('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT) % 100)"
    return f"CASE WHEN {b} < 70 THEN 'train' WHEN {b} < 85 THEN 'val' ELSE 'test' END"


def hash_expr(*keys: str) -> str:
    s = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5({s}), 1, 8))::BIGINT)"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))")
    return f"(6371000.0::DOUBLE * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


HOTELS = """
  SELECT hid, longitude, latitude, median(price_by_night_person) AS precio_mediano
  FROM searches WHERE hid IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL
  GROUP BY hid, longitude, latitude
"""

SPLIT_SEARCHES = f"""
  SELECT *, {split_expr('searchid')} AS split FROM searches
"""


def with_views(*names: str) -> str:
    """``WITH`` clause for the named views, in dependency order."""
    defs = {
        "searches": SEARCHES, "amenities": AMENITIES, "event_searches": EVENT_SEARCHES,
        "points": POINTS, "preds": PREDICTIONS, "hotels": HOTELS, "split_searches": SPLIT_SEARCHES,
    }
    deps = {"preds": ["searches", "amenities"], "hotels": ["searches"], "split_searches": ["searches"]}
    order: list[str] = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({defs[n]})" for n in order)
