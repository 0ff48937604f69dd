"""Domain views over the driver's tables.

The test tables carry no hotels, coordinates or missing values, so hotels, searches,
reference points and predictions are derived from ``part``, ``lineitem``/``orders``,
``supplier`` and ``events`` with integer arithmetic only. Every view has a DuckDB twin in
``tarifa.plans.sqlviews`` written from the same formulas; nothing here samples or caps rows, so
each view grows with its source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATING_COLS = [
    "avgRating", "avgRatingCleaning", "avgRatingInternetAccessAndQuality",
    "avgRatingLocation", "avgQualityprice", "avgServicepersonal", "avgService",
]
IMPUTE_COLS = RATING_COLS + ["numberOfRooms"]
# multiplier per rating column; rating i is NULL when hid % 7 = i
RATING_MULT = [3, 7, 11, 17, 19, 23, 29]
AMENITY_BITS = 8
AMENITY_COLS = [f"amenity_{i}" for i in range(AMENITY_BITS)] + ["amenity_pool", "amenity_const", "amenity_sparse"]
# (searchid, position) repeats in the driver's lineitem; these columns order rows totally
ROW_ORDER = ["searchid", "position", "hid", "sid", "price_by_night_person"]
HOTEL_META = ["hotel_id", "name", "main_city_oid", "destination_code", "destination_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_key(hid: Column) -> Column:
    # every 50th hotel shares the coordinates of its predecessor
    return F.when(hid % 50 == 49, hid - 1).otherwise(hid)


def hotel_lat(hid: Column, offset: float = 0.0) -> Column:
    k = geo_key(hid)
    return F.lit(-23.05 + offset) + ((k * 7919) % 2503) / 10000.0


def hotel_lon(hid: Column, offset: float = 0.0) -> Column:
    k = geo_key(hid)
    return F.lit(-43.45 + offset) + ((k * 104729) % 3001) / 10000.0


def hotel_attrs(hid: Column) -> dict[str, Column]:
    """Coordinates, stars, ratings and rooms of a hotel id (these live on search rows)."""
    cols = {
        "longitude": hotel_lon(hid),
        "latitude": F.when(hid % 97 == 5, F.lit(None).cast("double")).otherwise(hotel_lat(hid)),
        "starRating": F.when(hid % 11 == 0, F.lit(None).cast("double"))
                       .otherwise(1.0 + ((hid * 31) % 9) / 2.0),
    }
    for i, (c, m) in enumerate(zip(RATING_COLS, RATING_MULT)):
        null = hid % 7 == i
        if c == "avgService":
            null = null | (hid % 9 == 0)  # one star group (1.0) has no avgService at all
        cols[c] = F.when(null, F.lit(None).cast("double")).otherwise(5.0 + ((hid * m) % 50) / 10.0)
    cols["numberOfRooms"] = F.when(hid % 13 == 0, F.lit(None).cast("double")) \
        .otherwise((10 + (hid * 13) % 490).cast("double"))
    return cols


def amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hotel: metadata + amenity indicators (some NULL, one constant, one {1, NULL})."""
    p = table(spark, sf_dir, "part")
    hid = F.col("p_partkey")
    cols = {
        "hotel_id": hid,
        "name": F.when(hid % 23 == 0, F.lit(None).cast("string"))
                 .when(hid % 19 == 0, F.lit("  ")).otherwise(F.col("p_name")),
        "main_city_oid": (hid % 3).cast("string"),
        "destination_code": F.col("p_brand"),
        "destination_name": F.when(hid % 29 == 0, F.lit("Sao Paulo")).otherwise(F.lit("Rio de Janeiro")),
    }
    for i in range(AMENITY_BITS):
        cols[f"amenity_{i}"] = F.when((hid + i) % 17 == 0, F.lit(None).cast("double")) \
            .otherwise((F.shiftright(hid, i) % 2).cast("double"))
    cols["amenity_pool"] = F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)
    cols["amenity_const"] = F.lit(1.0)
    cols["amenity_sparse"] = F.when(hid % 3 == 0, F.lit(1.0)).otherwise(F.lit(None).cast("double"))
    return p.select(*[v.alias(k) for k, v in cols.items()])


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search-result row per lineitem; the session is the order."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    hid = F.col("l_partkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    cols = {
        "searchid": F.col("l_orderkey"),
        "hid": hid,
        "sid": F.col("l_suppkey"),
        "date": F.col("o_orderdate"),
        "anticipation": (F.col("l_linenumber") * 9).cast("int"),
        "position": F.col("l_linenumber").cast("int"),
        "adults": (1 + F.col("l_suppkey") % 3).cast("int"),
        "children": (F.col("l_suppkey") % 2).cast("int"),
        "infants": (F.col("l_orderkey") % 2).cast("int"),
        "duration": (1 + F.col("l_orderkey") % 7).cast("int"),
        **hotel_attrs(hid),
        "price_by_night_person": price,
        "price_by_night": price * (1 + F.col("l_suppkey") % 3),
        "target": price,
        "geo_id": F.concat(F.lit("g"), (hid % 10).cast("string")),
        "detail": F.lit("d"),
    }
    return j.select(*[v.alias(k) for k, v in cols.items()])


def event_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows dated by the events table (January 2024, with time of day)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("searchid"),
        F.col("ts").alias("date"),
        (F.col("event_id") % 60).cast("int").alias("anticipation"),
        F.col("value").alias("price_by_night_person"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points (one per supplier), offset so none coincides with a hotel."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("point_id"), hotel_lat(k, 0.0007).alias("lat"), hotel_lon(k, 0.0007).alias("lon"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-prediction rows: actual price and two predictions off by key-derived percentages."""
    s = searches(spark, sf_dir).select("searchid", "position", "hid", "sid", "price_by_night_person")
    a = amenities(spark, sf_dir).select("hotel_id", "name")
    j = s.join(a, s.hid == a.hotel_id, "left")
    y = F.col("price_by_night_person")
    return j.select(
        "searchid", "position", "hid", "sid",
        F.col("name").alias("hotel"),
        y.alias("precio_real"),
        (y * (1 + ((F.col("searchid") * 7 + F.col("hid")) % 21 - 10) / 100.0)).alias("prediccion_huber"),
        (y * (1 + ((F.col("hid") * 3 + F.col("searchid")) % 31 - 15) / 100.0)).alias("prediccion_ridge"),
    )
