"""Sources and sinks (S2–S9): OSM JSON, area polygons, tuned parameters, split and
prediction writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import domain as D

# Overpass-style document: nodes carry lat/lon, ways carry a vertex list; either may be absent.
_VERTEX = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
OSM_SCHEMA = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("geometry", T.ArrayType(_VERTEX)),
])))])


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded OSM JSON files (one document per file) as a ``json`` string column."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def _parse(docs: DataFrame, col: str = "json") -> DataFrame:
    return docs.select(F.explode(F.from_json(F.col(col), OSM_SCHEMA)["elements"]).alias("e"))


def osm_nodes(docs: DataFrame, col: str = "json") -> DataFrame:
    """S3: one ``(id, lat, lon)`` row per element that has both coordinates."""
    e = _parse(docs, col)
    return e.filter(F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()) \
        .select(F.col("e.id").alias("id"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"))


def osm_way_vertices(docs: DataFrame, col: str = "json") -> DataFrame:
    """One ``(id, seq, lat, lon)`` row per way vertex."""
    e = _parse(docs, col).filter(F.col("e.geometry").isNotNull())
    v = e.select(F.col("e.id").alias("id"), F.posexplode("e.geometry").alias("seq", "v"))
    return v.select("id", F.col("seq").cast("int").alias("seq"), F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))


def supplier_osm_documents(spark: SparkSession, sf_dir: str, kind: str = "node", per_doc: int = 100) -> DataFrame:
    """Test documents derived from ``supplier``: one JSON text per block of ``per_doc``
    suppliers (bounded size). Nodes lose lat when id % 5 = 0 and lon when id % 7 = 0; a way
    has 1 + id % 4 vertices stepping 0.001° north-west."""
    p = D.points(spark, sf_dir)
    pid = F.col("point_id")
    if kind == "node":
        elem = F.struct(pid.alias("id"), F.lit("node").alias("type"),
                        F.when(pid % 5 != 0, F.col("lat")).alias("lat"),
                        F.when(pid % 7 != 0, F.col("lon")).alias("lon"))
    else:
        n = (1 + pid % 4).cast("int")
        geom = F.transform(F.sequence(F.lit(0), n - 1),
                           lambda j: F.struct((F.col("lat") + j * 0.001).alias("lat"), (F.col("lon") - j * 0.001).alias("lon")))
        elem = F.struct(pid.alias("id"), F.lit("way").alias("type"), geom.alias("geometry"))
    return p.groupBy(F.floor(pid / per_doc).alias("doc")).agg(
        F.to_json(F.struct(F.collect_list(elem).alias("elements"))).alias("json"))


def areas(df: DataFrame, state: str, col: str = "UF") -> DataFrame:
    """Area polygons of one state (pushed into the scan when ``df`` is a file)."""
    return df.filter(F.col(col) == F.lit(state))


def customer_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area polygons derived from ``customer`` ⋈ ``nation``: a 0.001° square per customer."""
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    k = F.col("c_custkey")
    clat, clon = D.hotel_lat(k, 0.0013), D.hotel_lon(k, 0.0013)
    offs = [(-0.0005, -0.0005), (-0.0005, 0.0005), (0.0005, 0.0005), (0.0005, -0.0005)]
    verts = F.array(*[F.struct((clat + dy).alias("lat"), (clon + dx).alias("lon")) for dy, dx in offs])
    return j.select(k.alias("area_id"), F.col("n_name").alias("UF"), F.col("c_name").alias("NM_AGSN"),
                    (10 + k % 500).cast("int").alias("SUM_EDOC"),
                    ((1 + k % 9) / 100000.0).alias("Shape_Area"),
                    ((k % 100) / 100.0).alias("UH_Dist"),
                    verts.alias("vertices"))


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """One write of all splits, partitioned by the split column."""
    df.write.mode(mode).partitionBy(split_col).format(fmt).save(path)


def export_predictions(df: DataFrame, hotel: str = "hotel") -> DataFrame:
    """Hotel name (or a synthetic ``Hotel <key>``), actual and the two predictions."""
    name = F.coalesce(F.col(hotel), F.concat(F.lit("Hotel "), F.col("searchid").cast("string"), F.lit("-"),
                                             F.col("position").cast("string")))
    return df.select(name.alias("hotel"), "precio_real", "prediccion_huber", "prediccion_ridge")


# ------------------------------------------------------------------ S6 tuned parameters
PARAM_FIELDS = ["tweedie_variance_power", "n_estimators", "learning_rate", "max_depth", "num_leaves",
                "subsample", "colsample_bytree", "min_child_weight", "loss"]


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """``{segment_model: {param: value}}`` JSON → rows ``(segment_model, params map)``."""
    raw = spark.read.option("multiLine", True).json(path)
    cols = raw.columns
    kv = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                                     F.array(*[F.to_json(F.col(f"`{c}`")) for c in cols])))
    return raw.select(kv.alias("segment_model", "json")) \
        .select("segment_model", F.from_json("json", "map<string,string>").alias("params"))


def params_for(df: DataFrame, params: DataFrame, key: str, defaults: dict) -> DataFrame:
    """S6 lookup: left join each row's ``key`` to the parameter table; absent params take the
    defaults (``coalesce`` per field)."""
    p = params.select(F.col("segment_model").alias(key), "params")
    j = df.join(p, key, "left")
    return j.withColumns({f: F.coalesce(F.col("params")[f], F.lit(str(v)) if v is not None else F.lit(None).cast("string"))
                          for f, v in defaults.items()}).drop("params")


def save_params(df: DataFrame, path: str) -> None:
    """S6 write: one JSON line per ``(segment_model, params)``."""
    df.write.mode("overwrite").json(path)


def reference_points(spark: SparkSession, path: str | None = None, fallback=None,
                     lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Reference points (metro stations, coastline vertices) from a cached CSV with
    ``lat``/``lon`` columns when it exists, else the given literal (lat, lon) list."""
    from pyspark.errors import AnalysisException
    if path:
        try:
            df = spark.read.schema(f"{lat} double, {lon} double").option("header", True).csv(path)
            df.schema  # noqa: B018 - resolves the path now
            return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        except AnalysisException:
            pass
    if fallback is None:
        raise ValueError("no point file and no fallback points")
    return spark.createDataFrame([(float(a), float(b)) for a, b in fallback], f"{lat} double, {lon} double")
