"""Spark-side derived views shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import domain as D


def searches(spark: SparkSession, sf: str) -> DataFrame:
    return D.searches(spark, sf)


def split_searches(spark: SparkSession, sf: str) -> DataFrame:
    return R.session_split(D.searches(spark, sf), "searchid")


def hotels(spark: SparkSession, sf: str, df: DataFrame | None = None) -> DataFrame:
    """Unique hotels (hid, longitude, latitude) with their median price (A1 after P2)."""
    s = df if df is not None else D.searches(spark, sf)
    s = R.require(s, ["hid", "longitude", "latitude"])
    return R.hotel_medians(s)


def train_hotels(spark: SparkSession, sf: str) -> DataFrame:
    s = split_searches(spark, sf).filter(F.col("split") == "train")
    return hotels(spark, sf, s)
