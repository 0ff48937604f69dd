"""Stateless feature operators on a stream.

Every Column-level operator (E1–E17, rules, linear scores) and static joins (hotel
attributes, fixed reference points) run unchanged on a streaming DataFrame; the reference
has no windowed or stateful stream logic, so none is added. ``run_available`` drains the
source once (``availableNow``) into a parquet table in the shared checkpoint folder and
returns it as a batch DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions import temporal as TM
from ..session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder (matching ``pattern``) as a streaming source, with the
    schema taken once from the batch reader (no inference per micro-batch)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern) \
        .option("maxFilesPerTrigger", 1).parquet(folder)


def run_available(df: DataFrame, name: str = "stream") -> DataFrame:
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def temporal_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Event search rows → check-in, weekday, cyclic and event-flag columns, streaming."""
    from pyspark.sql import functions as F
    ev = stream_table(spark, folder, pattern)
    rows = ev.select(F.col("event_id").alias("row_id"), F.col("ts").alias("date"),
                     (F.col("event_id") % 60).cast("int").alias("anticipation"))
    return TM.temporal_features(rows)


def score_stream(stream: DataFrame, model, out: str = "prediction") -> DataFrame:
    """R1 on a stream: a fitted Column-level model (linear, rules) scores each micro-batch."""
    return model.transform(stream, out)


def search_rows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Search rows as a stream: ``lineitem`` files streamed, ``orders`` joined as a static
    table (stream-static equi-join, no state)."""
    from pyspark.sql import functions as F
    li = stream_table(spark, folder, "lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    od = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(F.col("l_orderkey").alias("searchid"), F.col("l_linenumber").cast("int").alias("position"),
                    F.col("l_partkey").alias("hid"), F.col("l_suppkey").alias("sid"),
                    (F.col("l_linenumber") * 9).cast("double").alias("x_anticipation"),
                    (1 + F.col("l_orderkey") % 7).cast("double").alias("x_duration"))
