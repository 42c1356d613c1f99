"""The quality gate over a stream of texts: stateless, so append mode and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkgauge.plans.gate import gate


def decisions(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A streaming DataFrame of gate decisions over Parquet files that arrive in path."""
    return gate(spark.readStream.schema(schema).parquet(path), **options)


def start(decided: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write decisions as they come, exactly once, split by route; ends when all files there are read."""
    return decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("route").trigger(availableNow=True).start()
