"""Scoring a stream of units with fitted mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrane.operators.mixture import type_probabilities


def score_stream(spark: SparkSession, path: str, schema: StructType, models: DataFrame, node: str = "node_id") -> DataFrame:
    """Type probabilities of the units in parquet files that arrive in a folder."""
    return type_probabilities(spark.readStream.schema(schema).parquet(path), models, node)


def write_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the scores of what has arrived to parquet files, then stops."""
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
