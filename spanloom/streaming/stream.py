"""Extraction over streams: every step is within a document, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans.extract import extract, scored
from spanloom.sources.gazetteers import Gazetteers


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 100) -> DataFrame:
    """Documents of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def entity_stream(docs: DataFrame, gazetteers: Gazetteers | None = None) -> DataFrame:
    return extract(docs, gazetteers)


def score_stream(docs: DataFrame, gazetteers: Gazetteers | None = None) -> DataFrame:
    return scored(docs, gazetteers)


def write_entities(entities: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Entities as JSON lines, once each; runs until what is there now has been read."""
    rows = entities.select(F.to_json(F.struct(*entities.columns)).alias("value"))
    return rows.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
