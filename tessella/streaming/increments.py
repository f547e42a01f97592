"""Newly arrived events, micro-batch by micro-batch.

The reference works in batches only; this keeps a table of components current as events
arrive: a batch is joined with the stored keys that it touches and only those components
are labelled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.graph import least_labels


def merge_components(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(event_id, key, label) of new keys together with the stored components they touch."""
    touched = stored.join(keys.select("key").distinct(), "key", "left_semi").select("label").distinct()
    old = stored.join(touched, "label", "left_semi").select("event_id", "key")
    edges = old.unionByName(keys.select("event_id", "key")).distinct()
    return edges.join(least_labels(edges), "event_id").select("event_id", "key", "label")


def keep_components(spark: SparkSession, stream: DataFrame, root: str):
    """A foreachBatch sink over a stream of (event_id, key) that appends a new version of the
    touched components per batch; the newest version of an event counts."""

    def each(batch: DataFrame, version: int) -> None:
        stored = current(spark, root)
        merge_components(stored, batch).withColumn("version", F.lit(version)).write.mode("append").parquet(root)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}_progress")


SCHEMA = "event_id string, key string, label string, version bigint"


def current(spark: SparkSession, root: str) -> DataFrame:
    try:
        rows = spark.read.schema(SCHEMA).parquet(root)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    newest = rows.groupBy("event_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["event_id", "version"]).select("event_id", "key", "label")
