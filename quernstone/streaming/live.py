"""Streaming forms of the incremental operators, over an events stream (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, *, files_a_trigger: int = 8) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone


def windowed_counts(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) over tumbling or sliding windows; events later than ``late`` are let go."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    per = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events without a gap of that length."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_sink(store, table: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the latest row of each key in a store table; a repeated batch changes nothing. Only the buckets
    of the batch's keys are written."""
    from quernstone.operators.store import latest

    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(table, batch, keys, lambda old, new: latest(old.unionByName(new), keys, [F.desc(order)]))

    return write


def run_to_end(stream: DataFrame, name: str, checkpoint: str, *, mode: str = "append") -> None:
    """Run a stream over what is there into the in-memory table ``name``, then stop."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def hot_term_counts(terms: DataFrame, *, period: str = "7 days", late: str = "10 minutes") -> DataFrame:
    """(start, term, n): running counts of ``terms(ts, term)`` in each period. A period's state is let go once the stream is
    ``late`` past its end."""
    seen = terms.where("term is not null").withWatermark("ts", late)
    per = seen.groupBy(F.window("ts", period), "term").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("start"), "term", "n")


def top_terms_sink(store, table: str, k: int):
    """A foreachBatch function over ``hot_term_counts``: counts go into the buckets of a store table that they touch, and the k
    most frequent terms of each period that the batch met, ties by term, into ``<table>_top``. A repeated batch changes nothing."""
    from quernstone.operators.store import latest, upserted

    keys = ["start", "term"]

    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(table, batch, keys, lambda old, new: upserted(old, new, keys))
        met = store.read(table).join(batch.select("start").distinct(), "start", "left_semi")
        top = latest(met, ["start"], [F.desc("n"), "term"], k)
        store.merge(f"{table}_top", top, ["start"], lambda old, new: upserted(old, new, ["start"]))

    return write
