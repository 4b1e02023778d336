"""Running counts of terms over a stream, also after a restart."""

from pyspark.sql import functions as F

from quernstone.operators import store
from quernstone.streaming import live


def test_running_counts_like_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    s = store.Store(spark, str(tmp_path / "store"))
    halves = [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")]
    for half in halves:  # the second run goes on from the first one's checkpoint
        half.coalesce(1).write.mode("append").parquet(folder)
        stream = live.event_stream(spark, folder, events.schema, files_a_trigger=8)
        terms = stream.select("ts", F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("term"))
        query = live.hot_term_counts(terms, period="365000 days", late="365000 days").writeStream.outputMode("update").foreachBatch(live.top_terms_sink(s, "hot", 5)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    want = events.groupBy(F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("term")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, s.read("hot").select("term", "n").collect())) == sorted(map(tuple, want.collect()))
    top = want.orderBy(F.desc("n"), "term").limit(5)
    assert sorted(map(tuple, s.read("hot_top").select("term", "n").collect())) == sorted(map(tuple, top.collect()))
