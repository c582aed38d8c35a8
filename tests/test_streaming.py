from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater import schemas
from tidewater.operators import clean, star
from tidewater.sources import fixtures as fx
from tidewater.streaming import ingest


def test_counters_and_limits(spark, tmp_path):
    g_raw = fx.raw_events(spark, DATA)
    events = star.fact_events(star.staging(clean.silver(g_raw)))
    events.write.parquet(f"{tmp_path}/facts")
    stream = ingest.daily_counters(spark.readStream.schema(schemas.FACT_EVENTS).parquet(f"{tmp_path}/facts"))
    stream.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r["event_date"]: r["total_events"] for r in spark.table("counters").collect()}
    assert got == {r["event_date"]: r["count"] for r in events.groupBy("event_date").count().collect()}

    spark.range(5).select(F.lit("u").alias("key"), F.timestamp_seconds(F.lit(50) + F.col("id") * 20).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/hits")
    hits = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/hits")
    ingest.first_hit_limit(hits, 2, 60).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("limits").orderBy("ts").collect()
    assert [r["hit"] for r in rows] == [1, 2, 3, 1, 2] and [r["allowed"] for r in rows] == [True, True, False, True, True]
