from pyspark.sql import functions as F

from tidemark.sources.store import Store
from tidemark.sources.tables import table
from tidemark.streaming.runs import append_runs, sessions


def test_micro_batches_become_runs(spark, tmp_path):
    src = f"{tmp_path}/in"
    s = Store(spark, f"file://{tmp_path}/store", "v bigint")
    for part in range(2):
        spark.range(1, 11).select((F.col("id") + part * 5).alias("page"), F.lit(part).cast("long").alias("v")).coalesce(1).write.mode("append").parquet(src)
        q = append_runs(spark.readStream.schema("page long, v long").parquet(src), s, f"{tmp_path}/cp")
        q.awaitTermination()
    assert {x.page: x.v for x in s.view().resolve().collect()} == {**{p: 0 for p in range(1, 6)}, **{p: 1 for p in range(6, 16)}}
    assert s.view().txid == 2


def test_sessions_with_watermark(spark, small, tmp_path):
    e = table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.select("ts", "user_id", "value").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(f"{tmp_path}/e")
    q = sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM sess").first().n > 0
