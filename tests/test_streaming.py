from pyspark.sql import functions as F

from termloom.operators.clicks import click_edges
from termloom.streaming.clicks import edge_counts, windowed_edge_counts

SF = "/root/testdata/sf0.001"


def log(df):
    return df.where("event_type = 'click'").select("ts", F.col("user_id").alias("query"), F.get_json_object("props", "$.k").cast("bigint").alias("docid"))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = edge_counts(log(stream)).writeStream.outputMode("complete").format("memory").queryName("edges").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, click_edges(log(events)).collect()))
    assert sorted(map(tuple, spark.table("edges").select("query", "docid", "w").collect())) == want
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_edge_counts(log(stream), "ts", "1 day", "1 hour").writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("w")).first()[0] == sum(w for _, _, w in want)
