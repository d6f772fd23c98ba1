from pyspark.sql import functions as F

from panelforge.streaming import windows


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp"))
    last = batch.agg(F.max("ts")).first()[0]
    closing = batch.limit(1).withColumns({"ts": F.lit(last) + F.expr("INTERVAL 60 DAYS"), "event_type": F.lit("end"), "user_id": F.lit(-1).cast("long")})
    batch.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    closing.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all windows
    for name, make, columns in (("t", windows.tumbling, ["start", "event_type", "n"]), ("s", windows.sessions, ["user_id", "start", "stop", "n"]), ("l", windows.sliding, ["start", "n"])):
        stream = make(windows.read_events(spark, str(tmp_path / "in"), batch.schema))
        windows.drain(stream, str(tmp_path / f"out-{name}"), str(tmp_path / f"cp-{name}"))
        got = spark.read.parquet(str(tmp_path / f"out-{name}")).select(*columns)
        want = make(batch).select(*columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
