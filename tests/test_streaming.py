"""Streams over files, a few at a time, give what the tables give."""

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import events as streams


@pytest.fixture
def source(spark, tmp_path):
    data = [(i, i % 3, f"2024-01-01 00:{i // 2:02d}:{30 * (i % 2):02d}", "signup" if i % 5 == 0 else "view") for i in range(60)]
    df = spark.createDataFrame(data, "event_id long, user_id long, at string, kind string").withColumn("at", F.to_timestamp("at"))
    for k in range(3):
        df.where((F.col("event_id") >= 20 * k) & (F.col("event_id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), tmp_path


def ran(spark, df, name, at, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_counts(spark, source):
    table, stream, at = source
    got = ran(spark, streams.windowed_counts(stream, "at", ["user_id"], "10 minutes", "1 hour"), "counts", at, "complete")
    want = table.groupBy("user_id", F.window("at", "10 minutes")["start"].alias("begin")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeats_and_trials(spark, source):
    table, stream, at = source
    twice = stream.union(stream.sparkSession.readStream.schema(table.schema).parquet(f"{at}/in"))
    assert ran(spark, streams.once_each(twice, "at", ["event_id"], "2 hours"), "once", at).count() == 60
    trials = spark.createDataFrame([(1, 5)], "user_id long, trial int").withColumns({"low": F.to_timestamp(F.lit("2024-01-01 00:05:00")), "high": F.to_timestamp(F.lit("2024-01-01 00:10:00"))})
    got = ran(spark, streams.in_trials(stream, trials, ["user_id"], "at", "low", "high"), "inside", at)
    assert sorted(r["event_id"] for r in got.collect()) == [10, 13, 16, 19]
