import pandas as pd

from seriesloom.series import Series
from seriesloom.streaming.rolling import stream_features, stream_profile

S = Series(("ts", "event_id"), ("user_id",))


def test_stream_features_equal_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id", "value").where("user_id < 3")
    pdf = df.toPandas().sort_values(["ts", "event_id"])
    for i in range(2):
        part = pdf.iloc[i * len(pdf) // 2 : (i + 1) * len(pdf) // 2]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = stream_features(stream, S, "value", [1, 3], 5).writeStream.format("memory").queryName("features").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("features").toPandas().sort_values(["user_id", "ts"]).reset_index(drop=True)
    want = pdf.sort_values(["user_id", "ts"]).reset_index(drop=True)
    g = want.groupby("user_id")["value"]
    for name, w in (("value_lag_1", g.shift(1)), ("value_lag_3", g.shift(3)), ("value_roll_5_mean", g.transform(lambda s: s.rolling(5, 1).mean())), ("value_roll_5_std", g.transform(lambda s: s.rolling(5, 1).std()))):
        pd.testing.assert_series_equal(got[name].astype(float), w.astype(float), check_names=False)


def test_stream_profile(spark):
    df = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").parquet("/root/testdata/sf0.001/events.parquet")
    out = stream_profile(df, "ts", "value")
    assert out.isStreaming and out.columns == ["start", "mean", "std", "n"]
