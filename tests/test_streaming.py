"""Streaming operators against their batch forms."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelforge.streaming import panel_streams as Z


def _run(query, spark, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"/tmp/spark-{name}-{dt.datetime.now().timestamp()}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_bars_equal_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("A" if i % 3 else "B", start + dt.timedelta(minutes=i), float(i % 7), 1.0, i) for i in range(300)]
    rows.append(("A", start + dt.timedelta(days=2), 1.0, 1.0, 999))  # moves the watermark past the rest
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, seq long").repartition(1).sortWithinPartitions("ts")
    df.write.parquet(f"{tmp_path}/trades")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/trades")
    got = {tuple(r) for r in _run(Z.bars(stream, "1 hour"), spark, "bars").collect()}
    want = {tuple(r) for r in Z.bars(df, "1 hour").where(F.col("start") < F.lit("2024-01-02")).collect()}
    assert got == want


def test_unseen(spark, tmp_path):
    rows = [("h1", dt.datetime(2024, 1, 1, 1)), ("h1", dt.datetime(2024, 1, 1, 2)), ("h2", dt.datetime(2024, 1, 1, 3))]
    df = spark.createDataFrame(rows, "hash string, ts timestamp")
    df.write.parquet(f"{tmp_path}/articles")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/articles")
    assert sorted(r.hash for r in _run(Z.unseen(stream), spark, "unseen").collect()) == ["h1", "h2"]


def test_decayed_sentiment_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("A" if i % 2 else "B", start + dt.timedelta(minutes=17 * i), float(i % 5) - 2) for i in range(60)] + [("A", start + dt.timedelta(days=3), 0.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, score double").repartition(1).sortWithinPartitions("ts")
    df.write.parquet(f"{tmp_path}/scores")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/scores")
    got = {tuple(r) for r in _run(Z.decayed_sentiment(stream, "2 hours", "1 hour"), spark, "decayed").collect()}
    assert got == {tuple(r) for r in Z.decayed_sentiment(df, "2 hours", "1 hour").where(F.col("end") < F.lit("2024-01-03")).collect()}


def test_scores_meet_their_outcomes(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    scores = spark.createDataFrame([("A", start + dt.timedelta(hours=i), float(i)) for i in range(4)], "ticker string, ts timestamp, score double")
    outcomes = spark.createDataFrame([("A", start + dt.timedelta(hours=2, minutes=30), 1.0), ("B", start, 2.0), ("A", start + dt.timedelta(hours=9), 3.0)], "ticker string, ts timestamp, outcome double")
    for name, df in (("s", scores), ("o", outcomes)):
        df.write.parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}") for name, df in (("s", scores), ("o", outcomes))]
    got = sorted(r.score for r in _run(Z.score_outcomes(*streams, "2 hours"), spark, "met").collect())
    assert got == sorted(r.score for r in Z.score_outcomes(scores, outcomes, "2 hours").collect()) == [1.0, 2.0]


def test_running_drawdown_of_shuffled_days_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(run, start + dt.timedelta(days=i), float(x)) for run in ("r", "s") for i, x in enumerate(rng.normal(0, 0.03, 40))]
    order = sorted(rows, key=lambda r: (r[1] - start).days + rng.integers(0, 8))  # up to seven days out of order
    end = [(run, start + dt.timedelta(days=90), 0.0) for run in ("r", "s")]
    schema = "run string, date timestamp, net double"
    for i in range(5):  # a file a batch
        spark.createDataFrame(order[i * 16 : i * 16 + 16] + (end if i == 4 else []), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/days")
    spark.createDataFrame([("r", start, 9.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/days")  # too late: dropped
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/days")
    got = {(r.run, r.date): (r.dd, r.scale) for r in _run(Z.running_drawdown(stream), spark, "drawn").collect()}
    want = {(r.run, r.date): (r.dd, r.scale) for r in Z.batch_drawdown(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and len(want) == 80
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want) and min(v[1] for v in want.values()) < 1
