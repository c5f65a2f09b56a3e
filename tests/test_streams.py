import pytest
from pyspark.sql import functions as F

from tarn.streaming.cells import drain, running_means, sessions


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "n long, s double, value double").select("n", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema("n long, ts timestamp, value double").parquet(f"{folder}/in")


def operators(q):
    return [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]


def seconds(rows, *columns):
    return sorted((r["n"], *(r[c].timestamp() for c in columns), pytest.approx(r["mean"]), r["hits"]) for r in rows)


def test_means_are_told_when_idle_and_their_state_goes(spark, tmp_path):
    make = lambda: running_means(stream(spark, tmp_path), F.col("n"), "10 seconds", 50.0)
    feed(spark, tmp_path, [(1, 5.0, 2.0), (1, 9.0, 4.0), (2, 7.0, None), (3, 95.0, 1.0), (4, 100.0, 8.0)])
    first = drain(make(), f"{tmp_path}")
    assert seconds(spark.read.parquet(f"{tmp_path}/out").where("n = 1").collect(), "first", "last") == [(1, 5.0, 9.0, 3.0, 2)]
    assert [(r["mean"], r["hits"]) for r in spark.read.parquet(f"{tmp_path}/out").where("n = 2").collect()] == [(None, 0)]
    # The watermark is at 90: the row at 80 comes too late, that at 96 doesn't.
    feed(spark, tmp_path, [(3, 80.0, 50.0), (3, 96.0, 3.0), (1, 97.0, 7.0), (5, 400.0, 1.0)])
    second = drain(make(), f"{tmp_path}")
    got = seconds(spark.read.parquet(f"{tmp_path}/out").where("n <> 2").collect(), "first", "last")
    assert got == [(1, 5.0, 9.0, 3.0, 2), (1, 97.0, 97.0, 7.0, 1), (3, 95.0, 96.0, 2.0, 2), (4, 100.0, 100.0, 8.0, 1)]
    assert max(x["numRowsTotal"] for x in operators(first)) >= 2 and operators(second)[-1]["numRowsTotal"] == 1  # cell 5 alone
    assert sum(x["numRowsDroppedByWatermark"] for x in operators(second)) == 1


def test_sessions_close_in_append_mode(spark, tmp_path):
    make = lambda: sessions(stream(spark, tmp_path), F.col("n"), "10 seconds", "20 seconds")
    feed(spark, tmp_path, [(1, 5.0, 2.0), (1, 20.0, 4.0), (1, 60.0, 1.0), (2, 100.0, 8.0)])
    drain(make(), f"{tmp_path}")
    assert seconds(spark.read.parquet(f"{tmp_path}/out").collect(), "start", "end") == [(1, 5.0, 40.0, 3.0, 2), (1, 60.0, 80.0, 1.0, 1)]
    feed(spark, tmp_path, [(1, 50.0, 9.0), (2, 85.0, 2.0), (2, 300.0, 1.0)])  # the first is too late
    q = drain(make(), f"{tmp_path}")
    assert seconds(spark.read.parquet(f"{tmp_path}/out").where("n = 2").collect(), "start", "end") == [(2, 85.0, 120.0, 5.0, 2)]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3 and operators(q)[-1]["numRowsTotal"] == 1


def test_windows_that_are_open_at_the_end_are_there(spark, data):
    from tarn.plans import catalog, more  # noqa: F401

    got = catalog.QUERIES["stream_windows"](spark, data)
    events = spark.read.parquet(f"{data}/events.parquet")
    assert got.agg(F.sum("hits")).first()[0] == events.where("value IS NOT NULL").count()
    assert got.agg(F.max("start")).first()[0] == events.agg(F.date_trunc("hour", F.max("ts"))).first()[0].replace(tzinfo=None)


def test_cells_share_states(spark, tmp_path):
    """Cells of one state are told by their own times, also where others of it have values in the same batch."""
    feed(spark, tmp_path, [(1, 1000.0, 2.0), (17, 1000.0, 4.0), (None, 1000.0, 6.0), (-15, 1000.0, None), *((16 * k + 2, 1001.0, float(k)) for k in range(1000))])
    feed(spark, tmp_path, [(33, 1100.0, 1.0)])
    feed(spark, tmp_path, [(17, 1095.0, 8.0), (49, 1300.0, 3.0)])  # the watermark is at 1090
    one_by_one = spark.readStream.schema("n long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = drain(running_means(one_by_one, F.col("n"), "10 seconds", 50.0), f"{tmp_path}")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 1005 and got.where("n is null").first()["mean"] == 6.0 and got.where("n = -15").first()["mean"] is None
    assert seconds(got.where("n % 16 = 1 and n > 0").collect(), "first", "last") == [(1, 1000.0, 1000.0, 2.0, 1), (17, 1000.0, 1095.0, 6.0, 2), (33, 1100.0, 1100.0, 1.0, 1)]
    assert got.where("n % 16 = 2 and mean = (n - 2) / 16 and hits = 1").count() == 1000
    assert max(x["numRowsTotal"] for x in operators(q)) == 4 and operators(q)[-1]["numRowsTotal"] == 1  # cell 49
