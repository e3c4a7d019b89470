"""Runs that fail midway and feeds that stop and go on."""

import pytest
from pyspark.sql import functions as F

from tidemesh.operators import mission, routes, weather
from tidemesh.sources import files, runs
from tidemesh.streaming import weather as feed


def test_a_failed_run_is_never_read(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    order = spark.createDataFrame([(1, 1, k + 1, k, 10 * k, 20) for k in range(5)], "scene_id long, base_id long, seq int, drop_id long, x int, y int")
    homes = spark.createDataFrame([(1, 1, 50, 50)], "scene_id long, base_id long, x int, y int")
    scenes = spark.createDataFrame([(1, 200, 160, 25.0, 82.0, 8.0)], "scene_id long, width int, height int, lat double, lon double, m_per_px double")
    points = routes.closed_routes(order, homes, 3)
    told = mission.items(points, scenes)
    whole = {"missions": lambda to: mission.write_missions(told, to, "r1"), "sides": lambda to: files.write_side_files(points, scenes, to, "r1")}

    @F.udf("string")
    def broken(line):
        raise RuntimeError("disk gone")

    def half(to):
        half_broken = mission.lines(told).select(F.when(F.col("line_no") > 9, broken("line")).otherwise(F.col("line")).alias("line"))
        half_broken.repartition(4).write.text(to)

    assert runs.runs(spark, path).count() == 0
    with pytest.raises(Exception, match="disk gone"):
        runs.write_run(spark, path, "r1", {"missions": whole["missions"], "broken": half})
    assert runs.runs(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        runs.output(spark, path, "r1", "missions")

    runs.write_run(spark, path, "r1", whole)
    back = spark.read.text(runs.output(spark, path, "r1", "missions"))
    assert back.count() == told.count() + 1
    assert spark.read.json(runs.output(spark, path, "r1", "sides")).first()["home"] == [50, 50]
    with pytest.raises(FileNotFoundError):
        runs.output(spark, path, "r1", "broken")
    with pytest.raises(FileExistsError, match="already"):
        runs.write_run(spark, path, "r1", whole)
    with pytest.raises(FileExistsError, match="another attempt"):  # another attempt ends while this one writes
        runs.write_run(spark, path, "r2", {"a": lambda to: runs.write_run(spark, path, "r2", {"b": lambda to: spark.range(3).write.parquet(to)})})
    assert {(r["run_id"], *r["outputs"]) for r in runs.runs(spark, path).collect()} == {("r1", "missions", "sides"), ("r2", "b")}
    for name in ("", "a/b", "_x"):
        with pytest.raises(ValueError):
            runs.write_run(spark, path, name, {})


KINDS = "site_id long, t string, precipitation double, wind_speed_10m double, wind_direction_10m double"


def test_a_stream_stops_and_goes_on(spark, tmp_path, monkeypatch):
    def put(k, rows):
        df = spark.createDataFrame(rows, KINDS).withColumn("obs_ts", F.to_timestamp("t")).drop("t")
        df.coalesce(1).write.parquet(f"file://{tmp_path}/in/part={k}")

    def take():
        source = spark.readStream.schema("site_id long, precipitation double, wind_speed_10m double, wind_direction_10m double, obs_ts timestamp").option("maxFilesPerTrigger", 1)
        feed.replay(source.parquet(f"file://{tmp_path}/in/*"), f"file://{tmp_path}/out")

    at = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    first = [(s, at(h, m), float(m), float(h), 10.0) for s in (1, 2) for h in range(5) for m in (5, 20, 50)]
    second = [(1, at(4, 55), 3.0, 4.0, 20.0), (1, at(4, 50), 9.0, 9.0, 9.0), (1, at(2, 51), 2.0, None, 1.0), (1, at(2, 49), 7.0, 7.0, 7.0), (3, at(0, 1), float("nan"), 1.0, 2.0), (3, at(0, 1), float("nan"), 1.0, 2.0), (None, at(0, 1), 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0)]
    third = [(2, at(9, 0), 1.0, 1.0, 1.0), (1, at(2, 51), 2.0, 2.0, 1.0), (1, at(2, 54), 2.0, 2.0, 1.0), (1, at(2, 56), 2.0, 2.0, 1.0)]
    put(0, first)
    take()
    put(1, second)
    whole = feed.fold_batch

    def dies(*batch):
        whole(*batch)
        raise RuntimeError("driver gone")

    with monkeypatch.context() as m:  # the batch's tables are written, but it doesn't count as done and comes again
        m.setattr(feed, "fold_batch", dies)
        with pytest.raises(Exception, match="driver gone"):
            take()
    take()
    take()  # nothing new
    put(2, third)
    take()
    put(3, [(1, at(0, 1), 1.0, 1.0, 1.0)])  # nothing but a late reading
    take()
    sites = {r["site_id"]: r for r in feed.replayed_sites(spark, f"file://{tmp_path}/out").collect()}
    assert {s: (r["n"], r["late"], r["repeated"]) for s, r in sites.items()} == {1: (18, 4, 1), 2: (16, 0, 0), 3: (1, 0, 1)}
    assert str(sites[1]["newest_ts"])[11:16] == "04:55" and sites[1]["wind_direction_10m"] == 20.0 and sites[3]["precipitation"] == 0.0
    kept = first + [second[0], second[2], second[4], third[0], third[3]]
    batch = weather.hourly(spark.createDataFrame(kept, KINDS).withColumn("obs_ts", F.to_timestamp("t")))
    key = lambda df: sorted((r["site_id"], str(r["hour_start"]), r["n"], *(round(r[c], 9) for c in weather.FIELDS)) for r in df.collect())
    assert key(feed.replayed_hours(spark, f"file://{tmp_path}/out")) == key(batch)
