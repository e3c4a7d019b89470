"""File sources and sinks on small files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.sources import files


def bitmap(path, rows):
    """A 24-bit bitmap of rows of (b, g, r), top row first."""
    height, width = len(rows), len(rows[0])
    pad = b"\0" * (-3 * width % 4)
    body = b"".join(b"".join(bytes(p) for p in row) + pad for row in reversed(rows))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16)
    path.write_bytes(head + info + body)


def test_images_become_pixels_and_the_rest_rejects(spark, tmp_path):
    image = [[(1, 2, 3), (4, 5, 6), (250, 0, 7)], [(8, 9, 200), (11, 12, 13), (14, 15, 16)]]
    bitmap(tmp_path / "one.bmp", image)
    (tmp_path / "broken.png").write_bytes(b"not an image")
    pixels, rejects = files.read_images(spark, str(tmp_path))
    got = {(r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in pixels.collect()}
    assert got == {(x, y): p for y, row in enumerate(image) for x, p in enumerate(row)}
    assert [r["path"].rsplit("/", 1)[1] for r in rejects.collect()] == ["broken.png"]


def test_weather_files_by_scene_name(spark, tmp_path):
    (tmp_path / "north.json").write_text(json.dumps({"precipitation": 3.5, "wind_speed_10m": 12.0, "note": "x"}, indent=1))
    (tmp_path / "bad.json").write_text("{not json")
    scenes = spark.createDataFrame([(1, "north"), (2, "south"), (3, "bad")], "scene_id long, name string")
    got = {r["scene_id"]: r for r in files.read_weather(spark, str(tmp_path), scenes).collect()}
    calm = tuple(D.CALM[c] for c in ("precipitation", "wind_speed_10m", "wind_direction_10m"))
    assert tuple(got[1])[2:] == (3.5, 12.0, calm[2]) and tuple(got[2])[2:] == calm and tuple(got[3])[2:] == calm


def test_side_files_and_summaries_of_a_run(spark, tmp_path):
    points = spark.createDataFrame([(1, 4, k, x, y, kind) for k, (x, y, kind) in enumerate([(0, 0, "home"), (5, 1, "drop"), (0, 0, "reload"), (0, 0, "via"), (9, 9, "drop"), (0, 0, "home")])], "scene_id long, base_id long, seq int, x int, y int, kind string")
    scenes = spark.createDataFrame([(1, 25.5, 80.0, 2.0)], "scene_id long, lat double, lon double, m_per_px double")
    files.write_side_files(points.orderBy(F.desc("seq")), scenes, str(tmp_path / "side"), "a")
    (row,) = spark.read.json(str(tmp_path / "side" / "run_id=a")).collect()
    assert row["full_path"] == [[0, 0], [5, 1], [0, 0], [0, 0], [9, 9], [0, 0]] and row["drop_indices"] == [1, 4] and row["reload_indices"] == [2]
    assert row["home"] == [0, 0] and row["geo_center"] == [25.5, 80.0] and row["meters_per_pixel"] == 2.0
    summaries = spark.createDataFrame([(1, "success"), (2, "skipped")], "scene_id long, outcome string")
    files.write_summaries(summaries, str(tmp_path / "told"), "a")
    assert {(r["scene_id"], r["outcome"]) for r in spark.read.json(str(tmp_path / "told" / "run_id=a")).collect()} == {(1, "success"), (2, "skipped")}
    for write in (lambda: files.write_summaries(summaries, str(tmp_path / "told"), "a"), lambda: files.write_side_files(points, scenes, str(tmp_path / "side"), "a")):
        with pytest.raises(AnalysisException, match="exist"):
            write()
