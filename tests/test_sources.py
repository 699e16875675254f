"""Readers over many files: order of records, images of every kind, named files."""

import struct
import zlib

import pytest

from quire.operators import evaluate as E
from quire.sources import files


def test_the_last_of_equal_indices_is_by_file_and_record(spark, tmp_path):
    path = tmp_path / "truth"
    path.mkdir()
    # Spark packs larger files first, so the last file must win though it is the smallest
    sizes = {"a.csv": 300, "b.csv": 30, "c.csv": 3}
    for name, n in sizes.items():
        (path / name).write_text("index,answer,from\n" + "".join(f'{i % 10},"{name}\n{i}",{name}\n' for i in range(n)))
    got = {r["index"]: r.answer for r in E.ground_truth(files.read_truth(spark, str(path)), "row_order").collect()}
    assert got == {i: f"c.csv\n{i}" if i < 3 else f"b.csv\n{20 + i}" for i in range(10)}


def png(width, height, colour, channels, pixels):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + pixels[y * width * channels : (y + 1) * width * channels] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_of_each_kind(spark, tmp_path):
    rgb, grey, clear = bytes(range(10, 28)), bytes(range(50, 56)), bytes(range(100, 124))
    for name, data in (("rgb.png", png(3, 2, 2, 3, rgb)), ("grey.png", png(2, 3, 0, 1, grey)), ("clear.png", png(2, 3, 6, 4, clear)), ("broken.png", b"no image"), ("empty.png", b""), ("other.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.width, r.height, bytes(r.rgb) if r.rgb is not None else None) for r in files.read_images(spark, str(tmp_path), "*.png").collect()}
    assert got.pop("grey.png")[:2] == (2, 3)
    none = (None, None, None)
    assert got == {"rgb.png": (3, 2, rgb), "clear.png": (2, 3, b"".join(clear[i : i + 3] for i in range(0, 24, 4))), "broken.png": none}


def test_named_files_come_back_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x: 1\ny: 'two' # two"), ("12", "x: 3"), ("d", None)], "name string, content string")
    files.write_named(rows, str(tmp_path / "n"))
    (tmp_path / "n" / "plain.yaml").write_text("x: 4\n")
    assert {r.file: r.settings for r in files.read_layouts(spark, str(tmp_path / "n")).collect()} == {"a": {"x": "1", "y": "two"}, "12": {"x": "3"}, "plain": {"x": "4"}}
    assert {r.book: r.text for r in files.read_books(spark, str(tmp_path / "n")).collect()} == {"a": "x: 1\ny: 'two' # two\n", "12": "x: 3\n", "d": "\n", "plain": "x: 4\n"}


def test_scripts_in_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.js").write_text("window.DATA_JSON = {\"pages\": [%s]};\n" % ", ".join(f'{{"fileName": "f{k}{i}", "text": "a = {{b}};"}}' for i in range(k)))
    assert sorted((r.fileName, r.text) for r in files.read_annotation(spark, str(tmp_path)).collect()) == [("f10", "a = {b};"), ("f20", "a = {b};"), ("f21", "a = {b};")]


def test_named_files_are_dealt_over_tasks_and_named_as_spark_does(spark, tmp_path):
    names = [f"n{k}" for k in range(40)] + ["a:b%c", "{x}=[y]", None]
    rows = spark.createDataFrame([(n, f"k: {n}") for n in names], "name string, content string").coalesce(1)
    files.write_named(rows, str(tmp_path / "own"), extension="yaml")
    rows.selectExpr("name", "content as value").write.partitionBy("name").text(str(tmp_path / "spark"))
    folders = {kind: sorted(x.name for x in (tmp_path / kind).iterdir() if x.is_dir()) for kind in ("own", "spark")}
    assert folders["own"] == folders["spark"]
    made = [x for x in (tmp_path / "own").rglob("*") if x.is_file()]
    assert len(made) == len(names) and all(x.suffix == ".yaml" for x in made)
    assert len({x.name.split("-")[1] for x in made}) > 1
    with pytest.raises(FileExistsError):
        files.write_named(rows, str(tmp_path / "own"))
    read = files.read_layouts(spark, str(tmp_path / "own"))
    assert read.count() == len(names)
    assert "Coalesce 4" in read._jdf.queryExecution().executedPlan().toString()
    for extension in ("txt", "csv"):  # by Spark's writers, as in other stores
        files.write_named(rows, str(tmp_path / extension), "overwrite", extension)
        assert len([x for x in (tmp_path / extension).rglob(f"part-*.{extension}")]) == len(names)
