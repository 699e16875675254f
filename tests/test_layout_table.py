"""Layouts as a versioned table: unique ids, refusals that change nothing, and writers that meet."""

import threading

import pytest

from quire.sources.layout_table import Conflict, LayoutTable, Refused


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, yaml string")


def held(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_create_update_save_and_delete(spark, tmp_path):
    table = LayoutTable(spark, str(tmp_path / "t"))
    assert held(table) == [] and table.versions() == []
    assert table.create(rows(spark, ("a", "canvas_id: x # c\nn: '1'\nn: 2"), (" b ", None))) == 1
    for refused in (
        lambda: table.create(rows(spark, ("c", ""), ("a", ""))),
        lambda: table.create(rows(spark, ("c", ""), ("c", ""))),
        lambda: table.save(rows(spark, ("../c", ""))),
        lambda: table.save(rows(spark, (None, ""))),
        lambda: table.update(rows(spark, ("c", ""))),
        lambda: table.delete(rows(spark, ("c", ""))),
        lambda: table.read(7),
    ):
        with pytest.raises(Refused):
            refused()
    assert held(table) == [("a", "canvas_id: x # c\nn: '1'\nn: 2"), ("b", "")] and table.versions() == [1]
    assert [(r.id, r.name, r.settings) for r in table.layouts().orderBy("id").collect()] == [("a", "x", {"canvas_id": "x", "n": "2"}), ("b", "b", {})]
    table.update(rows(spark, ("b", "z: 1")))
    table.save(rows(spark, ("b", "z: 2"), ("字1", "")))
    table.delete(rows(spark, ("a", None), ("a", None)))
    assert held(table) == [("b", "z: 2"), ("字1", "")] and held(table, 2) == [("a", "canvas_id: x # c\nn: '1'\nn: 2"), ("b", "z: 1")]
    table.forget(9)
    assert table.versions() == [4] and held(table) == [("b", "z: 2"), ("字1", "")]
    table.delete(table.read().select("id"))
    assert held(table) == []


def test_the_slower_of_two_writers_changes_the_newer_version(spark, tmp_path):
    first, second = (LayoutTable(spark, str(tmp_path / "t")) for _ in range(2))
    first.create(rows(spark, ("a", "0")))
    claim, met = second._claim, []

    def late(version, folder):
        if not met:
            met.append(first.save(rows(spark, ("a", "1"), ("b", "1"))))
        return claim(version, folder)

    second._claim = late
    assert second.save(rows(spark, ("a", "2"), ("c", "2"))) == 3 and met == [2]
    assert held(first) == [("a", "2"), ("b", "1"), ("c", "2")]
    met.clear()
    second._claim = lambda version, folder: (met.append(first.create(rows(spark, ("d", "1")))) if not met else None) or claim(version, folder)
    with pytest.raises(Refused):
        second.create(rows(spark, ("d", "2")))
    assert ("d", "1") in held(second)
    second._claim, second.tries = lambda version, folder: False, 2
    with pytest.raises(Conflict):
        second.save(rows(spark, ("e", "")))
    assert len(list((tmp_path / "t" / "rows").iterdir())) == len(first.versions())


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    workers = [threading.Thread(target=lambda k=k: LayoutTable(spark, path, tries=30).create(rows(spark, (f"w{k}", str(k))))) for k in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    table = LayoutTable(spark, path)
    assert held(table) == [(f"w{k}", str(k)) for k in range(4)] and table.versions() == [1, 2, 3, 4]


def test_a_number_whose_file_is_not_whole_is_no_version(spark, tmp_path):
    table = LayoutTable(spark, str(tmp_path / "t"))
    table.create(rows(spark, ("a", "")))
    (tmp_path / "t" / "versions" / "2").write_text("half")
    assert table.versions() == [1] and held(table) == [("a", "")]
