"""Tables that change partition by partition: which files a change writes, who sees it when."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from rivulet.sources import folders
from rivulet.sources.folders import FolderTable

SCHEMA = "id int, name string, key int, day string"


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def _table(spark, tmp_path, *rows, keys=("key",)):
    return FolderTable.create(_rows(spark, *rows), str(tmp_path / "t"), list(keys))


def _ids(df):
    return sorted((r["key"], r["id"], r["name"]) for r in df.collect())


def _files(table):
    return {p: sorted(f for f in files) for p, files in _by_part(table).items()}


def _by_part(table):
    out = {}
    for r in table.read().selectExpr("key", "_metadata.file_path AS f").distinct().collect():
        out.setdefault(r["key"], []).append(r["f"])
    return out


def test_only_partitions_with_rows_are_rewritten(spark, tmp_path):
    t = _table(spark, tmp_path, (1, "a", 1, "x"), (2, "b", 2, "x"), (2, "b", 2, "x"), (3, None, None, "x"))
    assert t.union_distinct(_rows(spark)) == 2  # drops the repeat that the first insert brought
    assert _ids(t.read().na.fill(0, ["key"])) == [(0, 3, None), (1, 1, "a"), (2, 2, "b")]
    before = _files(t)
    assert t.union_distinct(_rows(spark, (1, "a", 1, "x"), (9, "n", 1, "x"), (7, "q", 4, "y"))) == 3
    after = _files(t)
    assert before[2] == after[2] and before[None] == after[None] and before[1] != after[1] and set(after) == {1, 2, 4, None}
    assert _ids(t.read().where("key IS NOT NULL")) == [(1, 1, "a"), (1, 9, "n"), (2, 2, "b"), (4, 7, "q")]
    assert t.union_distinct(_rows(spark)) == 3  # nothing to do
    # every version stays readable, and pruning by key still works
    assert t.read(1).count() == 4 and t.read(2).count() == 3
    plan = t.read().where("key = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key" in plan


def test_static_partition_insert(spark, tmp_path):
    t = _table(spark, tmp_path, (1, "a", 1, "x"), (2, "b", 2, "y/=z"), keys=("key", "day"))
    t.insert_partition({"key": 2, "day": "y/=z"}, spark.createDataFrame([(5, "e")], "n long, s string"))
    got = sorted(map(tuple, t.read().collect()))
    assert got == [(1, "a", 1, "x"), (2, "b", 2, "y/=z"), (5, "e", 2, "y/=z")]
    assert t.read().columns == ["id", "name", "key", "day"]
    with pytest.raises(ValueError, match="must name"):
        t.insert_partition({"key": 2}, spark.createDataFrame([(5, "e")], "n long, s string"))
    with pytest.raises(ValueError, match="columns"):
        t.insert_partition({"key": 2, "day": "x"}, spark.createDataFrame([(5,)], "n long"))


def test_a_crash_between_the_steps_changes_nothing(spark, tmp_path, monkeypatch):
    t = _table(spark, tmp_path, (1, "a", 1, "x"), (2, "b", 2, "x"))
    reader = FolderTable(spark.newSession(), t.root)
    lost = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    # before the new folders have their place, and after it, before the version is published
    for where, name in ((folders, "publish"), (FolderTable, "_publish")):
        monkeypatch.setattr(where, name, lost)
        with pytest.raises(OSError):
            t.union_distinct(_rows(spark, (9, "n", 1, "x")))
        monkeypatch.undo()
    assert reader.version() == 1 and _ids(reader.read()) == [(1, 1, "a"), (2, 2, "b")]
    held = reader.read()
    assert t.union_distinct(_rows(spark, (9, "n", 1, "x"))) == 2
    # a reader that began before the change still has the table as it was; a new one has it whole
    assert _ids(held) == [(1, 1, "a"), (2, 2, "b")]
    assert _ids(reader.read()) == [(1, 1, "a"), (1, 9, "n"), (2, 2, "b")]
    gone = t.clean()
    assert gone >= 4 and _ids(FolderTable(spark, t.root).read()) == [(1, 1, "a"), (1, 9, "n"), (2, 2, "b")]


def test_writers_that_race_lose_no_change(spark, tmp_path):
    t = _table(spark, tmp_path, (0, "a", 0, "x"))

    def work(k):
        mine = FolderTable(spark, t.root)
        return [mine.union_distinct(_rows(spark, (k * 10 + i, "n", i % 2, "x"), (0, "a", 0, "x"))) for i in range(3)]

    with ThreadPoolExecutor(3) as pool:
        versions = [v for vs in pool.map(work, (1, 2, 3)) for v in vs]
    assert sorted(versions) == list(range(2, 11))
    assert [i for _, i, _ in _ids(t.read().orderBy("id"))] == sorted([0, 10, 12, 20, 22, 30, 32]) + [11, 21, 31]


def test_names_and_existing_tables_are_refused(spark, tmp_path):
    _table(spark, tmp_path, (1, "a", 1, "x"))
    with pytest.raises(Exception, match="(?i)exists"):
        _table(spark, tmp_path, (1, "a", 1, "x"))
    with pytest.raises(ValueError, match="written"):
        FolderTable.create(spark.createDataFrame([(1, 2)], "written int, key int"), str(tmp_path / "u"), ["key"])
