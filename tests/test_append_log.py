"""Append logs: bounded segments, replays, readers and writers at the same time, lost writers."""

import pytest

from rivulet.session import work_dir
from rivulet.sources.append_log import AppendLog, Segment


def _batch(spark, b, rows=5):
    return spark.range(b * rows, (b + 1) * rows).selectExpr("id", f"{b} AS batch").coalesce(1)


def _log(spark, fanout=3):
    return AppendLog(spark, work_dir(spark, "append"), "id long, batch int", fanout)


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_segments_stay_few_and_rows_whole(spark):
    log = _log(spark)
    for b in range(13):
        assert log.append(_batch(spark, b), b) == 5 * (b + 1)
    assert [(s.first, s.last, s.n_rows) for s in log.manifest()] == [(0, 8, 45), (9, 11, 15), (12, 12, 5)]
    assert _ids(log.read()) == list(range(65)) and log.count() == log.read().count()
    assert log.clean() > 0 and log.clean() == 0
    assert _ids(log.read()) == list(range(65))
    other = AppendLog(spark, log.root, "id long, batch int", 3)     # another session goes on where this one stopped
    assert other.append(_batch(spark, 13), 13) == 70


@pytest.mark.parametrize("n, fanout", [(144, 8), (1000, 2), (729, 3)])
def test_the_bound_on_segments(n, fanout):
    log = AppendLog.__new__(AppendLog)
    log.fanout, segments = fanout, []
    for b in range(n):
        segments.append(Segment(b, b, str(b), 1))
        while run := log._due(segments):
            segments = sorted([s for s in segments if s not in run] + [Segment(run[0].first, run[-1].last, "m", 1)])
        digits, left = 0, b + 1
        while left:
            digits, left = digits + left % fanout, left // fanout
        assert len(segments) == digits
        assert [s.first for s in segments[1:]] == [s.last + 1 for s in segments[:-1]]


def test_a_replayed_batch_doubles_nothing_and_none_is_skipped(spark):
    log = _log(spark)
    log.append(_batch(spark, 0), 0)
    assert log.append(_batch(spark, 0), 0) == 5
    with pytest.raises(ValueError, match="batch 2 before batch 1"):
        log.append(_batch(spark, 2), 2)
    assert log.append(_batch(spark, 1, rows=0), 1) == 5     # an empty batch is a batch
    assert log.append(_batch(spark, 2), 2) == 10 and _ids(log.read()) == [*range(5), *range(10, 15)]


def test_a_reader_during_a_merge_sees_each_row_once(spark):
    log = _log(spark)
    for b in range(2):
        log.append(_batch(spark, b), b)
    before = log.read()
    log.append(_batch(spark, 2), 2)                          # merges the segments that ``before`` reads
    assert len(log.manifest()) == 1
    assert _ids(before) == list(range(10)) and _ids(log.read()) == list(range(15))


def test_two_writers_of_one_batch(spark, monkeypatch):
    log, rival = _log(spark), None
    rival = AppendLog(spark, log.root, "id long, batch int", 3)
    write = log._write

    def overtaken(rows, first, last):
        out = write(rows, first, last)
        if first == last == 0:
            rival.append(_batch(spark, 0), 0)
        return out

    monkeypatch.setattr(log, "_write", overtaken)
    assert log.append(_batch(spark, 0), 0) == 5 and _ids(log.read()) == list(range(5))


def test_a_merge_that_is_overtaken_keeps_the_new_batch(spark, monkeypatch):
    log = _log(spark)
    rival = AppendLog(spark, log.root, "id long, batch int", 99)
    for b in range(3):
        rival.append(_batch(spark, b), b)
    write = log._write

    def overtaken(rows, first, last):
        out = write(rows, first, last)
        rival.append(_batch(spark, 3), 3)
        return out

    monkeypatch.setattr(log, "_write", overtaken)
    assert log.compact() == 1
    assert [(s.first, s.last) for s in log.manifest()] == [(0, 2), (3, 3)] and _ids(log.read()) == list(range(20))


def test_a_lost_writer_leaves_nothing_in_the_log(spark, monkeypatch):
    log = _log(spark)
    log.append(_batch(spark, 0), 0)
    monkeypatch.setattr(log, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        log.append(_batch(spark, 1), 1)
    monkeypatch.undo()
    assert _ids(log.read()) == list(range(5)) and log.append(_batch(spark, 1), 1) == 10
    assert log.clean() == 1 and _ids(log.read()) == list(range(10))
