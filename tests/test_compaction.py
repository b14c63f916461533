import pytest

from pulsegrid.sources import compaction, tables
from pulsegrid.sources.files import Files
from tests.test_storing import ROW, T0, reading, stored

DAY = T0.date().isoformat()


def rows(spark, numbers, temperature=1.0):
    return spark.createDataFrame([reading(i % 24, i, temperature)[:3] + (i,) + reading(i, i, temperature)[4:] for i in numbers], ROW)


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "raw")
    for n in range(6):
        tables.write_telemetry(rows(spark, range(10 * n, 10 * n + 10)), where)
    return where


def test_every_row_once_before_during_and_after(spark, path):
    want = [(i, 1.0) for i in range(60)]
    assert stored(spark, path) == want
    before = len(Files(spark, path).names(f"{path}/dt={DAY}"))
    assert before >= 6
    assert compaction.compact_day(spark, path, DAY, file_rows=25)["written"] == 60
    assert stored(spark, path) == want  # replaced files still lie there
    assert tables.write_telemetry(rows(spark, range(50, 70), 9.0), path) == {"offered": 20, "written": 10}
    want += [(i, 9.0) for i in range(60, 70)]
    assert stored(spark, path) == want
    assert compaction.clean(spark, path) >= 6
    assert stored(spark, path) == want
    assert tables.write_telemetry(rows(spark, range(70), 7.0), path)["written"] == 0
    folder = f"{path}_compacted/rows"
    left = len(spark.read.parquet(folder).inputFiles()) + len([n for n in Files(spark, path).names(f"{path}/dt={DAY}") if n.endswith("parquet")])
    assert left < before
    assert compaction.clean(spark, path) == 0


def test_compacting_again_takes_only_new_files(spark, path):
    first = compaction.compact_day(spark, path, DAY)
    assert compaction.compact_day(spark, path, DAY) == {"files": 0, "written": 0}
    for n in (60, 61):
        tables.write_telemetry(rows(spark, [n]), path)
    assert compaction.compact_day(spark, path, DAY)["written"] == 2 and first["written"] == 60
    compaction.clean(spark, path)
    assert stored(spark, path) == [(i, 1.0) for i in range(62)]


def test_a_compaction_that_dies_before_its_record_changes_nothing(spark, path, monkeypatch):
    def failing(self, *args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(compaction.Files, "write", failing)
        with pytest.raises(RuntimeError):
            compaction.compact_day(spark, path, DAY)
    assert stored(spark, path) == [(i, 1.0) for i in range(60)]
    compaction.compact_day(spark, path, DAY)
    compaction.clean(spark, path)
    assert stored(spark, path) == [(i, 1.0) for i in range(60)]


def test_rows_of_a_device_lie_together(spark, path):
    compaction.compact_day(spark, path, DAY, file_rows=20)
    compaction.clean(spark, path)
    found = tables.find_stored(spark, path, "d", 17, DAY, DAY)
    assert [r.sequence_id for r in found.collect()] == [17]
    parts = spark.read.parquet(f"{path}_compacted/rows").selectExpr("_metadata.file_name AS f", "time")
    spans = sorted((r.low, r.high) for r in parts.groupBy("f").agg({"time": "min"}).join(parts.groupBy("f").agg({"time": "max"}), "f").toDF("f", "low", "high").collect())
    assert len(spans) >= 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_absent_table(spark, tmp_path):
    assert compaction.compact_day(spark, str(tmp_path / "none"), DAY) == {"files": 0, "written": 0}
    assert compaction.clean(spark, str(tmp_path / "none")) == 0
