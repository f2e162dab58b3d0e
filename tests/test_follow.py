"""The stream wrapper for updates, and the command line."""

from lexmill import cli
from lexmill.plans.options import BuildOptions, RootSpec
from lexmill.plans.snapshot import Index
from lexmill.streaming.follow import update_on


def test_update_by_trigger(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("needle")
    spark.createDataFrame([("a.txt",)], "path string").write.parquet(str(tmp_path / "changes"))
    reports = []
    changes = spark.readStream.schema("path string").parquet(str(tmp_path / "changes"))
    query = update_on(changes, spark, str(tmp_path / "index"), BuildOptions((RootSpec(str(tmp_path / "src")),)), str(tmp_path / "checkpoint"), reports.append)
    query.processAllAvailable()
    (tmp_path / "src/b.txt").write_text("second needle")
    spark.createDataFrame([("b.txt",)], "path string").write.mode("append").parquet(str(tmp_path / "changes"))
    query.processAllAvailable()
    query.stop()
    assert [r.kind for r in reports] == ["full", "update"] and reports[1].delta == {"added": 1, "removed": 0, "updated": 0}
    assert Index(spark, str(tmp_path / "index")).manifest.indexed_files == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("one\nNeedle two")
    assert cli.main([str(tmp_path / "index"), "needle", str(tmp_path / "src"), "--context", "0"]) == 0
    out = capsys.readouterr().out
    assert "full: 1 indexed, 0 errors" in out and "a.txt:2:1: Needle two" in out
