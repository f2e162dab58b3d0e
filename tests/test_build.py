import io
import os
import zipfile

import pytest

from lexmill.functions.encoding import DecodeError, decode, sniff, without_broken_tail
from lexmill.functions.masks import NameMasks
from lexmill.operators.search import SearchOptions, search
from lexmill.plans.build import BuildCancelled, rebuild_index, update_index
from lexmill.plans.catalog import Catalog, InvalidInput, NotFound, Preferences, ProjectSettings, SearchParams, settings_of_form
from lexmill.plans.jobs import search_projects
from lexmill.plans.live import search_live
from lexmill.plans.options import ArchiveOptions, BuildOptions, InvalidOptions, RootSpec
from lexmill.plans.snapshot import POINTER, IncompleteIndex, Index, IndexNotFound, NotAnIndex, verify_index


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    def write(name, data):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    write("a.txt", b"one needle\ntwo")
    write("sub/.hidden/b.md", "Été needle".encode())
    write("node_modules/x.txt", b"needle")
    write("p.png", b"needle")
    write("bin.dat", b"a\0b")
    write("bad.txt", b"abc\xffneedle")
    write("wide.txt", "﻿needle wide".encode("utf-16-le"))
    write("big.txt", b"head needle " + b"x" * 2000)
    write("arc.zip", packed({"d/one.txt": b"needle in zip", "inner.zip": packed({"x.txt": b"nested needle", "deep.zip": packed({"y": b"no"})}), "i.class": b"zz"}))
    return tmp_path, write


def options(tmp_path, **more):
    return BuildOptions((RootSpec(str(tmp_path / "src")),), max_file_size=1000, **more)


def rows(index):
    return sorted((r["file_path"], r["entry_path"] or "", r["ext"], r["size"], r["status"], r["reason"]) for r in index.documents().collect())


def found(index, query="needle", **more):
    return sorted((r["file_path"], r["entry_path"] or "", r["line"], r["column"]) for r in search(index.rows(), query, SearchOptions(**more)).collect())


def test_build_search_update_equals_rebuild(spark, tree):
    tmp, write = tree
    path = str(tmp / "index")
    report = rebuild_index(spark, path, options(tmp))
    c = report.counters
    assert (c["files_indexed"], c["files_too_large"], c["errors"], c["files_security_limited"], c["directories_excluded"]) == (5, 1, 1, 1, 1)
    assert (c["files_ignored_by_name"], c["files_ignored_by_sniff"], c["archive_entries_skipped_by_name"]) == (1, 1, 1)
    assert verify_index(spark, path).indexed_files == 5
    live = search_live(Index(spark, path), "needle", SearchOptions(analyze_oversized=True))
    assert live.results.count() == 6 and live.counters.first()["truncated"] == 1
    quiet = update_index(spark, path, options(tmp))
    assert quiet.kind == "update" and quiet.delta == {"added": 0, "removed": 0, "updated": 0} and quiet.counters["bytes_read"] < 100
    write("a.txt", b"changed NEEDLE")
    write("new.txt", b"new needle")
    write("arc.zip", packed({"d/one.txt": b"other needle needle"}))
    os.remove(tmp / "src/sub/.hidden/b.md")
    update = update_index(spark, path, options(tmp))
    assert update.delta == {"added": 1, "removed": 1, "updated": 2}
    other = str(tmp / "other")
    rebuild_index(spark, other, options(tmp))
    assert rows(Index(spark, path)) == rows(Index(spark, other))
    for more in ({}, {"case_sensitive": True}, {"whole_word": True}):
        assert found(Index(spark, path), **more) == found(Index(spark, other), **more)
    assert update_index(spark, path, options(tmp, respect_gitignore=True)).kind == "full"
    # Two projects over one tree: the first in order keeps each file.
    merged, outcomes = search_projects(spark, [("p", path), ("q", other), ("gone", str(tmp / "none")), ("p", other)], "needle")
    assert [o.state for o in outcomes] == ["success", "success", "failed"] and {r["project_id"] for r in merged.collect()} == {"p"}
    # Stale: the file is no longer what the index knows.
    write("a.txt", b"changed needle again")
    stale = search_live(Index(spark, path), "needle")
    assert stale.counters.first()["stale"] == 1


def test_archive_limits(spark, tmp_path):
    (tmp_path / "src").mkdir()
    many = {f"{i:02}.txt": b"t %d" % i for i in range(30)}
    (tmp_path / "src/many.zip").write_bytes(packed(many))
    (tmp_path / "src/renamed.dat").write_bytes(packed({"long.txt": b"y" * 500, "ok.txt": b"fine"}))
    (tmp_path / "src/broken.zip").write_bytes(b"PK\x03\x04 not really")
    opts = BuildOptions((RootSpec(str(tmp_path / "src")),), archives=ArchiveOptions(max_entries=10, max_entry_size=100))
    rebuild_index(spark, str(tmp_path / "i"), opts)
    got = rows(Index(spark, str(tmp_path / "i")))
    many = [r for r in got if r[0].endswith("many.zip")]
    assert len([r for r in many if r[4] == 0]) == 10 and [r[1] for r in many if r[4] == 4] == [""]
    assert {(r[1], r[4]) for r in got if r[0].endswith("renamed.dat")} == {("long.txt", 4), ("ok.txt", 0)}
    assert [r[5][:17] for r in got if r[0].endswith("broken.zip")] == ["[corrupt_archive]"]
    off = BuildOptions((RootSpec(str(tmp_path / "src")),), archives=ArchiveOptions(enabled=False))
    report = rebuild_index(spark, str(tmp_path / "off"), off)
    assert report.warning and report.counters["files_ignored"] == 3


def test_masks_ignore_files_and_cancel(spark, tree):
    tmp, write = tree
    write(".gitignore", b"*.log\n!keep.log\nsub/\n")
    write("x.log", b"needle")
    write("keep.log", b"needle kept")
    path = str(tmp / "index")
    rebuild_index(spark, path, options(tmp, respect_gitignore=True, masks=NameMasks.of("*.log;*.txt", "big*;*.zip")))
    assert {os.path.basename(r[0]) for r in rows(Index(spark, path)) if r[4] == 0} == {"keep.log", "a.txt", "wide.txt"}
    before = rows(Index(spark, path))
    with pytest.raises(BuildCancelled):
        rebuild_index(spark, path, options(tmp), cancelled=iter([False, False, True]).__next__)
    assert rows(Index(spark, path)) == before
    assert len([n for n in os.listdir(path) if n.startswith("snap-")]) <= 2 and not [n for n in os.listdir(path) if n.startswith("stage-")]


def test_broken_indexes(spark, tmp_path):
    with pytest.raises(IndexNotFound):
        Index(spark, str(tmp_path / "none"))
    (tmp_path / "x").mkdir()
    with pytest.raises(NotAnIndex):
        Index(spark, str(tmp_path / "x"))
    (tmp_path / "x" / POINTER).write_text("snap-1")
    with pytest.raises(IncompleteIndex):
        Index(spark, str(tmp_path / "x"))


def test_roots():
    many = BuildOptions((RootSpec("/r/bin"), RootSpec("/r/bin2"), RootSpec("/R/Bin"), RootSpec("/r/bin/a"), RootSpec("/q/s", False), RootSpec("/q")))
    kept, skipped = many.normalized_roots()
    assert [r.path for r in kept] == ["/r/bin", "/r/bin2", "/q"] and len(skipped) == 3
    shallow = BuildOptions((RootSpec("/p", False), RootSpec("/p/n")))
    assert len(shallow.normalized_roots()[0]) == 2
    for bad in (BuildOptions(()), BuildOptions((RootSpec("/a"), RootSpec("/A", False))), BuildOptions((RootSpec("/a"),), max_file_size=0)):
        with pytest.raises(InvalidOptions):
            bad.validate()
    assert BuildOptions.from_json(many.to_json()) == many


def test_decoding():
    assert decode(b"caf\xe9", "windows-1252") == ("café", True) and decode(b"A\x81", "windows-1252")[0] == "A\x81"
    for data, code in ((b"abc\xff", "invalid_utf8"), (b"\xff\xfea", "invalid_encoding"), (b"\xff\xfe\x00\xd8", "invalid_encoding"), (b"\0\0\xfe\xff", "unsupported_utf32")):
        with pytest.raises(DecodeError) as e:
            decode(data)
        assert e.value.code == code
    assert sniff(b"\x7fELF\0") == "binary" and sniff(b"") == "text" and sniff(b"PK\x05\x06") == "archive"
    for n in range(1, 12):
        without_broken_tail("aé日🎉b".encode()[:n]).decode()


def test_catalog(tmp_path):
    c = Catalog(str(tmp_path))
    s = ProjectSettings((RootSpec("/a"),))
    p, q = c.create_project("p", s), c.create_project("q", s)
    assert c.status(p) == "never built" and [x.name for x in c.projects()] == ["p", "q"]
    with pytest.raises(InvalidOptions):
        c.create_project("bad", ProjectSettings())
    with pytest.raises(InvalidInput):
        c.save_search(p.id, "  ", "x")
    one = c.save_search(p.id, " one ", "abc")
    both = c.save_search(p.id, "both", "abc", SearchParams(project_ids=(p.id, q.id)))
    assert one.name == "one" and one.params.selection(p.id) == (p.id,)
    c.delete_project(p.id)
    with pytest.raises(NotFound):
        c.search(one.id)
    assert (c.search(both.id).project_id, c.search(both.id).params.project_ids) == (q.id, (q.id,))
    c.save_preferences(Preferences(default_exclude_masks=(" *.a ", "", "*.a", "*.b")))
    assert c.preferences().default_exclude_masks == ("*.a", "*.b") and not c.preferences().new_project().archives_enabled
    assert settings_of_form(s, [("", True), (" /x ", False)], "a, b;c", "*.t;*.u", "", "x").max_file_size == 0
    assert ProjectSettings.from_json({"roots": []}).fallback_encoding is None


def test_stream_search(spark, tmp_path):
    from lexmill.streaming.follow import search_stream

    ddl = "doc_id long, file_path string, entry_path string, size long, mtime_ns long, content string"
    spark.createDataFrame([(1, "a", None, 3, 1, "x needle\nNEEDLE")], ddl).write.parquet(str(tmp_path / "in"))
    stream = search_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "needle")
    query = stream.writeStream.format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["line"], r["column"]) for r in spark.sql("SELECT * FROM hits").collect()) == [(1, 3), (2, 1)]


def small_tree(tmp_path, names):
    (tmp_path / "src").mkdir(exist_ok=True)
    for n in names:
        (tmp_path / "src" / f"{n}.txt").write_text(f"needle of {n}")
    return options(tmp_path)


def test_update_of_one_document(spark, tmp_path):
    path, how = str(tmp_path / "index"), small_tree(tmp_path, ["a"])
    rebuild_index(spark, path, how)
    small_tree(tmp_path, ["b"])
    update_index(spark, path, how)
    index = Index(spark, path)
    assert len({r["doc_id"] for r in index.documents().collect()}) == 2
    lines = sorted((os.path.basename(r["file_path"]), r["line_text"]) for r in search(index.rows("needle"), "needle").collect())
    assert lines == [("a.txt", "needle of a"), ("b.txt", "needle of b")]


def test_a_reader_outlives_an_update_and_segments_stay_few(spark, tmp_path):
    path, how = str(tmp_path / "index"), small_tree(tmp_path, "abcdefghij")
    rebuild_index(spark, path, how)
    os.mkdir(f"{path}/stage-left-by-a-crash")
    for n in range(5):
        before = Index(spark, path)
        names = {r["file_path"] for r in before.documents().collect()}
        small_tree(tmp_path, [f"n{n}", "a"])
        os.utime(tmp_path / "src" / "a.txt", (n + 1, n + 1))
        os.remove(tmp_path / "src" / f"{'bcdef'[n]}.txt")
        update_index(spark, path, how)
        assert {r["file_path"] for r in search(before.rows("needle"), "needle").collect()} == names
        now = Index(spark, path)
        assert len(now.manifest.segments) <= 2 and now.contents().count() <= 13
        assert len(found(now)) == 10
    held = now.manifest.segments
    assert update_index(spark, path, how).delta == {"added": 0, "removed": 0, "updated": 0}
    assert Index(spark, path).manifest.segments == held and not [n for n in os.listdir(path) if n.startswith("stage-")]


def test_contents_of_another_engine_are_read_anew(spark, tmp_path):
    path, how = str(tmp_path / "index"), small_tree(tmp_path, ["a"])
    rebuild_index(spark, path, how)
    manifest = f"{path}/{open(f'{path}/{POINTER}').read().strip()}/manifest.json"
    text = open(manifest).read()
    with open(manifest, "w") as f:
        f.write(text.replace('"engine": "2"', '"engine": "1"'))
    (tmp_path / "index" / os.path.basename(os.path.dirname(manifest)) / ".manifest.json.crc").unlink(missing_ok=True)
    assert update_index(spark, path, how).kind == "full"
    assert update_index(spark, path, how).kind == "update"


def test_cancel_stops_a_running_job(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    from lexmill.plans.cancel import Cancellation

    slow = spark.range(0, 8, 1, 8).mapInPandas(lambda frames: (time.sleep(60) or f for f in frames), "id long")
    with Cancellation(spark) as stop:
        threading.Timer(3, stop.cancel).start()
        began = time.monotonic()
        with pytest.raises(Exception, match="(?i)cancel"):
            slow.agg(F.sum("id")).collect()
        assert time.monotonic() - began < 30 and stop()
    assert spark.range(3).count() == 3


def test_progress_and_counters_of_several_projects(spark, tmp_path):
    from lexmill.plans.jobs import project_counters, replaced

    path, how, told = str(tmp_path / "index"), small_tree(tmp_path, "ab"), []
    rebuild_index(spark, path, how, progress=told.append)
    assert told == ["scan", "process", "write", "report", "activate"]
    for live in (False, True):
        found_rows, outcomes = search_projects(spark, [("p", path), ("q", path), ("r", str(tmp_path / "none"))], "needle", live=live)
        assert found_rows.count() == 2 and [o.state for o in outcomes] == ["success", "success", "failed"]
        assert project_counters(outcomes).first()["from_index"] == 4
        assert project_counters(replaced(outcomes, "q", outcomes[0].counters.withColumn("from_index", outcomes[0].counters["from_index"] * 5))).first()["from_index"] == 12


def test_hidden_rows_keep_counts(spark):
    from lexmill.operators.view import hide, view_counts

    results = spark.createDataFrame([(1, 3), (2, 4)], "doc_id long, occurrences long")
    rows = hide(results, spark.createDataFrame([(2,), (2,)], "doc_id long"))
    assert tuple(view_counts(rows).first()) == (2, 7, 1)


def test_rows_of_an_archive_wait_in_a_file(spark, tmp_path, monkeypatch):
    from lexmill.sources import reader

    monkeypatch.setattr(reader, "SPOOL", 1000)
    (tmp_path / "a.zip").write_bytes(packed({f"e{i}.txt": b"needle " * 100 for i in range(20)}))
    stat = os.stat(tmp_path / "a.zip")
    how = BuildOptions((RootSpec(str(tmp_path)),))
    rows_of = list(reader.read_archive(str(tmp_path / "a.zip"), "zip", stat.st_size, stat.st_mtime_ns, how))
    assert [r[0] for r in rows_of] == ["archive_opened"] + ["indexed"] * 20
    assert [r[0] for r in reader.read_archive(str(tmp_path / "a.zip"), "zip", stat.st_size, 5, how)] == ["archive_opened", "error"]
    monkeypatch.setattr(reader, "NESTED", 10)
    import zipfile as z
    inner = packed({"in.zip": packed({"x.txt": b"needle"})})
    with pytest.raises(OSError), z.ZipFile(io.BytesIO(inner)) as archive:
        reader.read_entry(archive, "in.zip!/x.txt", 100)
