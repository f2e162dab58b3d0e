"""Every registered query against its SQL."""

import pytest

from lexmill.plans.queries import QUERIES, SQL


def _rows(rows):
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == names
    order = [expected.columns.index(n) for n in names]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert _rows(got) == _rows([tuple(r[i] for i in order) for r in expected.fetchall()])
    assert got or name == "search_absent"


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_oversized_phase_cuts_at_a_byte(spark, tmp_path):
    """All documents, those with characters of several bytes too, against plain Python."""
    texts = {
        1: "é" * 2043 + "thatinthatin", 2: "é" * 2046 + "thatin", 3: "a" + "日" * 1364 + "thatin", 4: "Thatin é\n" + "ü" * 3000 + "thatin",
        5: "x" * 4085 + "\nthatin🎉" + "x" * 9, 6: "x" * 4088 + "thatin🎉", 7: "kurz é thatin", 8: "🎉" * 1023 + "é" * 3 + "thatin", 9: "thatin " * 600,
    }
    rows = [(i, t, "fr", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for i, t in texts.items():
        read = t.encode()[:4096].decode("utf-8", "ignore")
        at, hit = read.lower().find("thatin"), 0
        while at >= 0:
            expected.add((i, hit, read.count("\n", 0, at) + 1, at - read.rfind("\n", 0, at)))
            at, hit = read.lower().find("thatin", at + 6), hit + 1
    got = QUERIES["search_oversized_phase"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["hit"], r["line"], r["col"]) for r in got} == expected and len(got) == len(expected)
    assert {i for i, *_ in expected} == {1, 4, 5, 6, 7, 9}
    assert all(r["line_text"] in texts[r["doc_id"]] for r in got)
