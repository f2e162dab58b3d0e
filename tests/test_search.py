import random
import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions.fold import fold, fold_table, fold_text
from lexmill.functions.masks import NameMasks, parse_masks, wildcard_text
from lexmill.functions.matching import LiteralMatcher, QueryTooShort, validate_query
from lexmill.functions.viewer import around_match, bounded, focus, viewed, word_at, wrapped
from lexmill.operators import postings
from lexmill.operators import search as S
from lexmill.operators.view import InvalidFilter, ViewSpec, view, view_masks
from lexmill.sources import corpus

FRAGMENTS = ["a", "B", "needle", " ", "\t", "\"", "\\", "\\E", "é", "É", "日本", "ß", "ſ", "🎉", "Ω", "́", "-", "x_y", "0", "\r"]


def index(spark, texts, **more):
    rows = [(i, f"d/{i}.txt", None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, file_path string, entry_path string, content string")
    return corpus.indexed(df, F.col("doc_id"), F.col("file_path"), F.col("entry_path"), "txt", F.col("content"), F.lit(1_500_000_000), **more)


def hits(spark, text, query, **options):
    rows = S.search(index(spark, [text]), query, S.SearchOptions(**options)).orderBy("hit").collect()
    return [(r["line"], r["column"]) for r in rows]


def test_fold_keeps_length_and_matches_the_column(spark):
    source, target = fold_table()
    assert len(source) == len(target) == len(set(source))
    rows = spark.createDataFrame([(source,)], "t string").select(fold(F.col("t"))).first()
    assert rows[0] == target == fold_text(source)


def test_lines_columns_and_context(spark):
    text = "l1 alpha\nl2 needle mid\nl3\nl4 needle2 needle\nl5 tail"
    assert hits(spark, text, "needle") == [(2, 4), (4, 4), (4, 12)]
    first = S.search(index(spark, [text]), "needle").orderBy("hit").first()
    assert first["context_before"] == ["l1 alpha"] and first["context_after"] == ["l3", "l4 needle2 needle"]
    assert hits(spark, "日本語 needle", "needle") == [(1, 5)]
    crlf = S.search(index(spark, ["a\r\nneedle\r\nb\r\n"]), "needle").first()
    assert (crlf["line_text"], crlf["context_before"], crlf["context_after"]) == ("needle", ["a"], ["b", ""])


def test_case_words_and_overlaps(spark):
    assert len(hits(spark, "MiXeD needle NEEDLE content", "needle")) == 2
    assert len(hits(spark, "MiXeD needle NEEDLE content", "needle", case_sensitive=True)) == 1
    assert len(hits(spark, "needle needless needle. needle2", "needle", whole_word=True)) == 2
    # Non-overlapping first, whole words after: the second "a a" is never a match.
    assert hits(spark, "xa a a", "a a", whole_word=True) == []
    assert hits(spark, "aaaa", "aaa") == [(1, 1)]


@pytest.mark.parametrize("query", ["", "ab", "日", "é "])
def test_short_queries_are_refused(query):
    with pytest.raises(QueryTooShort):
        validate_query(query)


def test_blank_and_wide_queries_are_accepted():
    assert validate_query("   ") and validate_query("日本語")


def test_masks():
    assert parse_masks(" report,*.csv ;; *.a\n?b") == ["report,*.csv", "*.a", "?b"]
    assert wildcard_text("*.JAVA", "foo.java") and not wildcard_text("*.java", "Foo.java~")
    assert NameMasks.of("*.txt", "b*").accepts_text("a.TXT") and not NameMasks.of("*.txt", "b*").accepts_text("b.txt")


def test_too_large_documents(spark):
    texts = ["head needle " + "x" * 180 + " tail-needle", "needle here"]
    df = index(spark, texts, max_size=64)
    deep = S.SearchOptions(analyze_oversized=True)
    assert {(r["doc_id"], r["column"]) for r in S.search(df, "needle", deep, cap=64).collect()} == {(0, 6), (1, 1)}
    assert [r["doc_id"] for r in S.search(df, "needle").collect()] == [1]
    c = S.counters(df, "needle", deep, cap=64).first()
    assert (c["from_index"], c["too_large"], c["truncated"]) == (1, 1, 1)
    events = list(S.search_events(df, "needle", deep, cap=64))
    assert isinstance(events[0], S.IndexedDone) and (events[1].done, events[1].total) == (1, 1)


def test_capped_reading_drops_a_broken_character(spark):
    df = index(spark, ["é" * 10 + "needle"], max_size=4)
    assert S.verified(S.candidates(df, "éée"), "éée", S.SearchOptions(analyze_oversized=True), cap=7).first()["content"] == "ééé"


def test_cancel_gives_no_partial_report(spark):
    events = S.search_events(index(spark, ["needle"]), "needle", cancelled=iter([False, True, True]).__next__)
    assert isinstance(next(events), S.IndexedDone)
    with pytest.raises(S.Cancelled):
        next(events)


def test_random_substrings_are_found_by_scan_and_postings(spark):
    rng = random.Random(0x5EED)
    texts = ["".join(("\n" if rng.random() < 1 / 3 else "") + rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    df = index(spark, texts).cache()
    table = postings.postings(df).cache()
    wanted = set()
    for i, t in enumerate(texts):
        for _ in range(2):
            if len(t) >= 3:
                a = rng.randrange(len(t) - 2)
                wanted.add((i, t[a : a + rng.randint(3, 6)]))
    for i, needle in sorted(wanted)[:20]:
        assert i in {r["doc_id"] for r in S.search(df, needle, S.SearchOptions(case_sensitive=True)).collect()}, (texts[i], needle)
        assert i in {r["doc_id"] for r in postings.posting_candidates(table, needle).collect()}
        expected = sorted((d, n) for d, t in enumerate(texts) if (n := fold_text(t).count(fold_text(needle))))
        got = S.file_results(S.verified(S.candidates(df, needle), needle)).collect()
        assert sorted((r["doc_id"], r["occurrences"]) for r in got) == expected


def test_view_order(spark):
    rows = [(i, p, None, 1, 10, m) for i, (p, m) in enumerate([("a/b", 5), ("a-b/c", None), ("d/.gitignore", 7), ("d/noext", 1), ("d/a.asp", 2), ("d/b.ASP", 3), ("d/a.txt", 4)])]
    df = spark.createDataFrame(rows, "doc_id long, file_path string, entry_path string, occurrences long, size long, mtime long")
    order = lambda **k: [r["file_path"] for r in view(df, ViewSpec(**k)).collect()]
    assert order()[:2] == ["a/b", "a-b/c"]
    assert order(sort="modified")[-1] == order(sort="modified", descending=True)[-1] == "a-b/c"
    assert [p for p in order(sort="extension") if p.startswith("d/")] == ["d/.gitignore", "d/noext", "d/a.asp", "d/b.ASP", "d/a.txt"]
    with pytest.raises(InvalidFilter):
        view_masks("a/*")


def test_viewer_columns(spark):
    line = "x" * 50 + "needle" + "日" * 50
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    shown = one(around_match(F.lit(line), F.lit(50), F.lit(6), 5, 20))
    assert [p["text"] for p in shown] == ["…", "xxxxx", "needle", "日日日日日", "…"] and shown[2]["hit"]
    assert one(word_at(F.lit("ab c_d 日x"), F.lit(4))) == "c_d" and one(word_at(F.lit("ab c"), F.lit(2))) is None
    assert one(word_at(F.lit("ab 日x"), F.lit(4))) == "日x" and one(word_at(F.lit("ab"), F.lit(9))) is None
    assert one(wrapped(F.lit("aa bb cc dd ee"), 8)) == ["aa bb ", "cc "] and one(wrapped(F.lit("abc"), 8)) == ["abc"]
    assert one(bounded(F.lit(b"ab\ncdef"), 5)).asDict() == {"data": bytearray(b"ab\n"), "truncated": True}
    assert one(bounded(F.lit(b"ab"), 5))["truncated"] is False


def test_viewer_table(spark):
    docs = spark.createDataFrame([(1, "needle a\nb\nc needle\r\n"), (2, "x" * 4000 + "Needle" + "y" * 4000), (3, "")], "doc_id long, content string")
    lines = viewed(docs, LiteralMatcher("needle"), 2, 1)
    rows = {(r["doc_id"], r["line"]): r for r in lines.collect()}
    assert sorted(rows) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert [rows[1, n]["matches"] for n in (1, 2, 3)] == [[1], [], [3]] and rows[2, 1]["matches"] == [4001]
    assert [p["text"] for p in rows[1, 3]["shown"]] == ["c ", "needle"]
    assert [p["text"][:3] for p in rows[2, 1]["shown"]] == ["…", "xxx", "Nee", "yyy", "…"] and sum(len(p["text"]) for p in rows[2, 1]["shown"]) == 1502
    assert {r["doc_id"]: (r["matches"], r["focus"]) for r in focus(lines, 2, 1).collect()} == {1: (2, 1), 2: (1, 0)}


def test_matching_takes_linear_time(spark):
    text = "\n".join("needle in it" if i % 4 == 0 else "nothing" for i in range(400_000))
    df = index(spark, [text])
    began = time.monotonic()
    found = S.search(df, "needle").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last")).first()
    assert tuple(found) == (100_000, 399_997) and time.monotonic() - began < 60
    # A long line is written once for each match in it, in batches that stay small.
    assert S.search(index(spark, ["needle " * 2000]), "needle").count() == 2000
