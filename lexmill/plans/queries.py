"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.display import detail_line, ellipsize, readable_bytes, readable_duration, readable_time, seconds_of, size_mib
from lexmill.functions.encoding import bom, decode_utf8, decode_windows1252, sniffed
from lexmill.functions.fold import fold
from lexmill.functions.masks import NameMasks, leaf, wildcard_match
from lexmill.functions.matching import LiteralMatcher, find, segments
from lexmill.functions.paths import extension, path_key
from lexmill.operators import merge, postings, report, update
from lexmill.operators import search as S
from lexmill.operators.view import SORT_KEYS, ViewSpec, export_lines, ranked
from lexmill.plans.build import rebuild_index, update_index
from lexmill.plans.options import BuildOptions, RootSpec
from lexmill.plans.shared import settle, settled_path
from lexmill.plans.snapshot import Index
from lexmill.sources import corpus
from lexmill.sources.corpus import MAX_FILE_SIZE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A size limit that makes some documents of the tables too large.
SMALL = 4096


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- the corpora in SQL ----

_TIME = "CASE WHEN {k} % 10 <> 9 THEN 1700000000000000000 + {k} * 61000000007 END"


def _docs(cap: int = MAX_FILE_SIZE) -> str:
    return f"""SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, CAST(NULL AS VARCHAR) AS entry_path,
      'txt' AS ext, strlen(text) AS size, {_TIME.format(k="doc_id")} AS mtime_ns,
      CASE WHEN strlen(text) > {cap} THEN 2 ELSE 0 END AS status, text AS content, lower(text) AS folded FROM documents"""


def _conv() -> str:
    return f"""SELECT conv_id * 1000 + turn AS doc_id, 'conv/' || CAST(conv_id AS VARCHAR) || '.zip' AS file_path,
      role || '/' || CAST(turn AS VARCHAR) || '.txt' AS entry_path, 'txt' AS ext, strlen(text) AS size, {_TIME.format(k="conv_id")} AS mtime_ns,
      0 AS status, text AS content, lower(text) AS folded FROM conversations"""


def _bench() -> str:
    return f"""SELECT item_id AS doc_id, 'bench/' || CAST(item_id AS VARCHAR) || '.md' AS file_path, CAST(NULL AS VARCHAR) AS entry_path,
      'md' AS ext, strlen(text) AS size, {_TIME.format(k="item_id")} AS mtime_ns, 0 AS status, text AS content, lower(text) AS folded FROM benchmark"""


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _starts(source: str, needle: str, case: bool = False, word: bool = False, where: str = "status = 0") -> str:
    """SQL of one row per match: the document's columns, ``pos`` and ``hit``."""
    hay, n = ("content", _lit(needle)) if case else ("folded", _lit(needle.lower()))
    wide = len(needle)
    found = f"""SELECT *, length(array_to_string(parts[1:i], '')) + (i - 1) * {wide} AS pos FROM (
        SELECT *, unnest(range(1, len(parts))) AS i FROM (
          SELECT *, string_split({hay}, {n}) AS parts FROM ({source}) AS src WHERE {where} AND contains({hay}, {n})) AS a) AS b"""
    if word:
        word_char = r"'[\p{L}\p{N}_]'"
        found = f"""SELECT * FROM ({found}) AS c
        WHERE NOT regexp_matches(CASE WHEN pos > 0 THEN substr(content, pos, 1) ELSE '' END, {word_char})
          AND NOT regexp_matches(substr(content, pos + {wide + 1}, 1), {word_char})"""
    return f"SELECT *, row_number() OVER (PARTITION BY doc_id, file_path ORDER BY pos) - 1 AS hit FROM ({found}) AS d"


def _occurrences(source: str, needle: str, case: bool = False, word: bool = False, context: int = 2, where: str = "status = 0") -> str:
    strip = lambda x: f"regexp_replace({x}, '[\\r\\n]+$', '')"
    return f"""SELECT doc_id, file_path, CAST(hit AS BIGINT) AS hit, CAST(line AS BIGINT) AS line,
      CAST(pos - (CASE WHEN line > 1 THEN length(array_to_string(lines[1:line - 1], chr(10))) + 1 ELSE 0 END) + 1 AS BIGINT) AS col,
      {strip("lines[line]")} AS line_text,
      array_to_string(lines[greatest(line - {context}, 1):line - 1], chr(10)) AS before_text,
      array_to_string(lines[line + 1:line + {context}], chr(10)) AS after_text
    FROM (SELECT *, string_split(content, chr(10)) AS lines,
            length(substr(content, 1, pos)) - length(replace(substr(content, 1, pos), chr(10), '')) + 1 AS line
          FROM ({_starts(source, needle, case, word, where)}) AS e) AS f"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "file_path", "hit", "line", F.col("column").alias("col"), "line_text", F.array_join("context_before", "\n").alias("before_text"), F.array_join("context_after", "\n").alias("after_text"))


def _search(needle: str, **options: object) -> Query:
    return lambda spark, d: _shown(S.search(corpus.documents(spark, d), needle, S.SearchOptions(**options)))


for _name, _needle, _kw in (
    ("search_literal_ci", "thatin", {}),
    ("search_literal_cs", "That", {"case": True}),
    ("search_whole_word", "that", {"word": True}),
    ("search_accented", "éauxi", {}),
    ("search_multiline", ".\nThe ", {"case": True}),
    ("search_absent", "zqxjkv", {}),
    ("search_min3", "ewh", {}),
    ("search_context_lines_0", "thatin", {"context": 0}),
    ("search_context_lines_2", "hating", {"context": 2}),
):
    _options = {"case_sensitive": _kw.get("case", False), "whole_word": _kw.get("word", False), "context_lines": _kw.get("context", 2)}
    _register(_name, _search(_needle, **_options), _occurrences(_docs(), _needle, **_kw))


# ---- masks ----

_LEAF = "regexp_extract(file_path, '[^/]*$')"
_ENTRY_LEAF = "regexp_extract(entry_path, '[^/]*$')"


def _hits_in(masks: NameMasks, make=corpus.documents, needle: str = "tion") -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        options = S.SearchOptions(masks=masks)
        return S.file_results(S.verified(S.candidates(make(spark, d), needle, options), needle, options)).select("doc_id", "file_path", "occurrences")

    return query


def _hits_sql(source: str, where: str, needle: str = "tion") -> str:
    return f"SELECT doc_id, file_path, CAST(count(*) AS BIGINT) AS occurrences FROM ({_starts(source, needle, where=where)}) AS x GROUP BY doc_id, file_path"


_register("search_include_masks", _hits_in(NameMasks.of("*7.txt; 1?.TXT")), _hits_sql(_docs(), f"(lower({_LEAF}) LIKE '%7.txt' OR lower({_LEAF}) LIKE '1_.txt')"))
_register("search_exclude_masks", _hits_in(NameMasks.of("", "*7.txt\n?.txt")), _hits_sql(_docs(), f"NOT (lower({_LEAF}) LIKE '%7.txt' OR lower({_LEAF}) LIKE '_.txt')"))
_register("search_masks_exclusion_wins", _hits_in(NameMasks.of("*7.txt", "?7.txt")), _hits_sql(_docs(), f"lower({_LEAF}) LIKE '%7.txt' AND NOT lower({_LEAF}) LIKE '_7.txt'"))
_register(
    "search_entry_masks_container_exclude",
    _hits_in(NameMasks.of("?.txt", "*3.zip;0.txt"), corpus.conversations),
    _hits_sql(_conv(), f"lower({_ENTRY_LEAF}) LIKE '_.txt' AND NOT lower({_ENTRY_LEAF}) LIKE '%3.zip' AND NOT lower({_ENTRY_LEAF}) LIKE '0.txt' AND NOT lower({_LEAF}) LIKE '%3.zip' AND NOT lower({_LEAF}) LIKE '0.txt'"),
)

# ---- candidates, counters, phases ----

_register(
    "search_candidates",
    lambda spark, d: S.candidates(corpus.documents(spark, d), "THATIN").select("doc_id", "file_path", "size", "status"),
    f"SELECT doc_id, file_path, CAST(size AS BIGINT) AS size, status FROM ({_docs()}) AS x WHERE contains(folded, 'thatin')",
)
_register(
    "search_candidates_with_too_large",
    lambda spark, d: S.candidates(corpus.documents(spark, d, SMALL), "thatin").select("doc_id", "file_path", "size", "status"),
    f"SELECT doc_id, file_path, CAST(size AS BIGINT) AS size, status FROM ({_docs(SMALL)}) AS x WHERE status = 2 OR contains(folded, 'thatin')",
)
_register(
    "search_counters",
    lambda spark, d: S.counters(corpus.documents(spark, d, SMALL).unionByName(corpus.conversations(spark, d)), "tion", S.SearchOptions(masks=NameMasks.of("*.txt", "*9.txt"), analyze_oversized=True), cap=2 * SMALL),
    f"""SELECT CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS from_index, CAST(count(*) FILTER (WHERE status = 2) AS BIGINT) AS too_large,
      CAST(0 AS BIGINT) AS index_errors, CAST(0 AS BIGINT) AS security_limits, CAST(count(*) FILTER (WHERE status = 2 AND size > {2 * SMALL}) AS BIGINT) AS truncated,
      CAST(count(DISTINCT CASE WHEN hit AND entry_path IS NOT NULL THEN file_path END) AS BIGINT) AS archives_opened
    FROM (SELECT *, status = 0 AND contains(folded, 'tion') AS hit FROM (SELECT * FROM ({_docs(SMALL)}) AS a UNION ALL SELECT * FROM ({_conv()}) AS b) AS c
      WHERE CASE WHEN entry_path IS NULL THEN lower({_LEAF}) LIKE '%.txt' AND NOT lower({_LEAF}) LIKE '%9.txt'
            ELSE lower({_ENTRY_LEAF}) LIKE '%.txt' AND NOT lower({_ENTRY_LEAF}) LIKE '%9.txt' AND NOT lower({_LEAF}) LIKE '%9.txt' END) AS e""",
)
_BYTES_OF = "encode(content)[1:{n}]"
_CUT = f"CASE WHEN strlen(content) <= {SMALL} THEN content ELSE coalesce({', '.join(f'try(decode({_BYTES_OF.format(n=SMALL - n)}))' for n in range(4))}) END"
_register(
    "search_oversized_phase",
    lambda spark, d: _shown(S.search(corpus.documents(spark, d, SMALL), "thatin", S.SearchOptions(analyze_oversized=True), cap=SMALL)),
    _occurrences(f"SELECT doc_id, file_path, content, lower(content) AS folded, 0 AS status FROM (SELECT doc_id, file_path, {_CUT} AS content FROM ({_docs(SMALL)}) AS o) AS c", "thatin"),
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    return S.file_results(S.verified(S.candidates(corpus.documents(spark, d), "tion"), "tion"))


_RESULTS = f"""SELECT doc_id, file_path, CAST(count(*) AS BIGINT) AS occurrences, CAST(max(size) AS BIGINT) AS size,
  CAST(max(CASE WHEN doc_id % 10 <> 9 THEN (1700000000000000000 + doc_id * 61000000007 - (doc_id * 61000000007) % 1000000000) // 1000000000 END) AS BIGINT) AS mtime
FROM ({_starts(_docs(), "tion")}) AS x GROUP BY doc_id, file_path"""
_register("search_file_results", _results, f"SELECT doc_id, file_path, CAST(NULL AS VARCHAR) AS entry_path, occurrences, size, mtime FROM ({_RESULTS}) AS r")

_register(
    "iter_documents_status",
    lambda spark, d: S.list_documents(corpus.documents(spark, d, SMALL), (2,)).select("doc_id", "file_path", "size", "mtime_ns", "status"),
    f"SELECT doc_id, file_path, CAST(size AS BIGINT) AS size, CAST(mtime_ns AS BIGINT) AS mtime_ns, status FROM ({_docs(SMALL)}) AS x WHERE status = 2",
)
_register(
    "documents_build",
    lambda spark, d: corpus.documents(spark, d, SMALL).select("doc_id", "file_path", "ext", "size", "mtime_ns", "status", "content_fold"),
    f"SELECT doc_id, file_path, ext, CAST(size AS BIGINT) AS size, CAST(mtime_ns AS BIGINT) AS mtime_ns, status, CASE WHEN status = 0 THEN folded END AS content_fold FROM ({_docs(SMALL)}) AS x",
)

# ---- postings ----

_GRAMS = f"SELECT DISTINCT doc_id, substr(folded, i, 3) AS gram FROM (SELECT doc_id, folded, unnest(range(1, length(folded) - 1)) AS i FROM ({_docs()}) AS x) AS y"
_register(
    "trigram_postings_topk",
    lambda spark, d: postings.postings(corpus.documents(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(50),
    f"SELECT gram, CAST(count(*) AS BIGINT) AS n FROM ({_GRAMS}) AS g GROUP BY gram ORDER BY n DESC, gram LIMIT 50",
)
_register(
    "trigram_candidates",
    lambda spark, d: postings.posting_candidates(postings.postings(corpus.documents(spark, d), postings.query_grams("Thatin")), "Thatin"),
    f"SELECT doc_id FROM ({_docs()}) AS x WHERE contains(folded, 'tha') AND contains(folded, 'hat') AND contains(folded, 'ati') AND contains(folded, 'tin')",
)


def _equivalence(spark: SparkSession, d: str) -> DataFrame:
    index = corpus.documents(spark, d)
    by_scan = S.candidates(index, "thatin").select("doc_id")
    by_postings = S.candidates(postings.narrowed(index, postings.postings(index, postings.query_grams("thatin")), "thatin"), "thatin").select("doc_id")
    both = by_scan.withColumn("s", F.lit(1)).join(by_postings.withColumn("p", F.lit(1)), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("s").isNull() | F.col("p").isNull()).alias("different"), F.count(F.lit(1)).alias("candidates"))


_register("trigram_vs_scan_equivalence", _equivalence, f"SELECT CAST(0 AS BIGINT) AS different, CAST(count(*) AS BIGINT) AS candidates FROM ({_docs()}) AS x WHERE contains(folded, 'thatin')")

# ---- reports ----

_ALL_EXT = f"SELECT ext, status FROM ({_docs(SMALL)}) AS a UNION ALL SELECT ext, status FROM ({_conv()}) AS b UNION ALL SELECT ext, status FROM ({_bench()}) AS c UNION ALL SELECT 'html' AS ext, 0 AS status FROM pages"


def _everything(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(spark, d, SMALL).unionByName(corpus.conversations(spark, d)).unionByName(corpus.benchmark(spark, d)).unionByName(corpus.pages(spark, d))


_register("ext_top5", lambda spark, d: report.top_extensions(_everything(spark, d)), f"SELECT ext, CAST(count(*) AS BIGINT) AS n FROM ({_ALL_EXT}) AS x WHERE status = 0 GROUP BY ext ORDER BY n DESC, ext LIMIT 5")


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """What became of each event, taken as a file: a stand-in for a walked tree."""
    events = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 11
    fate = F.when(k == 0, "ignored_name").when(k == 1, "ignored_sniff").when(k == 2, "too_large").when(k == 3, "error").when(k == 4, "pruned_dir").when(k == 5, "security").otherwise("indexed")
    entry = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return events.select(
        fate.alias("fate"), F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("file_path"), entry.alias("entry_path"), F.col("event_type").alias("name"),
        F.octet_length("props").cast("long").alias("read"), (F.col("event_id") % 13 == 6).alias("fallback"), F.col("props").alias("content"),
    )


def _count(where: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {where}) AS BIGINT)"


_register(
    "build_counters",
    lambda spark, d: report.build_counters(_staged(spark, d)),
    f"""SELECT {_count("NOT e AND k <> 4")} AS files_seen, {_count("k IN (0, 1)")} AS files_ignored, {_count("k = 0 AND NOT e")} AS files_ignored_by_name,
      {_count("k = 1 AND NOT e")} AS files_ignored_by_sniff, {_count("k = 4")} AS directories_excluded, {_count("k > 5")} AS files_indexed, {_count("k = 2")} AS files_too_large,
      {_count("k = 5")} AS files_security_limited, {_count("k = 3")} AS errors, {_count("event_id % 13 = 6")} AS fallback_decodes, CAST(0 AS BIGINT) AS archives,
      {_count("k > 5 AND e")} AS archive_entries_indexed, {_count("k = 0 AND e")} AS archive_entries_skipped_by_name, {_count("k = 1 AND e")} AS archive_entries_ignored_by_sniff,
      {_count("k = 3 AND e")} AS archive_entries_errored, {_count("k = 5 AND e")} AS archive_entries_security_limited,
      CAST(sum(CASE WHEN e THEN n ELSE 0 END) AS BIGINT) AS archive_bytes_decompressed, CAST(sum(n) AS BIGINT) AS bytes_read, CAST(sum(CASE WHEN k > 5 THEN n ELSE 0 END) AS BIGINT) AS bytes_indexed
    FROM (SELECT event_id, event_id % 11 AS k, event_id % 3 = 0 AS e, strlen(props) AS n FROM events) AS x""",
)
_register("pruned_dirs_count", lambda spark, d: report.pruned_directories(_staged(spark, d)), "SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 11 = 4 GROUP BY event_type")

# ---- update ----

_SPLIT = "2024-01-16"


def _listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of one tree: a path per user and kind of event, before and after a day."""
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("file_path", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type"))
    state = lambda rows: rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("size"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("mtime_ns"))
    early = state(events.where(F.col("ts").cast("timestamp") < F.lit(_SPLIT).cast("timestamp")))
    # Paths whose last event came early are as they were, unless their user's id says that they are gone.
    late = state(events).where(~F.col("file_path").rlike("^u[0-9]*7/"))
    old = early.select(F.monotonically_increasing_id().alias("doc_id"), "file_path", F.lit(None).cast("string").alias("entry_path"), "size", "mtime_ns")
    return late.withColumn("kind", F.lit("file")), old


_STATES = f"""WITH ev AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '/' || event_type AS file_path, ts, user_id FROM events),
old AS (SELECT file_path, count(*) AS size, max(ts) AS mtime FROM ev WHERE ts < TIMESTAMP '{_SPLIT}' GROUP BY file_path),
new AS (SELECT file_path, count(*) AS size, max(ts) AS mtime FROM ev WHERE user_id % 10 <> 7 GROUP BY file_path),
fates AS (SELECT coalesce(new.file_path, old.file_path) AS file_path,
  CASE WHEN new.file_path IS NULL THEN 'deleted' WHEN old.file_path IS NULL THEN 'added'
       WHEN new.size = old.size AND new.mtime = old.mtime THEN 'unchanged' ELSE 'modified' END AS fate
  FROM new FULL OUTER JOIN old ON new.file_path = old.file_path)"""
_register("update_diff_classes", lambda spark, d: update.diff(*_listings(spark, d)), f"{_STATES} SELECT file_path, fate FROM fates")
_register(
    "update_delta",
    lambda spark, d: update.delta(update.diff(*_listings(spark, d))),
    f"{_STATES} SELECT {_count("fate = 'added'")} AS added, {_count("fate = 'deleted'")} AS removed, {_count("fate = 'modified'")} AS updated, {_count("fate = 'unchanged'")} AS unchanged FROM fates",
)


def _updated(spark: SparkSession, d: str) -> DataFrame:
    new, old = _listings(spark, d)
    fates = update.diff(new, old)
    fresh = new.join(fates.where(F.col("fate").isin("added", "modified")), "file_path", "left_semi")
    return update.kept_rows(old, fates).select("file_path", "size").unionByName(fresh.select("file_path", "size"))


_register("update_snapshot_rows", _updated, f"{_STATES} SELECT file_path, CAST(size AS BIGINT) AS size FROM new")

# ---- indexes of real trees ----


def _tree(rows: DataFrame, folder: str) -> None:
    """Write each row (name, text) as a file; the folder is one that executors and driver share."""

    def run(frames):
        for frame in frames:
            for name, text in zip(frame["name"], frame["text"], strict=True):
                with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield frame[["name"]]

    rows.select("name", "text").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def _tree_folder(spark: SparkSession) -> str:
    """A new folder for files; listing and reading need a path of the file system, the same on all machines."""
    path = settled_path(spark, "tree")
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path} is no path of the file system")
    folder = urlparse(path).path
    os.makedirs(folder)
    return folder


def _indexed_tree(spark: SparkSession, index: str) -> DataFrame:
    rows = Index(spark, index).rows()
    return rows.select(F.regexp_extract("file_path", "[^/]*$", 0).alias("name"), "ext", "size", "status", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")


def _built(spark: SparkSession, d: str) -> DataFrame:
    folder = _tree_folder(spark)
    _tree(_named(spark, d), folder)
    rebuild_index(spark, f"{folder}-index", BuildOptions((RootSpec(folder),)))
    return _indexed_tree(spark, f"{folder}-index")


_register(
    "index_build_real",
    _built,
    "SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, 'txt' AS ext, strlen(text) AS size, 0 AS status, md5(text) AS content_md5 FROM documents",
)


def _brought_up_to_date(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents are built; then some files change, some go, the rest comes, and an update follows."""
    folder, docs = _tree_folder(spark), _named(spark, d)
    options = BuildOptions((RootSpec(folder),))
    _tree(docs.where("doc_id % 3 <> 2"), folder)
    rebuild_index(spark, f"{folder}-index", options)
    _tree(docs.where("doc_id % 3 = 2"), folder)
    _tree(docs.where("doc_id % 5 = 1").withColumn("text", F.concat("text", F.lit(" changed"))), folder)
    for name in sorted(os.listdir(folder)):
        if int(name.removesuffix(".txt")) % 7 == 0:
            os.remove(f"{folder}/{name}")
    update_index(spark, f"{folder}-index", options)
    return _indexed_tree(spark, f"{folder}-index")


_register(
    "index_update_equals_rebuild",
    _brought_up_to_date,
    """SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, 'txt' AS ext, strlen(body) AS size, 0 AS status, md5(body) AS content_md5
    FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 1 THEN ' changed' ELSE '' END AS body FROM documents WHERE doc_id % 7 <> 0) AS x""",
)

# ---- several indexes ----


def _targets(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Three projects over the documents; they overlap, and one spells paths another way."""
    rows = settle(_results(spark, d).select("doc_id", "file_path", "entry_path", "occurrences", "size"), "results")
    second = rows.where("doc_id % 3 = 1").withColumn("file_path", F.upper(F.replace("file_path", F.lit("/"), F.lit("\\"))))
    return [("b", rows.where("doc_id % 2 = 0")), ("a", second), ("c", rows)]


_register(
    "merge_projects_first_wins",
    lambda spark, d: merge.first_wins(merge.tagged(_targets(spark, d))).select("project_id", "doc_id", "file_path", "occurrences"),
    f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'b' WHEN doc_id % 3 = 1 THEN 'a' ELSE 'c' END AS project_id, doc_id,
      CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 1 THEN upper(replace(file_path, '/', chr(92))) ELSE file_path END AS file_path, occurrences FROM ({_RESULTS}) AS r""",
)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    index = corpus.documents(spark, d, SMALL)
    parts = [("b", S.counters(index.where("doc_id % 2 = 0"), "tion")), ("a", S.counters(index.where("doc_id % 3 = 1"), "tion"))]
    return merge.merged_counters(merge.tagged(parts))


_register(
    "merge_counters",
    _counted,
    f"""SELECT CAST(sum(w * CASE WHEN status = 0 AND contains(folded, 'tion') THEN 1 ELSE 0 END) AS BIGINT) AS from_index, CAST(sum(w * CASE WHEN status = 2 THEN 1 ELSE 0 END) AS BIGINT) AS too_large,
      CAST(0 AS BIGINT) AS index_errors, CAST(0 AS BIGINT) AS security_limits, CAST(0 AS BIGINT) AS truncated, CAST(0 AS BIGINT) AS archives_opened
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS w FROM ({_docs(SMALL)}) AS a) AS x""",
)

# ---- the view ----

_ORDER = {
    "path": "", "name": f"lower({_LEAF}) {{dir}}, ", "modified": "CASE WHEN mtime IS NULL THEN 1 ELSE 0 END, mtime {dir}, ", "occurrences": "occurrences {dir}, ",
    "size": "size {dir}, ", "extension": f"'txt' {{dir}}, lower({_LEAF}) {{dir}}, ",
}
for _key in SORT_KEYS:
    _down = _key in ("modified", "occurrences", "size")
    _dir = "DESC" if _down else "ASC"
    _by = f"{_ORDER[_key]}string_split(file_path, '/') {{dir}}".format(dir=_dir)
    _register(
        f"view_sort_{_key}",
        lambda spark, d, k=_key, down=_down: ranked(_results(spark, d), ViewSpec(sort=k, descending=down)).select("place", "doc_id", "file_path"),
        f"SELECT CAST(row_number() OVER (ORDER BY {_by}) AS BIGINT) AS place, doc_id, file_path FROM ({_RESULTS}) AS r",
    )
_register(
    "view_filter_mask",
    lambda spark, d: ranked(_results(spark, d), ViewSpec("*5?.txt;1*.TXT", "path")).select("place", "doc_id", "file_path"),
    f"SELECT CAST(row_number() OVER (ORDER BY string_split(file_path, '/')) AS BIGINT) AS place, doc_id, file_path FROM ({_RESULTS}) AS r WHERE lower({_LEAF}) LIKE '%5_.txt' OR lower({_LEAF}) LIKE '1%.txt'",
)
_BYTES = "CASE WHEN {n} >= 1048576 THEN printf('%.1f MiB', {n} / 1048576.0) WHEN {n} >= 1024 THEN printf('%.1f KiB', {n} / 1024.0) ELSE CAST({n} AS VARCHAR) || ' B' END"
_register(
    "view_detail_line",
    lambda spark, d: _results(spark, d).select("doc_id", detail_line(F.col("file_path"), F.col("entry_path"), F.col("occurrences"), F.col("size"), F.col("mtime")).alias("detail")),
    f"""SELECT doc_id, {_LEAF} || ' [' || CAST(occurrences AS VARCHAR) || '] - ' || {_BYTES.format(n="size")} || ' - ' ||
      coalesce(strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M'), '—') || ' - ' || regexp_extract(file_path, '^(.*/)[^/]*$', 1) AS detail FROM ({_RESULTS}) AS r""",
)
_register(
    "export_lines",
    lambda spark, d: export_lines(S.search(corpus.documents(spark, d), "thatin")),
    f"SELECT doc_id, file_path || ':' || CAST(line AS VARCHAR) || ':' || CAST(col AS VARCHAR) || ': ' || rtrim(line_text) AS export_line FROM ({_occurrences(_docs(), 'thatin')}) AS o",
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.documents(spark, d).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    cut = lines.withColumn("s", segments(F.col("text"), find(fold(F.col("text")), "the"), 3))
    shown = F.transform("s", lambda x: F.concat(F.when(x["hit"], F.lit("[")).otherwise(F.lit("")), x["text"], F.when(x["hit"], F.lit("]")).otherwise(F.lit(""))))
    return cut.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join(shown, "").alias("marked"), F.size("s").cast("long").alias("pieces"))


_register("highlight_segments", _segments, None)
SQL["highlight_segments"] = """SELECT doc_id, CAST(pos - 1 AS BIGINT) AS line, regexp_replace(replace(text, chr(9), '    '), '([tT][hH][eE])', '[\\1]', 'g') AS marked,
  CAST(len(parts) - 1 + len(list_filter(parts, lambda p: p <> '')) AS BIGINT) AS pieces
FROM (SELECT doc_id, pos, lines[pos] AS text, string_split(lower(lines[pos]), 'the') AS parts FROM (
  SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents) AS a) AS b"""

# ---- literal rows ----


def _rows(names: str, rows: list[tuple], expected: list) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """A small table, and SQL that gives its id and the expected value of each row."""
    make = lambda spark: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {names}")
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else _lit(x)
    return make, " UNION ALL ".join(f"SELECT {i} AS id, {show(e)} AS value" for i, e in enumerate(expected))


def _literal(name: str, names: str, rows: list[tuple], expected: list, value: Callable[[], Column], computed: str | None = None) -> None:
    """``computed``: what SQL makes of the columns; without it SQL states what is expected."""
    make, sql = _rows(names, rows, expected)
    if computed:
        show = lambda x: "NULL" if x is None else _lit(x) if isinstance(x, str) else str(x)
        values = ", ".join(f"({i}, {', '.join(map(show, r))})" for i, r in enumerate(rows))
        sql = f"SELECT id, {computed} AS value FROM (VALUES {values}) AS t(id, {', '.join(n.split()[0] for n in names.split(', '))})"
    _register(name, lambda spark, d: make(spark).select("id", value().alias("value")), sql)


_literal(
    "fold_table_cases", "hay string, needle string",
    [("ÉTÉ", "été"), ("ΧΑΟΣ", "χαος"), ("congreſs", "CONGRESS"), ("ΧΑΟΣ", "χάος"), ("ß", "ss"), ("İSTANBUL", "istanbul"), ("ﬁle", "file"), ("MiXeD", "mIxEd"), ("µ", "Μ")],
    [True, True, True, False, False, False, False, True, True],
    lambda: fold(F.col("hay")) == fold(F.col("needle")),
)
_WILD = [("*.java", "Foo.java", True), ("*.java", "Foo.java~", False), ("foo?.java", "foo..java", True), ("foo?.java", "foo.java", False), ("a+b.TXT", "A+B.txt", True), ("x.y", "xay", False), ("*", "", True), ("r*t*.c_v", "REPORT.C_V", True), ("a\\E?", "a\\Ex", True), ("?", "日", True)]
_register(
    "wildcard_cases",
    lambda spark, d: spark.createDataFrame([(i, m, n) for i, (m, n, _) in enumerate(_WILD)], "id int, mask string, name string").select("id", _any_mask(F.col("mask"), F.col("name")).alias("value")),
    f"""SELECT id, name ILIKE replace(replace(replace(replace(replace(mask, '!', '!!'), '_', '!_'), '%', '!%'), '*', '%'), '?', '_') ESCAPE '!' AS value
    FROM (VALUES {", ".join(f"({i}, {_lit(m)}, {_lit(n)})" for i, (m, n, _) in enumerate(_WILD))}) AS t(id, mask, name)""",
)


def _any_mask(mask: Column, name: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for m, _, _ in _WILD:
        out = F.when(mask == m, wildcard_match(m, name)).otherwise(out)
    return out


_literal(
    "path_key_cases", "path string",
    [("C:/Dir/",), ("c:\\dir",), ("\\\\?\\C:\\Dir\\\\",), ("\\\\?\\UNC\\Srv\\Share",), ("c:\\",), ("/A/b",), ("",)],
    ["c:\\dir", "c:\\dir", "c:\\dir", "\\\\srv\\share", "c:\\", "\\a\\b", ""],
    lambda: path_key(F.col("path")),
    computed=r"""(SELECT lower(substr(plain, 1, 3) || regexp_replace(substr(plain, 4), '\\+$', '')) FROM (SELECT
      regexp_replace(regexp_replace(replace(path, '/', chr(92)), '^\\\\\?\\UNC\\', '\\\\'), '^\\\\\?\\', '') AS plain) AS p)""",
)
_literal(
    "sniff_classify", "data binary",
    [(b"plain text",), (b"",), (b"\xef\xbb\xbfa",), (b"\xff\xfea\0",), (b"\xff\xfe\0\0a\0\0\0",), (b"PK\x03\x04rest",), (b"PK\x01\x02",), (b"a\0b",), (b"\x01" + b"a" * 9,), (b"\x01\x02" + b"a" * 9,), (b"\x7f\x7f" + b"a" * 8,), (b"\t\n\r\x0b\x0c",)],
    ["none text", "none text", "utf8 text", "utf16le text", "utf32le text", "none archive", "none binary", "none binary", "none text", "none binary", "none binary", "none text"],
    lambda: F.concat(bom(F.col("data")), F.lit(" "), sniffed(F.col("data"))),
)
_literal("decode_windows1252", "data binary", [(b"caf\xe9",), (b"A\x81",), (b"\x80\x93x\x94",), (b"abc",)], ["café", "A\x81", "€“x”", "abc"], lambda: decode_windows1252(F.col("data")))
_literal("decode_utf8_strict", "data binary", [(b"caf\xc3\xa9",), (b"abc\xffdef",), (b"\xef\xbb\xbfx",), (b"",)], ["café", None, "x", ""], lambda: decode_utf8(F.col("data")))
_literal("extension_cases", "name string", [(".gitignore",), ("noext",), ("a.asp",), ("b.ASP",), ("a.b.txt",), ("x.",)], ["", "", "asp", "asp", "txt", ""], lambda: extension(F.col("name")), computed=r"lower(regexp_extract(name, '^.+\.([^.]*)$', 1))")
_literal("leaf_cases", "path string", [("a/b.txt",), ("a\\b",), ("b",), ("a/",), ("a/b\\c",)], ["b.txt", "b", "b", "", "c"], lambda: leaf(F.col("path")), computed=r"regexp_extract(path, '[^/\\]*$')")
_literal("readable_bytes_cases", "n bigint", [(512,), (1024,), (12_897_485,), (3_221_225_472,), (0,)], ["512 B", "1.0 KiB", "12.3 MiB", "3.0 GiB", "0 B"], lambda: readable_bytes(F.col("n")), computed=f"CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) ELSE {_BYTES.format(n='n')} END")
_literal("readable_duration_cases", "s double", [(12.34,), (125.0,), (59.9,), (0.0,)], ["12.3 s", "2 m 05 s", "59.9 s", "0.0 s"], lambda: readable_duration(F.col("s")), computed="CASE WHEN s < 60 THEN printf('%.1f s', CAST(s AS DOUBLE)) ELSE printf('%d m %02d s', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) END")
_literal("readable_time_cases", "s bigint", [(0,), (-1,), (1_700_000_000,)], ["1970-01-01 00:00", "1969-12-31 23:59", "2023-11-14 22:13"], lambda: readable_time(F.col("s")), computed="strftime(make_timestamp(CAST(s AS BIGINT) * 1000000), '%Y-%m-%d %H:%M')")
_literal("seconds_floor_cases", "ns bigint", [(1_999_999_999,), (-1,), (None,)], ["1", "-1", None], lambda: seconds_of(F.col("ns")).cast("string"), computed="CAST(CAST(floor(ns / 1000000000.0) AS BIGINT) AS VARCHAR)")
_literal("ellipsize_cases", "t string", [("abcdef",), ("abcd",), ("日本語日本",)], ["abc…", "abcd", "日本語…"], lambda: ellipsize(F.col("t"), 4), computed="CASE WHEN length(t) <= 4 THEN t ELSE substr(t, 1, 3) || '…' END")
_literal("size_mib_cases", "t string", [("16",), (" 3 ",), ("0",), ("-1",), ("x",), ("",)], ["16", "3", None, None, None, None], lambda: size_mib(F.col("t")).cast("string"), computed="CASE WHEN try_cast(trim(t) AS BIGINT) > 0 THEN CAST(try_cast(trim(t) AS BIGINT) AS VARCHAR) END")
_literal("overlap_cases", "t string", [("aaa",), ("aaaa",), ("b",)], ["0", "0,2", ""], lambda: F.array_join(find(F.col("t"), "aa"), ","))
_literal(
    "whole_word_cases", "t string", [("needle2",), ("needle_x",), ("日本needle語",), ("needle needless needle. needle2",), ("(needle)",)], ["", "", "", "0,16", "1"],
    lambda: F.array_join(LiteralMatcher("needle", whole_word=True).starts(F.col("t"), fold(F.col("t"))), ","),
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every occurrence of a literal in the documents, with context."""
    return QUERIES["search_literal_ci"](spark, sf_dir)
