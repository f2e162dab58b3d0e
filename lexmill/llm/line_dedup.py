"""Removal of boilerplate lines by their frequency relative to the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line on more than this share of a host's pages is boilerplate ...
MAX_RATIO = 0.02
#: ... if it is on at least so many of them; so hosts of one or two pages lose nothing.
MIN_PAGES = 3
#: Into how many parts the pages of a line are dealt when dropped lines are sought in them.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """What lines are compared by: the line without spaces at its ends, as a 128-bit digest in hex.

    Strings, unlike binary values, are hashed when an array's distinct values are sought.
    """
    return F.md5(F.trim(line))


def _without(lines: Column, places: Column) -> Column:
    """``lines`` but for those at ``places`` (from 0); ``lines`` is bound once, and both steps are linear."""

    def cut(own: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), places)
        return F.transform(kept, lambda i: F.get(own, i))

    return F.element_at(F.transform(F.array(lines), cut), 1)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``df`` with boilerplate lines cut out of the text; adds ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n`` and are compared without spaces at their ends. For each
    host, the pages that contain a line (once or often) are divided by the pages
    of the host; a line over ``max_ratio`` that at least ``min_pages`` pages hold
    is dropped wherever it stands on that host. Blank lines are never dropped.
    All rows stay, some with an empty text.

    With ``copies_once`` pages of a host that hold the same lines are counted as one
    page, in both numbers: a page is not boilerplate for being there many times.
    Pages that share only most of their lines are counted one by one still.

    A null text is empty and has no lines; rows with a null host are one host.
    Rows that repeat an id are pages of their own. An empty table gives an empty
    result. Other columns stay as they are, but columns named ``n_lines`` or
    ``n_dropped`` are replaced; internal columns carry the prefix ``_ld_``.

    The counts take one shuffle of digests, combined on the map side, so that a
    line of all pages of a hot host is one row per task. The set of dropped lines
    is bounded per host by (mean lines a page / ``max_ratio``); it meets the lines
    again in a join by host, digest and one of SALTS parts, into which the pages
    of every line are dealt. Texts are shuffled once at most, by page: rows of one
    id, host and text share their places of dropped lines. Time is linear in the
    lines of a page.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    page = F.unhex(F.md5(F.concat_ws("\u0001", F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000")), host, text)))
    pages = df.select(host.alias("_ld_host"), text.alias("_ld_text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_ld_text")), lambda x: F.trim(x) != ""), _key))
    counted, counted_lines = pages, pages.select("_ld_host", F.explode(keys).alias("_ld_key"))
    if copies_once:
        # Equal sets of lines have equal digests; the sort makes their order the same.
        keyed = pages.select("_ld_host", F.sort_array(keys).alias("_ld_keys"))
        counted = keyed.withColumn("_ld_page", F.unhex(F.md5(F.array_join("_ld_keys", "")))).dropDuplicates(["_ld_host", "_ld_page"])
        counted_lines = counted.select("_ld_host", F.explode("_ld_keys").alias("_ld_key"))
    totals = counted.groupBy("_ld_host").agg(F.count(F.lit(1)).alias("_ld_pages"))
    dropped = (
        counted_lines.withColumn("_ld_key", F.unhex("_ld_key"))
        .groupBy("_ld_host", "_ld_key")
        .agg(F.count(F.lit(1)).alias("_ld_n"))
        .where(F.col("_ld_n") >= min_pages)
        .join(totals, "_ld_host")
        .where(F.col("_ld_n") > F.lit(float(max_ratio)) * F.col("_ld_pages"))
        .select("_ld_host", "_ld_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_ld_part"))
    )
    # Two steps: behind the explosion the page's digest would be taken again for every line.
    keyed_pages = df.select(page.alias("_ld_page"), host.alias("_ld_host"), text.alias("_ld_text"))
    lines = keyed_pages.select("_ld_page", "_ld_host", F.posexplode(_lines(F.col("_ld_text"))).alias("_ld_at", "_ld_line")).where(F.trim("_ld_line") != "")
    lines = lines.select("_ld_page", "_ld_host", "_ld_at", F.unhex(_key(F.col("_ld_line"))).alias("_ld_key"), F.pmod(F.xxhash64("_ld_page"), F.lit(SALTS)).cast("int").alias("_ld_part"))
    hits = lines.join(dropped, ["_ld_host", "_ld_key", "_ld_part"], "left_semi").groupBy("_ld_page").agg(F.collect_set("_ld_at").alias("_ld_places"))
    joined = df.withColumn("_ld_page", page).join(hits, "_ld_page", "left")
    hit = F.col("_ld_places").isNotNull()
    n_lines = F.when(text == "", F.lit(0)).otherwise(F.size(_lines(text))).cast("long")
    n_dropped = F.when(hit, F.size("_ld_places")).otherwise(0).cast("long")
    kept = F.when(hit, F.array_join(_without(_lines(text), F.col("_ld_places")), "\n")).otherwise(text)
    own = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    wide = joined.select(*own, kept.alias(text_col), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
    return wide.select(*[c for c in df.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


#: The same in SQL, with the production parameters.
LINE_DEDUP_SQL = f"""
WITH pages AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS body FROM documents
), lines AS (
  SELECT doc_id, host, i AS at, parts[i] AS line, trim(parts[i]) AS k
  FROM (SELECT doc_id, host, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, host, string_split(body, chr(10)) AS parts FROM pages) AS s) AS u
), counts AS (
  SELECT host, k, count(DISTINCT doc_id) AS n FROM lines WHERE k <> '' GROUP BY host, k
), totals AS (
  SELECT host, count(*) AS pages FROM pages GROUP BY host
), dropped AS (
  SELECT counts.host, counts.k FROM counts JOIN totals ON counts.host = totals.host
  WHERE counts.n >= {MIN_PAGES} AND counts.n > {MAX_RATIO} * totals.pages
), marked AS (
  SELECT lines.doc_id, lines.at, lines.line, dropped.k IS NOT NULL AS gone
  FROM lines LEFT JOIN dropped ON lines.host = dropped.host AND lines.k = dropped.k
)
SELECT pages.doc_id,
       coalesce(string_agg(marked.line, chr(10) ORDER BY marked.at) FILTER (WHERE NOT marked.gone), '') AS text,
       CAST(CASE WHEN max(pages.body) = '' THEN 0 ELSE count(*) END AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN marked.gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
FROM pages JOIN marked ON pages.doc_id = marked.doc_id
GROUP BY pages.doc_id
"""
