"""Build an index of folders and search it: ``python -m lexmill.cli INDEX QUERY FOLDER...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexmill.functions.masks import NameMasks
from lexmill.operators.search import SearchOptions, canonical_order
from lexmill.plans.build import update_index
from lexmill.plans.live import search_live
from lexmill.plans.options import BuildOptions, RootSpec
from lexmill.plans.snapshot import Index


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    p.add_argument("index")
    p.add_argument("query")
    p.add_argument("folders", nargs="+")
    p.add_argument("--case", action="store_true")
    p.add_argument("--word", action="store_true")
    p.add_argument("--context", type=int, default=2)
    p.add_argument("--include", default="")
    p.add_argument("--exclude", default="")
    p.add_argument("--limit", type=int, default=100, help="matches to print")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    report = update_index(spark, a.index, BuildOptions(tuple(RootSpec(f) for f in a.folders)))
    print(f"{report.kind}: {report.counters['files_indexed']} indexed, {report.counters['errors']} errors")
    options = SearchOptions(a.case, a.word, a.context, NameMasks.of(a.include, a.exclude))
    found = search_live(Index(spark, a.index), a.query, options)
    print(found.counters.first().asDict())
    for r in found.results.orderBy(*canonical_order(), "line", "column").limit(a.limit).toLocalIterator():
        print(f"{r['file_path']}{'!' + r['entry_path'] if r['entry_path'] else ''}:{r['line']}:{r['column']}: {r['line_text']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
