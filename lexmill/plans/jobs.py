"""One search over several projects."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lexmill.functions.fold import fold_text
from lexmill.operators.merge import first_wins, merged_counters, tagged
from lexmill.operators.search import Cancelled, SearchOptions, counters, search
from lexmill.plans.live import search_live
from lexmill.plans.snapshot import Index


@dataclass(frozen=True)
class TargetOutcome:
    """``state``: success, failed, cancelled or not_attempted; ``counters``: one row, of a project that succeeded."""

    project_id: str
    state: str
    error: str | None = None
    counters: DataFrame | None = None


def project_counters(outcomes: list[TargetOutcome]) -> DataFrame | None:
    """The counters of all projects that succeeded, as one row of sums."""
    rows = [(o.project_id, o.counters) for o in outcomes if o.counters is not None]
    return merged_counters(tagged(rows)) if rows else None


def replaced(outcomes: list[TargetOutcome], project_id: str, counted: DataFrame) -> list[TargetOutcome]:
    """The outcomes with new counters of one project, as after its later phase; the sums follow."""
    return [replace(o, counters=counted) if o.project_id == project_id else o for o in outcomes]


def search_projects(spark, targets: list[tuple[str, str]], query: str, options: SearchOptions = SearchOptions(), cancelled=lambda: False, live: bool = False) -> tuple[DataFrame | None, list[TargetOutcome]]:
    """Search the indexes of (project, path) in order, each project once.

    An index that can't be opened fails alone; a cancel stops the rest. The results
    of those that succeeded are merged: the first project keeps a physical file.
    With ``live`` matches are those of the files as they are now.
    """
    options.matcher(query)
    outcomes: list[TargetOutcome] = []
    found: list[tuple[str, DataFrame]] = []
    paths: dict[str, str] = {}
    for project, path in targets:
        paths.setdefault(project, path)
    stopped = False
    for project, path in paths.items():
        if stopped:
            outcomes.append(TargetOutcome(project, "not_attempted"))
            continue
        try:
            if cancelled():
                raise Cancelled
            index = Index(spark, path)
            if live:
                now = search_live(index, query, options)
                rows, counted = now.results, now.counters
            else:
                rows, counted = search(index.rows(fold_text(query)), query, options), counters(index.rows(), query, options)
            found.append((project, rows))
            outcomes.append(TargetOutcome(project, "success", counters=counted))
        except Cancelled:
            stopped = True
            outcomes.append(TargetOutcome(project, "cancelled"))
        except (OSError, ValueError) as e:
            outcomes.append(TargetOutcome(project, "failed", f"{type(e).__name__}: {e}"))
    if not found:
        return None, outcomes
    rows = tagged(found)
    # Whole results win, so the winner is found among files and its matches are kept.
    files = first_wins(rows.select("project_id", "target", "file_path", "entry_path", "doc_id").distinct())
    return rows.join(files.select("target", "doc_id"), ["target", "doc_id"], "left_semi"), outcomes
