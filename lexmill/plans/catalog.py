"""Projects, saved searches and preferences, in JSON files that are replaced whole."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.masks import NameMasks, parse_masks
from lexmill.functions.paths import parse_list
from lexmill.operators.search import SearchOptions
from lexmill.plans.build import BuildReport
from lexmill.plans.options import EXCLUDED_DIRS, MIB, ArchiveOptions, BuildOptions, InvalidOptions, RootSpec

PARAMS_VERSION = PREFERENCES_VERSION = 3


class NotFound(KeyError):
    """No project or saved search has that id."""


class InvalidInput(ValueError):
    """A name is required, or a value can't be used."""


class CorruptCatalog(ValueError):
    """A stored document can't be read."""


def _known(kind: type, d: dict[str, Any]) -> dict[str, Any]:
    """Keys that the class has; others are ignored and missing ones take their default."""
    names = {f.name for f in fields(kind)}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in names}


@dataclass(frozen=True)
class ProjectSettings:
    roots: tuple[RootSpec, ...] = ()
    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    include_masks: tuple[str, ...] = ()
    exclude_masks: tuple[str, ...] = ()
    respect_gitignore: bool = False
    max_file_size: int = 16 * MIB
    archives_enabled: bool = True
    archive_max_depth: int = 1
    #: New projects fall back to Windows-1252; documents without the field decode strictly.
    fallback_encoding: str | None = "windows-1252"

    @staticmethod
    def from_json(d: dict[str, Any]) -> ProjectSettings:
        d = _known(ProjectSettings, {"fallback_encoding": None} | d)
        return ProjectSettings(**d | {"roots": tuple(RootSpec(**r) for r in d.get("roots", ()))})

    def build_options(self) -> BuildOptions:
        return BuildOptions(
            self.roots, self.excluded_dirs, NameMasks(self.include_masks, self.exclude_masks), self.respect_gitignore,
            self.max_file_size, ArchiveOptions(self.archives_enabled, max_depth=self.archive_max_depth), self.fallback_encoding,
        )


@dataclass(frozen=True)
class SearchParams:
    version: int = PARAMS_VERSION
    case_sensitive: bool = False
    whole_word: bool = False
    context_lines: int = 2
    include_masks: tuple[str, ...] = ()
    exclude_masks: tuple[str, ...] = ()
    analyze_oversized: bool = False
    project_ids: tuple[str, ...] = ()

    def options(self) -> SearchOptions:
        return SearchOptions(self.case_sensitive, self.whole_word, self.context_lines, NameMasks(self.include_masks, self.exclude_masks), self.analyze_oversized)

    @staticmethod
    def of(o: SearchOptions) -> SearchParams:
        return SearchParams(PARAMS_VERSION, o.case_sensitive, o.whole_word, o.context_lines, o.masks.include, o.masks.exclude, o.analyze_oversized)

    def selection(self, owner: str) -> tuple[str, ...]:
        """The projects searched, in order; documents that name none mean their owner."""
        return self.project_ids or (owner,)


@dataclass(frozen=True)
class Project:
    id: str
    name: str
    created_at: int
    settings: ProjectSettings
    index_path: str
    last_settings: ProjectSettings | None = None
    last_report: dict[str, Any] | None = None
    last_build_at: int | None = None


@dataclass(frozen=True)
class SavedSearch:
    id: str
    project_id: str
    name: str
    query: str
    params: SearchParams
    created_at: int


@dataclass(frozen=True)
class Preferences:
    schema_version: int = PREFERENCES_VERSION
    language: str = "en"
    theme: str = "system"
    default_excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    default_include_masks: tuple[str, ...] = ()
    default_exclude_masks: tuple[str, ...] = ()
    default_max_file_size: int = 16 * MIB
    check_for_updates: bool = True
    last_search_project_id: str | None = None

    def normalized(self) -> Preferences:
        """Lists trimmed, without empty entries and repeats, in the user's order."""
        clean = lambda xs: tuple(dict.fromkeys(x.strip() for x in xs if x.strip()))
        return replace(self, default_excluded_dirs=clean(self.default_excluded_dirs), default_include_masks=clean(self.default_include_masks), default_exclude_masks=clean(self.default_exclude_masks))

    def new_project(self) -> ProjectSettings:
        """What the form for a new project starts with: archives are off there."""
        return ProjectSettings((), self.default_excluded_dirs, self.default_include_masks, self.default_exclude_masks, max_file_size=self.default_max_file_size, archives_enabled=False)


def settings_of_form(base: ProjectSettings, roots: list[tuple[str, bool]], excluded_dirs: str, include: str, exclude: str, max_mib: str) -> ProjectSettings:
    """Blank roots are skipped; a size that isn't a positive whole number becomes 0, which validation rejects."""
    text = max_mib.strip()
    size = int(text) * MIB if text.isdecimal() else 0
    kept = tuple(RootSpec(p.strip(), r) for p, r in roots if p.strip())
    return replace(base, roots=kept, excluded_dirs=tuple(parse_list(excluded_dirs)), include_masks=tuple(parse_masks(include)), exclude_masks=tuple(parse_masks(exclude)), max_file_size=size)


class Catalog:
    """A folder with ``catalog.json``, ``preferences.json`` and an index folder per project.

    Every change rewrites the document beside the old one and renames it over it;
    so a change happens as a whole or not at all.
    """

    def __init__(self, base: str) -> None:
        self.base = base
        os.makedirs(f"{base}/projects", exist_ok=True)

    def _load(self, name: str) -> dict[str, Any] | None:
        try:
            with open(f"{self.base}/{name}", encoding="utf-8") as f:
                found = json.load(f)
        except FileNotFoundError:
            return None
        except ValueError as e:
            raise CorruptCatalog(f"{name}: {e}") from e
        if not isinstance(found, dict):
            raise CorruptCatalog(f"{name} holds no object")
        return found

    def _save(self, name: str, document: dict[str, Any]) -> None:
        with open(f"{self.base}/{name}.tmp", "w", encoding="utf-8") as f:
            json.dump(document, f, indent=1, default=str)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.base}/{name}.tmp", f"{self.base}/{name}")

    def _state(self) -> dict[str, Any]:
        return self._load("catalog.json") or {"projects": [], "searches": []}

    def _put(self, kind: str, item: dict[str, Any], state: dict[str, Any] | None = None) -> None:
        state = state or self._state()
        at = next((i for i, x in enumerate(state[kind]) if x["id"] == item["id"]), None)
        if at is None:
            state[kind].append(item)
        else:
            state[kind][at] = item
        self._save("catalog.json", state)

    # Projects

    @staticmethod
    def _project(d: dict[str, Any]) -> Project:
        last = d.get("last_settings")
        return Project(**d | {"settings": ProjectSettings.from_json(d["settings"]), "last_settings": ProjectSettings.from_json(last) if last else None})

    def projects(self) -> list[Project]:
        return sorted((self._project(d) for d in self._state()["projects"]), key=lambda p: p.created_at)

    def project(self, project_id: str) -> Project:
        return next((p for p in self.projects() if p.id == project_id), None) or self._missing(project_id)

    @staticmethod
    def _missing(which: str) -> Any:
        raise NotFound(which)

    def create_project(self, name: str, settings: ProjectSettings) -> Project:
        settings.build_options().validate()
        key = str(uuid.uuid4())
        project = Project(key, name, int(time.time()), settings, f"{self.base}/projects/{key}/index")
        os.makedirs(os.path.dirname(project.index_path))
        self._put("projects", asdict(project))
        return project

    def change_project(self, project_id: str, name: str | None = None, settings: ProjectSettings | None = None) -> Project:
        """Another name or other settings; the index stays where it is."""
        if settings:
            settings.build_options().validate()
        old = self.project(project_id)
        new = replace(old, name=old.name if name is None else name, settings=settings or old.settings)
        self._put("projects", asdict(new))
        return new

    def record_build(self, project_id: str, report: BuildReport) -> Project:
        old = self.project(project_id)
        new = replace(old, last_settings=old.settings, last_report=asdict(report), last_build_at=int(time.time()))
        self._put("projects", asdict(new))
        return new

    def needs_rebuild(self, project: Project) -> bool:
        return project.last_settings is None or project.last_settings != project.settings or not os.path.exists(project.index_path)

    def status(self, project: Project) -> str:
        return "never built" if project.last_settings is None else "rebuild needed" if self.needs_rebuild(project) else "up to date"

    def delete_project(self, project_id: str) -> None:
        """Its files first; then, at once, the project and what saved searches say of it."""
        self.project(project_id)
        shutil.rmtree(f"{self.base}/projects/{project_id}", ignore_errors=True)
        state = self._state()
        state["searches"] = [s for s in (self._trimmed(s, project_id) for s in state["searches"]) if s]
        state["projects"] = [p for p in state["projects"] if p["id"] != project_id]
        self._save("catalog.json", state)

    @staticmethod
    def _trimmed(search: dict[str, Any], gone: str) -> dict[str, Any] | None:
        """A saved search without a project; None if no project is left to search."""
        owned = search["project_id"] == gone
        params = search["params"]
        if not isinstance(params, dict):
            return None if owned else search
        chosen = tuple(params.get("project_ids") or (search["project_id"],))
        left = [p for p in chosen if p != gone]
        if not left:
            return None
        if len(left) < len(chosen):
            search = search | {"params": params | {"project_ids": left, "version": PARAMS_VERSION}}
        return search | {"project_id": left[0]} if owned else search

    # Saved searches

    @staticmethod
    def _search(d: dict[str, Any]) -> SavedSearch:
        if not isinstance(d["params"], dict):
            raise CorruptCatalog(f"parameters of saved search {d['id']}")
        return SavedSearch(**d | {"params": SearchParams(**_known(SearchParams, d["params"]))})

    def searches(self, owner: str | None = None) -> list[SavedSearch]:
        found = [d for d in self._state()["searches"] if owner is None or d["project_id"] == owner]
        return sorted(map(self._search, found), key=lambda s: s.created_at)

    def search(self, search_id: str) -> SavedSearch:
        return next((self._search(d) for d in self._state()["searches"] if d["id"] == search_id), None) or self._missing(search_id)

    def save_search(self, project_id: str, name: str, query: str, params: SearchParams = SearchParams(), search_id: str | None = None) -> SavedSearch:
        """A new saved search, or with ``search_id`` another content of an old one."""
        if not name.strip():
            raise InvalidInput("a saved search needs a name")
        if search_id is None:
            self.project(project_id)
            saved = SavedSearch(str(uuid.uuid4()), project_id, name.strip(), query, params, int(time.time()))
        else:
            saved = replace(self.search(search_id), name=name.strip(), query=query, params=params)
        self._put("searches", asdict(saved))
        return saved

    def rename_search(self, search_id: str, name: str) -> SavedSearch:
        old = self.search(search_id)
        return self.save_search(old.project_id, name, old.query, old.params, search_id)

    def delete_search(self, search_id: str) -> None:
        self.search(search_id)
        state = self._state()
        state["searches"] = [s for s in state["searches"] if s["id"] != search_id]
        self._save("catalog.json", state)

    # Preferences

    def preferences(self) -> Preferences:
        found = self._load("preferences.json")
        return Preferences() if found is None else Preferences(**_known(Preferences, found))

    def save_preferences(self, preferences: Preferences) -> None:
        self._save("preferences.json", asdict(preferences.normalized()))

    def frame(self, spark: SparkSession) -> DataFrame:
        """Projects as rows, to join with results."""
        rows = [(p.id, p.name, p.created_at, p.index_path, self.status(p)) for p in self.projects()]
        return spark.createDataFrame(rows, "id string, name string, created_at long, index_path string, status string")


__all__ = ["Catalog", "CorruptCatalog", "InvalidInput", "InvalidOptions", "NotFound", "Preferences", "Project", "ProjectSettings", "SavedSearch", "SearchParams", "settings_of_form"]
