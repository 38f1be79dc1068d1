"""Which source reads a request: matchers by priority. A matcher that fails does
not match; a name registered again replaces the old one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablesmith.sources import databases, files
from tablesmith.sources.shaping import fuzzy_union

TABULAR = (".csv", ".xls", ".xlsx", ".xlsm")


@dataclass(frozen=True)
class Request:
    """What to read: files, or a kind of database with a query; extra is free."""

    paths: tuple[str, ...] = ()
    kind: str | None = None
    query: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)


Reader = Callable[[SparkSession, Request], dict[str, DataFrame]]


@dataclass(frozen=True)
class Source:
    name: str
    matches: Callable[[Request], bool]
    read: Reader
    priority: int = 0


class Registry:
    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def register(self, name: str, matches: Callable[[Request], bool], priority: int = 0) -> Callable[[Reader], Reader]:
        def add(read: Reader) -> Reader:
            self._sources[name] = Source(name, matches, read, priority)
            return read

        return add

    def names(self) -> list[str]:
        return [s.name for s in sorted(self._sources.values(), key=lambda s: -s.priority)]

    def find(self, request: Request) -> Source:
        for s in sorted(self._sources.values(), key=lambda s: -s.priority):
            try:
                if s.matches(request):
                    return s
            except Exception:
                continue
        raise LookupError(f"no source for {request}")

    def read(self, spark: SparkSession, request: Request) -> dict[str, DataFrame]:
        return self.find(request).read(spark, request)


def table_names(paths: list[str] | tuple[str, ...]) -> list[str]:
    """File stems; one that was there gets its number."""
    out: list[str] = []
    for i, p in enumerate(paths):
        stem = PurePosixPath(p).stem
        out.append(stem if stem not in out else f"{stem}_{i}")
    return out


def read_files(spark: SparkSession, request: Request) -> dict[str, DataFrame]:
    """One file by its suffix (an archive gives all its tables); several tabular ones
    as one union; others each by itself. The first is the primary table."""
    if len(request.paths) == 1 and request.paths[0].lower().endswith(".zip"):
        return files.read_zip_tables(spark, request.paths[0])
    names = table_names(request.paths)
    tables = {n: files.read(spark, p) for n, p in zip(names, request.paths, strict=True)}
    if len(tables) > 1 and all(PurePosixPath(p).suffix.lower() in TABULAR for p in request.paths):
        return {"union": fuzzy_union(tables)}
    return tables


def default_registry() -> Registry:
    registry = Registry()
    registry.register("database", lambda r: r.kind is not None, 20)(lambda spark, r: databases.query_set(spark, query=r.query, mode=r.extra.get("mode", "auto"), planner=r.extra.get("planner")))
    registry.register("files", lambda r: bool(r.paths), 10)(read_files)
    return registry
