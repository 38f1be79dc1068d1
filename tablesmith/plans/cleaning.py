"""Clean pipeline: a quality gate, rules from a port, a dry run, the full run, a
check of the result; up to three attempts, then the table as it was. Rules and
checks come from injected functions; the defaults are deterministic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tablesmith.operators.cleaning import visible
from tablesmith.operators.joins import detect_join, join_sources
from tablesmith.operators.profile import issues, profile
from tablesmith.plans.rules import RuleEngine

ATTEMPTS = 3
LOG_LINES = 10

#: (table, issue rows, last log lines) -> rules in YAML
RulePort = Callable[[DataFrame, list[dict], list[str]], str]
#: (before, after, issue rows) -> whether the result is accepted
CheckPort = Callable[[DataFrame, DataFrame, list[dict]], bool]


@dataclass
class Cleaned:
    df: DataFrame
    quality: str
    logs: list[str] = field(default_factory=list)
    rules: str | None = None


def default_rules(df: DataFrame, found: list[dict], logs: list[str]) -> str:
    """Rules for what the quality gate can find."""
    kinds = {x["issue"] for x in found}
    nodes = []
    if "empty_rows" in kinds:
        nodes.append("  empty: {operator: Filter, drop_empty: true}")
    if "duplicates" in kinds:
        nodes.append("  dedup: {operator: Dedup}")
    return "nodes:\n" + "\n".join(nodes or ["  keep: {operator: Filter}"])


def accept(before: DataFrame, after: DataFrame, found: list[dict]) -> bool:
    return set(visible(before)) >= set(visible(after))


def clean(df: DataFrame, rules: RulePort = default_rules, check: CheckPort = accept, engine: RuleEngine | None = None, inputs: dict[str, DataFrame] | None = None, always: bool = False) -> Cleaned:
    if not visible(df):
        return Cleaned(df, "empty")
    found = issues(profile(df))
    if not found and not always:
        return Cleaned(df, "clean", ["no issue found"])
    engine, logs = engine or RuleEngine(), []
    for attempt in range(1, ATTEMPTS + 1):
        text = rules(df, found, logs[-LOG_LINES:])
        dry = engine.dry_run(text, df, inputs)
        logs += [f"attempt {attempt}", *dry.logs]
        if not dry.success:
            logs.append(f"dry run failed: {dry.error}")
            continue
        full = engine.execute(text, df, inputs)
        if not full.success or full.df.isEmpty():
            logs.append(f"run failed: {full.error or 'the result is empty'}")
            continue
        if check(df, full.df, found):
            return Cleaned(full.df, "cleaned", logs, text)
        logs.append("the result was not accepted")
    return Cleaned(df, "low", logs)


def clean_all(tables: dict[str, DataFrame], **ports) -> dict[str, Cleaned]:
    """Two tables that share a key are joined and cleaned as one; else, or if that fails, each alone."""
    if len(tables) == 2:
        (a, left), (b, right) = tables.items()
        keys = detect_join(left, right)
        if keys:
            done = clean(join_sources(left, right, *keys, how="left"), **ports)
            if done.quality != "low":
                return {f"{a}_{b}": done}
    return {name: clean(df, **ports) for name, df in tables.items()}
