"""Cleaning rules in YAML: named nodes, each an operator with its parameters, and
a chain of node names. The whole chain becomes one lazy plan.

    inputs: {orders: orders_2024}        # alias -> input, for joins
    nodes:
      big: {operator: Filter, condition: "row['amount'] > 10"}
      top: {operator: Limit, n: 5}
    processor: {chain: [big, top]}       # absent: all nodes in order

A failure returns the table as it was, with the error. Faults of a plan show when
it is analysed; `eager` also runs it, for faults that only the rows show."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tablesmith.operators.cleaning import REGISTRY, Limit, Operator

SAMPLE_ROWS = 10


@dataclass
class RuleOutcome:
    success: bool
    df: DataFrame
    logs: list[str] = field(default_factory=list)
    error: str | None = None
    rules: str = ""


class RuleError(ValueError):
    pass


class RuleEngine:
    def __init__(self, extra: dict[str, type[Operator]] | None = None):
        self.operators = {**REGISTRY, **(extra or {})}

    def execute(self, rules: str, df: DataFrame, inputs: dict[str, DataFrame] | None = None, eager: bool = False) -> RuleOutcome:
        logs: list[str] = []
        try:
            spec = self._read(rules)
            named_inputs = self._inputs(spec, inputs, logs)
            nodes = self._nodes(spec)
            out = df
            for step in self._chain(spec, nodes):
                if step not in nodes:
                    logs.append(f"WARNING chain: no node {step}")
                    continue
                out, said = nodes[step].run(out, named_inputs)
                logs += [f"[{step}] {x}" for x in said]
                out.schema  # noqa: B018  analyses the step
            if eager and out.isEmpty():
                logs.append("WARNING the result is empty")
        except (RuleError, PySparkException, ValueError, TypeError, KeyError) as e:
            return RuleOutcome(False, df, logs, str(e), rules)
        return RuleOutcome(True, out, logs, None, rules)

    def dry_run(self, rules: str, df: DataFrame, inputs: dict[str, DataFrame] | None = None, rows: int = SAMPLE_ROWS) -> RuleOutcome:
        """On the first rows of each table (by its input order, if it has one), and really run."""
        first = lambda t: Limit(rows).run(t)[0]
        few = {k: first(v) for k, v in inputs.items()} if inputs else inputs
        return self.execute(rules, first(df), few, eager=True)

    def _read(self, rules: str) -> dict:
        try:
            spec = yaml.safe_load(rules)
        except yaml.YAMLError as e:
            raise RuleError(f"not YAML: {e}") from None
        if not isinstance(spec, dict):
            raise RuleError("the rules must be a mapping")
        if not isinstance(spec.get("nodes"), dict) or not spec["nodes"]:
            raise RuleError("the rules have no nodes")
        return spec

    def _inputs(self, spec: dict, inputs: dict[str, DataFrame] | None, logs: list[str]) -> dict[str, DataFrame] | None:
        """With aliases, only these are visible."""
        aliases = spec.get("inputs") or {}
        if not aliases or not inputs:
            return inputs
        logs += [f"WARNING inputs: no source {s} for {a}" for a, s in aliases.items() if s not in inputs]
        return {a: inputs[s] for a, s in aliases.items() if s in inputs}

    def _nodes(self, spec: dict) -> dict[str, Operator]:
        made = {}
        for name, node in spec["nodes"].items():
            if not isinstance(node, dict):
                raise RuleError(f"node {name} must be a mapping")
            if "operator" not in node:
                raise RuleError(f"node {name} names no operator")
            if node["operator"] not in self.operators:
                raise RuleError(f"node {name}: unknown operator {node['operator']}; there are {', '.join(sorted(self.operators))}")
            # YAML 1.1 reads the key `on` as true
            params = {"on" if k is True else str(k): v for k, v in node.items() if k != "operator"}
            try:
                made[name] = self.operators[node["operator"]](**params)
            except TypeError as e:
                raise RuleError(f"node {name}: {e}") from None
        return made

    def _chain(self, spec: dict, nodes: dict) -> list[str]:
        chain = (spec.get("processor") or {}).get("chain") or list(nodes)
        return [chain] if isinstance(chain, str) else list(chain)
