"""Named queries: metadata, templates with {parameters}, and rule files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from factweave.operators.rules import CATALOGUE, REPORTS, SYMBOL_REPORTS, Rules
from factweave.plans.compiler import compile_query
from factweave.plans.datalog import QueryError

_PARAM = re.compile(r"\{(\w+)\}")


def safe_value(text: str) -> str:
    """A value that may stand in a quoted constant."""
    return text.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')


def fill(template: str, values: dict[str, str]) -> str:
    """A template with its parameters put in; one that is missing is an error."""
    missing = [p for p in _PARAM.findall(template) if p not in values]
    if missing:
        raise QueryError(f"missing parameter {missing[0]}")
    return _PARAM.sub(lambda m: safe_value(str(values[m[1]])), template)


@dataclass
class QueryDefinition:
    name: str
    template: str = ""
    description: str = ""
    category: str = ""
    tier: int = 1
    severity: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def parameters(self) -> list[str]:
        return list(dict.fromkeys(_PARAM.findall(self.template)))


def read_rules(text: str) -> list[QueryDefinition]:
    """The definitions in a rule file: query_metadata facts, and rules whose bodies become templates."""
    out: dict[str, QueryDefinition] = {}
    for m in re.finditer(r'query_metadata\(\s*"([^"]+)"\s*,\s*"((?:\\.|[^"\\])*)"(?:\s*,\s*"((?:\\.|[^"\\])*)")?\s*\)', text):
        d = out.setdefault(m[1], QueryDefinition(m[1]))
        key, value = (m[2], m[3]) if m[3] is not None else ("description", m[2])
        value = re.sub(r"\\(.)", r"\1", value)
        if key in ("template", "description", "category", "severity"):
            setattr(d, key, value)
        elif key == "tier":
            d.tier = int(value)
        else:
            d.extra[key] = value
    for m in re.finditer(r"^(\w+)\([^)]*\)\s*:-\s*(.+?)\.\s*$", text, re.M | re.S):
        if m[1] not in ("query", "query_metadata"):
            d = out.setdefault(m[1], QueryDefinition(m[1]))
            d.template = d.template or re.sub(r"\s+", " ", m[2]).strip()
    return list(out.values())


class Registry:
    """Queries by name. Built in are those of the rule library; files and callers add templates."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryDefinition] = {c.name: QueryDefinition(c.name, description=c.description, category=c.category, tier=c.tier, severity=c.severity) for c in CATALOGUE}
        self.paths: list[str] = []
        for name, template in (("find_defines", 'triples("{file}", "defines", ?symbol)'), ("find_imports", 'triples("{file}", "imports", ?target)'), ("smell_circular_direct", 'triples(?a, "calls", ?b), triples(?b, "calls", ?a), ?a != ?b'), ("smell_imports", 'triples(?file, "imports", ?package)'), ("smell_defines", 'triples(?file, "defines", ?symbol)'), ("smell_layer_violation", 'triples(?file, "imports", ?target), triples(?file, "has_tag", ?tag), triples(?target, "has_tag", "backend"), ?tag != "backend"')):
            self.queries[name].template = template

    def load(self, path: str) -> int:
        """Read a rule file, or all .dl files below a folder in order; the number of definitions read."""
        files = [path] if os.path.isfile(path) else sorted(os.path.join(base, f) for base, _, fs in os.walk(path) for f in fs if f.endswith(".dl"))
        n = 0
        for p in files:
            with open(p, encoding="utf-8") as f:
                for d in read_rules(f.read()):
                    self.queries[d.name] = d
                    n += 1
        if path not in self.paths:
            self.paths.append(path)
        return n

    def reload(self) -> int:
        return sum(self.load(p) for p in list(self.paths))

    def register(self, d: QueryDefinition) -> None:
        if not re.fullmatch(r"\w+", d.name):
            raise QueryError(f"{d.name!r} is no name")
        self.queries[d.name] = d

    def get(self, name: str) -> QueryDefinition:
        if name not in self.queries:
            raise QueryError(f"no query is named {name}")
        return self.queries[name]

    def list(self, category: str | None = None) -> list[QueryDefinition]:
        return sorted((d for d in self.queries.values() if category in (None, d.category)), key=lambda d: (d.tier, d.name))

    def execute(self, name: str, facts: DataFrame, values: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
        """A template with its values, or the rule or report of the library of that name (values: symbol, for what is of one symbol)."""
        d = self.get(name)
        if d.template:
            return compile_query(fill(d.template, values or {}), facts, limit)
        rules = Rules(facts)
        if name in SYMBOL_REPORTS:
            if not (values or {}).get("symbol"):
                raise QueryError("missing parameter symbol")
            rows = SYMBOL_REPORTS[name](rules, values["symbol"])
        else:
            rows = REPORTS[name](rules) if name in REPORTS else rules.findings(name)
        return rows.limit(limit) if limit else rows
