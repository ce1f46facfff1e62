"""DuckDB SQL that recomputes each query over the same parquet tables.

``VIEWS`` holds named subqueries; ``render`` puts those a statement needs in front of it.
"""

import re

from ..sources.fixtures import duckdb_ctes

VIEWS: dict[str, str] = {name: sql for name, (sql, _) in duckdb_ctes().items()}


def _sources(sql: str) -> list[str]:
    names = re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)
    return [n for n in dict.fromkeys(names) if n in VIEWS]


def render(sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for source in _sources(VIEWS[name]):
            if source != name:
                visit(source)
        if name not in order:
            order.append(name)

    for name in _sources(sql):
        visit(name)
    if not order:
        return sql
    own = re.match(r"\s*WITH RECURSIVE (.*)", sql, re.S)
    if own:
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + ",\n" + own.group(1)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + sql
