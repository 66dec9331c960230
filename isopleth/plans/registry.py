"""Registry of named queries and the SQL each is checked against.

A query declares its output once, as ``"name:kind ..."``.  The same
declaration shapes the Spark result and wraps the SQL, so both sides agree on
names, types and rounding.  Kinds: ``i`` integer, ``f`` double to 6 digits,
``g`` double to 3 digits, ``s`` string, ``d`` date as text, ``b`` flag as 0/1.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.plans.fixtures import VIEWS, Fixtures

MODULES = (
    "coordinates",
    "masks_scores",
    "skill",
    "joins",
    "filters",
    "objective_terms",
    "stations",
    "pairs",
    "sources_provenance",
    "baselines",
    "space",
    "time_series",
)


@dataclass(frozen=True)
class Query:
    name: str
    cols: tuple[tuple[str, str], ...]
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, cols: str, sql: str | None = None):
    """Register ``build(fixtures)`` under ``name``."""
    parsed = tuple(tuple(item.split(":")) for item in cols.split())

    def keep(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, parsed, build, sql)
        return build

    return keep


def _rounded(c: Column, scale: float) -> Column:
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def _shape(name: str, kind: str) -> Column:
    c = F.col(name)
    made = {
        "i": lambda: c.cast("long"),
        "f": lambda: _rounded(c.cast("double"), 1e6),
        "g": lambda: _rounded(c.cast("double"), 1e3),
        "s": lambda: c.cast("string"),
        "d": lambda: F.date_format(c.cast("date"), "yyyy-MM-dd"),
        "b": lambda: c.cast("boolean").cast("long"),
    }[kind]()
    return made.alias(name)


def _shape_sql(name: str, kind: str) -> str:
    return {
        "i": f"CAST({name} AS BIGINT)",
        "f": f"floor(CAST({name} AS DOUBLE)*1e6+0.5)/1e6",
        "g": f"floor(CAST({name} AS DOUBLE)*1e3+0.5)/1e3",
        "s": f"CAST({name} AS VARCHAR)",
        "d": f"strftime(CAST({name} AS DATE), '%Y-%m-%d')",
        "b": f"CAST(CAST({name} AS BOOLEAN) AS BIGINT)",
    }[kind] + f" AS {name}"


def _load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"isopleth.plans.{module}")
    return _QUERIES


def _runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = q.build(Fixtures(spark, sf_dir))
        return result.select(*[_shape(n, k) for n, k in q.cols])

    run.__name__ = q.name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(q) for name, q in _load().items()}


def _views_for(text: str) -> str:
    """The WITH items a statement needs, in dependency order."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", body):
                visit(sql)
                needed.append(name)

    visit(text)
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)


def oracle_sql() -> dict[str, str]:
    """Statements may start with their own ``WITH``; the needed views are put before it."""
    out = {}
    for name, q in _load().items():
        if q.sql is None:
            continue
        body, own = q.sql.strip(), ""
        if body.upper().startswith("WITH "):
            cut = body.rindex("\n--\n")
            own, body = body[5:cut].strip().rstrip(","), body[cut + 4 :]
        items = ",\n".join(x for x in (_views_for(q.sql), own) if x)
        head = f"WITH {items}\n" if items else ""
        out[name] = f"{head}SELECT {', '.join(_shape_sql(n, k) for n, k in q.cols)}\nFROM ({body}) AS result"
    return out
