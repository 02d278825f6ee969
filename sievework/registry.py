"""Named, listed operations.

An operation is a function ``(spark, sf_dir) -> DataFrame`` registered under a name with a one-line
description, the survey rows it covers, and, where the answer can be stated in SQL, the SQL text
that gives the same rows on the same Parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .session import prepare
from .sources import fixtures

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Operation:
    name: str
    description: str
    covers: tuple[str, ...]
    runner: Runner
    sql: str | None


_OPERATIONS: dict[str, Operation] = {}


def with_fixtures(names: list[str], body: str) -> str:
    """Prefix an SQL body with the fixture texts it reads."""
    heads = ",\n".join(f"{name} AS ({fixtures.SQL[name]})" for name in names)
    return f"WITH {heads}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().removeprefix('+')}"


def operation(covers: str, sql: str | None = None, uses: list[str] | None = None):
    """Register a function under its own name; its docstring becomes the description.

    ``uses`` names the fixtures the SQL reads; an SQL body that starts with ``+`` goes on with
    further common table expressions after them.
    """

    def register(fn: Runner) -> Runner:
        name = fn.__name__
        if name in _OPERATIONS:
            raise ValueError(f"operation {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        text = with_fixtures(uses, sql) if sql and uses else sql
        summary = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        _OPERATIONS[name] = Operation(name, summary, tuple(covers.split()), run, text)
        return fn

    return register


def operations() -> dict[str, Operation]:
    """All operations by name, loading the catalogue on first use."""
    from . import catalog  # noqa: F401  (registers on import)

    return dict(sorted(_OPERATIONS.items()))


def listing(spark: SparkSession) -> DataFrame:
    """The catalogue itself as a table."""
    rows = [(o.name, o.description, " ".join(o.covers), o.sql is not None) for o in operations().values()]
    return spark.createDataFrame(rows, "name string, description string, covers string, has_sql boolean")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run one operation; an unknown name lists the known ones."""
    known = operations()
    if name not in known:
        raise KeyError(f"no operation {name!r}; known: {', '.join(known)}")
    return known[name].runner(spark, sf_dir)
