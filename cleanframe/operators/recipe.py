"""Run a list of declarative cleaning operations as one lazy plan."""

from __future__ import annotations

import inspect
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, functions as F

from ..errors import SpecError
from .columns import coalesce_columns, copy_column, derive_column, map_values, rename_columns
from .dedupe import remove_duplicates
from .nulls import fix_nulls
from .outliers import remove_outliers
from .types import fix_dtypes, fix_unix_ms, normalize_strings

OPERATIONS = {
    "remove_duplicates": remove_duplicates,
    "fix_nulls": fix_nulls,
    "fix_dtypes": fix_dtypes,
    "normalize_strings": normalize_strings,
    "remove_outliers": remove_outliers,
    "rename_columns": rename_columns,
    "map_values": map_values,
    "coalesce_columns": coalesce_columns,
    "copy_column": copy_column,
    "derive_column": derive_column,
    "fix_unix_ms": fix_unix_ms,
}

# The other names under which parameters may be given.
ALIASES = {
    "fix_dtypes": {"dtypes": "columns"},
    "coalesce_columns": {"target": "target_column", "columns": "source_columns"},
    "copy_column": {"source_column": "from_column", "target_column": "to_column"},
    "fix_unix_ms": {"column": "columns"},
}

# Operations whose result for a row depends on that row alone.
ROW_LOCAL = frozenset(OPERATIONS) - {"remove_duplicates", "remove_outliers", "fix_nulls"}


def is_row_local(name: str, params: dict) -> bool:
    return name in ROW_LOCAL or (name == "fix_nulls" and params.get("strategy") == "drop")


def parse_operations(spec) -> list[tuple[str, dict]]:
    """Read a list of operations, {"operations": [...]} or a single operation."""
    if isinstance(spec, dict):
        if "operations" in spec:
            spec = spec["operations"]
        elif "operation" in spec or "name" in spec:
            spec = [spec]
        else:
            raise SpecError("give 'operation' or 'operations'")
    if not isinstance(spec, (list, tuple)) or not spec or any(not isinstance(o, dict) for o in spec):
        raise SpecError("operations must be a non-empty list of objects")
    return [_parse_one(o) for o in spec]


def _parse_one(operation: dict) -> tuple[str, dict]:
    params = dict(operation)
    alias = params.pop("name", None)
    name = params.pop("operation", None) or alias
    if not isinstance(name, str):
        raise SpecError("an operation needs a text field 'operation'")
    name = name.strip().lower()
    if name not in OPERATIONS:
        raise SpecError(f"unsupported operation '{name}'; supported: {sorted(OPERATIONS)}")
    for other, usual in ALIASES.get(name, {}).items():
        if other in params:
            given = params.pop(other)
            if params.get(usual) in (None, "", [], {}):
                params[usual] = given
    if name == "derive_column" and "target_column" not in params:
        params["target_column"] = params.get("column")
    return name, params


def _apply(df: DataFrame, step: tuple[str, dict], order_by, null_like) -> DataFrame:
    name, params = step
    call = OPERATIONS[name]
    accepted = inspect.signature(call).parameters
    if order_by and "order_by" in accepted:
        params = {"order_by": order_by, **params}
    if null_like and "null_like" in accepted:
        params = {"null_like": null_like, **params}
    if name != "derive_column":
        unknown = set(params) - set(accepted)
        if unknown:
            raise SpecError(f"{name}: unknown parameters {sorted(unknown)}")
    try:
        return call(df, **params)
    except TypeError as bad:
        raise SpecError(f"{name}: {bad}") from bad


def _reads_twice(name: str, params: dict) -> bool:
    """Whether the step looks at the whole table before it handles its rows."""
    return not is_row_local(name, params) and name != "remove_duplicates"


def clean(df: DataFrame, operations, order_by=(), null_like=(), staged: bool = False) -> DataFrame:
    """Chain the operations. Every step is checked while the plan is built, so a
    wrong spec raises before any job runs and leaves nothing half done.

    `order_by` and `null_like` are defaults for the operations that take them.
    Every step with a statistic of the whole table (means, bounds, fills) reads
    its input again, with all that stands before it. `staged` stores the rows
    before such a step in the shared folder, once the whole plan has been
    checked, so that every step, and the source, runs once.
    """
    steps = parse_operations(operations)
    planned = reduce(lambda table, step: _apply(table, step, order_by, null_like), steps, df)
    if not staged:
        return planned
    from ..sources.tables import materialize  # which itself uses operators

    table = df
    for step in steps:
        if _reads_twice(*step):
            table = materialize(table)
        table = _apply(table, step, order_by, null_like)
    return table


def clean_or_keep(df: DataFrame, operations, order_by=(), null_like=(), run: bool = False) -> tuple[DataFrame, str | None]:
    """clean(), or the table as it was and the reason if the spec is wrong.

    A column without any value to fill from is found only when the plan runs. With `run` it runs here, into the
    shared folder, and such a failure keeps the table too.
    """
    from ..sources.tables import materialize  # which itself uses operators

    try:
        cleaned = clean(df, operations, order_by, null_like)
        return (materialize(cleaned) if run else cleaned), None
    except SpecError as wrong:
        return df, str(wrong)
    except PySparkException as failed:
        if failed.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        return df, str(failed).splitlines()[0]


def clean_with_report(df: DataFrame, operations, order_by=(), null_like=()):
    """Like clean(), plus a function giving rows before and after each operation.

    The counts are collected by the same pass that computes the result; call
    the function after an action on the returned table has finished.
    """
    steps = parse_operations(operations)
    counters = [Observation() for _ in range(len(steps) + 1)]

    def counted(table: DataFrame, i: int) -> DataFrame:
        return table.observe(counters[i], F.count(F.lit(1)).alias("rows"))

    out = counted(df, 0)
    for i, step in enumerate(steps, start=1):
        out = counted(_apply(out, step, order_by, null_like), i)

    def report() -> list[dict]:
        rows = [c.get["rows"] for c in counters]
        return [
            {"operation": name, "rows_before": rows[i], "rows_after": rows[i + 1]}
            for i, (name, _) in enumerate(steps)
        ]

    return out, report
