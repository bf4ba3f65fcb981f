"""Change the type or the notation of cells, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import SpecError, check, require_columns
from ..functions.values import (
    OPERATION_EPOCH,
    as_text,
    mixed_timestamp,
    parse_date,
    strip,
    title,
    to_whole,
    try_num,
)

TARGETS = ("date", "float", "int", "string")


def _keep_or_null(parsed: Column, c: Column, dtype: T.DataType, on_error: str) -> Column:
    """With on_error="keep" unreadable cells stay, which makes the column text."""
    if on_error == "null":
        return parsed
    if on_error == "keep":
        return F.coalesce(parsed.cast("string"), as_text(c, dtype))
    raise SpecError("on_error must be 'null' or 'keep'")


def fix_dtypes(
    df: DataFrame, columns: dict, on_error: str = "null", int_mode: str = "round", formats=None, as_string=False
) -> DataFrame:
    """Convert columns to date, float, int or string.

    `formats` is a list of date notations, or one list per column, tried in
    order. Dates are real dates unless `as_string`. int rounds half to even,
    or truncates with int_mode="trunc".
    """
    check("fix_dtypes", columns=(columns, "mapping"), int_mode=(int_mode, ("round", "trunc")))
    require_columns(df, columns)
    out = {}
    for name, target in columns.items():
        c, dtype = F.col(name), df.schema[name].dataType
        target = str(target).strip().lower()
        if target == "date":
            tried = formats.get(name) if isinstance(formats, dict) else formats
            parsed = parse_date(c, tried, dtype)
            if as_string:
                parsed = F.date_format(parsed, "yyyy-MM-dd")
            out[name] = _keep_or_null(parsed, c, dtype, on_error)
        elif target == "float":
            parsed = try_num(c, dtype)
            out[name] = parsed if on_error == "null" else _keep_or_null(as_text(parsed, T.DoubleType()), c, dtype, on_error)
        elif target == "int":
            out[name] = _keep_or_null(to_whole(c, dtype, int_mode), c, dtype, on_error)
        elif target == "string":
            out[name] = strip(as_text(c, dtype))
        else:
            raise SpecError(f"unsupported type '{target}' for column '{name}'; use one of {list(TARGETS)}")
    return df.withColumns(out)


def normalize_strings(df: DataFrame, columns, case: str = "lower") -> DataFrame:
    """Strip surrounding whitespace and set the case: lower, upper or title."""
    columns = list(columns)
    require_columns(df, columns)
    case = str(case).strip().lower()
    cases = {"lower": F.lower, "upper": F.upper, "title": title}
    check("normalize_strings", columns=(columns, "names"), case=(case, cases))
    return df.withColumns({n: cases[case](strip(as_text(F.col(n), df.schema[n].dataType))) for n in columns})


def fix_unix_ms(
    df: DataFrame,
    columns,
    output: str = "date",
    on_error: str = "null",
    rule=OPERATION_EPOCH,
    formats=None,
    as_string: bool = True,
) -> DataFrame:
    """Read epoch seconds, epoch milliseconds and written times in one column."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, columns)
    output = str(output).strip().lower()
    check("fix_unix_ms", columns=(columns, "names"), output=(output, ("date", "datetime")))
    out = {}
    for name in columns:
        c, dtype = F.col(name), df.schema[name].dataType
        ts = mixed_timestamp(c, formats, dtype, rule)
        if as_string or on_error == "keep":
            parsed = F.date_format(ts, "yyyy-MM-dd" if output == "date" else "yyyy-MM-dd HH:mm:ss")
        else:
            parsed = F.to_date(ts) if output == "date" else ts
        out[name] = _keep_or_null(parsed, c, dtype, on_error)
    return df.withColumns(out)
