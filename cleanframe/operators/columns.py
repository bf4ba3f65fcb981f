"""Rename, map, merge, copy and derive columns, row by row."""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import SpecError, check, require_columns
from ..functions.values import (
    all_digits,
    as_text,
    first_digits,
    is_numeric,
    nullify,
    parse_timestamp,
    recent,
)

# A mapping up to this size becomes a literal, a longer one a join; both give the same.
LITERAL_MAP_SIZE = 100


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def _merged(df: DataFrame, names, null_like, extra=()) -> tuple[list[Column], T.DataType]:
    """The columns and literals as one type: their own if all agree, else text."""
    types = {_type(df, n).simpleString() for n in names}
    literals = [v for v in extra if v is not None]
    same = len(types) == 1 and all(_fits(v, _type(df, names[0])) for v in literals)
    out = []
    for n in names:
        c = nullify(F.col(n), null_like, _type(df, n))
        out.append(c if same else as_text(c, _type(df, n)))
    dtype = _type(df, names[0]) if same else T.StringType()
    out += [(F.lit(v) if same else F.lit(str(v))).cast(dtype) for v in literals]
    return out, dtype


def _fits(value, dtype: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, int):
        return is_numeric(dtype)
    if isinstance(value, float):
        return isinstance(dtype, (T.DoubleType, T.FloatType))
    return isinstance(value, str) and isinstance(dtype, T.StringType)


def rename_columns(df: DataFrame, mapping: dict, null_like=()) -> DataFrame:
    """Rename in the given order; onto an existing column, fill its nulls instead."""
    check("rename_columns", mapping=(mapping, "renaming"))
    for old, new in mapping.items():
        if old == new or old not in df.columns:
            continue
        if new in df.columns:
            parts, _ = _merged(df, [new, old], null_like)
            df = df.withColumn(new, F.coalesce(*parts)).drop(old)
        else:
            df = df.withColumnRenamed(old, new)
    return df


def map_values(df: DataFrame, column: str, mapping: dict, default=..., null_like=()) -> DataFrame:
    """Replace cells found in the mapping, by their value or else by their text.

    The key 1 finds 1 and 1.0, and "1" finds the text. Cells not found become `default` if one is given and stay otherwise. A
    mapping may lead to null. A null cell becomes the default or stays null.
    """
    require_columns(df, [column])
    check("map_values", mapping=(mapping, "mapping"))
    dtype = _type(df, column)
    cell = nullify(F.col(column), null_like, dtype)
    targets = [v for v in list(mapping.values()) + ([] if default is ... else [default]) if v is not None]
    native = all(_fits(v, dtype) for v in targets)
    rest_type = dtype if native else T.StringType()

    def literal(v):
        return F.lit(None).cast(rest_type) if v is None else F.lit(v if native else str(v)).cast(rest_type)

    text = as_text(cell, dtype)
    kept = (cell if native else text) if default is ... else literal(default)
    entries = _by_text(mapping, dtype)
    if len(entries) <= LITERAL_MAP_SIZE:
        lookup = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), literal(v))])
        found = F.map_contains_key(lookup, text)
        return df.withColumn(
            column, F.when(text.isNull(), kept).when(found, F.element_at(lookup, text)).otherwise(kept)
        )
    schema = T.StructType([T.StructField("__from", T.StringType()), T.StructField("__to", T.StringType())])
    rows = [(k, None if v is None else str(v)) for k, v in entries.items()]
    table = df.sparkSession.createDataFrame(rows, schema).withColumn("__found", F.lit(True))
    joined = df.join(table, on=text == F.col("__from"), how="left")
    mapped = F.when(F.col("__found"), F.col("__to").cast(rest_type)).otherwise(kept)
    return joined.withColumn(column, mapped).select(*df.columns)


def _by_text(mapping: dict, dtype: T.DataType) -> dict:
    """The mapping by the texts of the column's cells.

    A key that is a value of the column counts before one that only has its text, and of
    several keys with one text the last counts.
    """
    out = {str(k): v for k, v in mapping.items()}
    if isinstance(dtype, T.StringType):
        out.update({k: v for k, v in mapping.items() if isinstance(k, str)})
        return out
    for k, v in mapping.items():
        if isinstance(k, str):
            continue
        if isinstance(dtype, T.BooleanType) and k in (0, 1):
            out[str(bool(k))] = v
        elif isinstance(dtype, (T.DoubleType, T.FloatType)) and isinstance(k, (int, float, Decimal)):
            out[repr(float(k))] = v
        elif isinstance(dtype, T.DecimalType) and isinstance(k, (int, float, Decimal)):
            exact = Decimal(str(int(k) if isinstance(k, bool) else k))
            if exact == round(exact, dtype.scale):
                out[f"{exact:.{dtype.scale}f}"] = v
        elif is_numeric(dtype) and isinstance(k, (int, float, Decimal)) and k == k // 1:
            out[str(int(k))] = v
    return out


def coalesce_columns(
    df: DataFrame, target_column: str, source_columns, fill_value=None, drop_sources=False, null_like=()
) -> DataFrame:
    """The first non-null of the sources, then the fill value."""
    source_columns = list(source_columns)
    check("coalesce_columns", target_column=(target_column, "text"), source_columns=(source_columns, "names"))
    require_columns(df, source_columns)
    parts, _ = _merged(df, source_columns, null_like, [fill_value])
    out = df.withColumn(target_column, F.coalesce(*parts))
    if drop_sources:
        out = out.drop(*[c for c in source_columns if c != target_column])
    return out


def copy_column(df: DataFrame, from_column: str, to_column: str, overwrite=True, null_like=()) -> DataFrame:
    """Copy a column, or with overwrite=False only into the target's nulls."""
    require_columns(df, [from_column])
    if overwrite or to_column not in df.columns:
        return df.withColumn(to_column, F.col(from_column))
    parts, _ = _merged(df, [to_column, from_column], null_like)
    return df.withColumn(to_column, F.coalesce(*parts))


def _choice(condition: Column, then, otherwise) -> Column:
    """when/otherwise over literals that may differ in type (then both are text)."""
    if then is not None and otherwise is not None and type(then) is not type(otherwise):
        then, otherwise = str(then), str(otherwise)
    return F.when(condition, F.lit(then)).otherwise(F.lit(otherwise))


def _equals(df: DataFrame, column: str, value) -> Column:
    """Null-safe equality that is false, not an error, between text and numbers."""
    if value is None:
        return F.col(column).isNull()
    dtype = _type(df, column)
    if isinstance(dtype, T.StringType):
        return F.col(column).eqNullSafe(F.lit(value)) if isinstance(value, str) else F.lit(False)
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        if isinstance(value, str):
            return F.lit(False)
        return F.col(column).cast("double").eqNullSafe(F.lit(float(value)))
    return as_text(F.col(column), dtype).eqNullSafe(F.lit(str(value)))


def _template(df: DataFrame, template: str, null_like) -> Column:
    parts = []
    try:
        pieces = list(Formatter().parse(template))
    except ValueError as bad:
        raise SpecError(f"template cannot be read: {template!r}") from bad
    for text, field, spec, conversion in pieces:
        if text:
            parts.append(F.lit(text))
        if field is None:
            continue
        if spec or conversion or field == "" or field.isdigit() or set(field) & set(".["):
            raise SpecError(f"template fields must be plain column names: {template!r}")
        if field in df.columns:
            cell = nullify(F.col(field), null_like, _type(df, field))
            parts.append(F.coalesce(as_text(cell, _type(df, field)), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


RULES = ("from_column", "if_equals", "template", "extract_digits", "date_within_days")


def derive_column(df: DataFrame, target_column: str, rule: str = "", null_like=(), **p) -> DataFrame:
    """Add a column by one of the rules, or a constant given as `value`.

    from_column(source_column); if_equals(column, equals, then, else_);
    template(template); extract_digits(column, fallback, digits="first"|"all");
    date_within_days(column, reference_date, days, then, else_, formats).
    """
    rule = str(rule or "").strip().lower()
    if "else" in p:
        p["else_"] = p.pop("else")
    if not rule and "value" in p:
        return df.withColumn(target_column, F.lit(p["value"]))
    if rule not in RULES:
        raise SpecError(f"unsupported derive_column rule '{rule}'; use one of {list(RULES)}")
    if rule == "template":
        if not isinstance(p.get("template"), str):
            raise SpecError("rule 'template' needs a text template")
        return df.withColumn(target_column, _template(df, p["template"], null_like))

    source = p.get("source_column") if rule == "from_column" else p.get("column")
    if not isinstance(source, str):
        raise SpecError(f"rule '{rule}' needs a source column")
    require_columns(df, [source])
    c, dtype = F.col(source), _type(df, source)
    if rule == "from_column":
        return df.withColumn(target_column, c)
    if rule == "if_equals":
        return df.withColumn(target_column, _choice(_equals(df, source, p.get("equals")), p.get("then"), p.get("else_")))
    if rule == "extract_digits":
        found = {"first": first_digits, "all": all_digits}.get(p.get("digits", "first"))
        if found is None:
            raise SpecError("digits must be 'first' or 'all'")
        fallback = F.lit(str(p.get("fallback", "UNKNOWN")))
        return df.withColumn(target_column, F.coalesce(found(as_text(c, dtype)), fallback))

    try:
        days = int(p.get("days", 0))
    except (TypeError, ValueError) as bad:
        raise SpecError("rule 'date_within_days' needs whole days") from bad
    reference = p.get("reference_date")
    try:
        day = _read_reference(reference)
    except (TypeError, ValueError) as bad:
        raise SpecError(f"rule 'date_within_days' cannot read reference_date {reference!r}") from bad
    ts = parse_timestamp(c, p.get("formats"), dtype)
    inside = F.coalesce(recent(ts, F.timestamp_seconds(F.lit(day)), days), F.lit(False))
    return df.withColumn(target_column, _choice(inside, p.get("then"), p.get("else_")))


def _read_reference(text: str) -> int:
    """Seconds since 1970 of an ISO date or time, UTC unless it says otherwise."""
    moment = datetime.fromisoformat(text.strip())
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp())
