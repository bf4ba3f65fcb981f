"""Profiles, rule ratios and coverage of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import SpecError, require_columns
from ..functions.values import parse_timestamp, present, strip, to_whole, try_num


def closeness(actual: Column, expected: Column) -> Column:
    """1 for equal numbers, falling to 0 with the error relative to the expected."""
    return F.greatest(F.lit(0.0), 1 - F.abs(actual - expected) / F.greatest(expected, F.lit(1)))


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def share(condition: Column) -> Column:
    """Share of the rows for which the condition holds; unknown counts as no."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def profile(df: DataFrame) -> DataFrame:
    """Row count and count of nulls (NaN included) per column, from one aggregation."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(present(F.col(f.name), f.dataType).isNull()).alias(f.name) for f in df.schema.fields],
    )
    return counts.unpivot("__rows", df.columns, "column_name", "null_count").withColumnRenamed("__rows", "row_count")


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def distinct_share(df: DataFrame, keys) -> Column:
    """Distinct keys per row, as a scalar subquery; nulls are equal; empty is 1."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum("n")), F.lit(1.0)).alias("s")).scalar()


@dataclass
class Rule:
    name: str
    holds: Column
    weight: float


@dataclass
class ForeignKey:
    """A rule that holds if the stripped key occurs among the parents."""

    name: str
    column: str
    parents: DataFrame
    parent_key: str
    weight: float


@dataclass
class DistinctKeys:
    """A ratio: the share of rows that do not repeat an earlier row's key."""

    name: str
    columns: list[str]
    weight: float


@dataclass
class RowCount:
    """A ratio: how close the row count is to the expected one."""

    name: str
    expected: int | Column
    weight: float


def _known_share(df: DataFrame, rule: ForeignKey) -> Column:
    """Share of the rows whose key occurs among the parents, as a scalar subquery."""
    per_key = df.groupBy(strip(F.col(rule.column)).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
    parents = rule.parents.select(strip(F.col(rule.parent_key)).alias("__parent"), F.lit(True).alias("__known")).distinct()
    counted = per_key.join(parents, on=F.col("__key") == F.col("__parent"), how="left")
    known = F.sum(F.when(F.col("__known"), F.col("__rows")))
    return counted.agg(F.coalesce(F.try_divide(known, F.sum("__rows")), F.lit(0.0)).alias("s")).scalar()


def rule_ratios(df: DataFrame, rules, required_columns=(), column_weight: float = 0.0) -> DataFrame:
    """One row with the ratio of each rule and their weighted sum as `score`.

    Missing required columns leave 0.20 times the share of those present; no
    rows at all give 0. All plain rules are counted in one pass, and each
    foreign key on counts per key, so that a hot key costs one row in its join.
    """
    present = [c for c in required_columns if c in df.columns]
    column_share = len(present) / len(required_columns) if required_columns else 1.0
    if column_share < 1:
        rows = df.agg(F.count(F.lit(1)).alias("row_count"))
        score = F.when(F.col("row_count") > 0, F.round(F.lit(0.20 * column_share), 6)).otherwise(0.0)
        return rows.select("row_count", F.lit(column_share).alias("column_share"), score.alias("score"))

    for r in rules:
        require_columns(df, [r.column] if isinstance(r, ForeignKey) else r.columns if isinstance(r, DistinctKeys) else [])
    hits = {r.name: F.count_if(r.holds) for r in rules if isinstance(r, Rule)}
    totals = df.agg(F.count(F.lit(1)).alias("row_count"), *[h.alias(n) for n, h in hits.items()])
    ratios = {}
    for r in rules:
        if isinstance(r, RowCount):
            expected = r.expected if isinstance(r.expected, Column) else F.lit(r.expected)
            ratios[r.name] = closeness(F.col("row_count"), expected)
        elif isinstance(r, DistinctKeys):
            ratios[r.name] = distinct_share(df, r.columns)
        elif isinstance(r, ForeignKey):
            ratios[r.name] = _known_share(df, r)
        else:
            ratios[r.name] = F.coalesce(F.try_divide(F.col(r.name), F.col("row_count")), F.lit(0.0))
    scored = totals.select("row_count", *[v.cast("double").alias(n) for n, v in ratios.items()])
    total = sum((F.col(r.name) * r.weight for r in rules), F.lit(column_weight * column_share))
    score = F.when(F.col("row_count") > 0, F.round(clamp(total), 6)).otherwise(0.0)
    return scored.select("*", score.alias("score"))


# -- the rules of the reports -----------------------------------------------


def prescription_rules(df: DataFrame, patients: DataFrame, date_is_iso: Column, expected_rows) -> list:
    """Known patient, normalised drug, numeric dose, ISO date, row count."""
    drug = F.col("drug_name")
    dose_type = df.schema["dosage_mg"].dataType
    dose = F.col("dosage_mg").cast("string")
    return [
        ForeignKey("known_patient", "patient_id", patients, "patient_id", 0.30),
        Rule("normalized_drug", (drug == F.lower(strip(drug))) & (drug != ""), 0.25),
        Rule("numeric_dosage", try_num(F.col("dosage_mg"), dose_type).isNotNull() | dose.rlike(r"\d"), 0.25),
        Rule("iso_date", date_is_iso, 0.10),
        RowCount("row_count_score", expected_rows, 0.10),
    ]


# The columns, value sets and bed notation of a conformed feed.
CONFORMED_COLUMNS = [
    "patient_uid",
    "source_system",
    "source_record_id",
    "icu_unit",
    "bed_number",
    "admitted_at",
    "status",
]
CONFORMED_BED = r"^[AB]-BED-(\d+|UNKNOWN)$"
SOURCES = ["hospital_a", "hospital_b"]
STATUSES = ["active", "inactive"]
CONFORMED_COLUMN_WEIGHT = 0.12


def conformed_rules(df: DataFrame, units, expected_rows, sources=None) -> list:
    admitted = parse_timestamp(F.col("admitted_at"), None, df.schema["admitted_at"].dataType)
    return [
        Rule("source_ok", F.col("source_system").isin(sources or SOURCES), 0.12),
        Rule("unit_ok", F.col("icu_unit").isin(list(units)), 0.16),
        Rule("bed_ok", F.col("bed_number").rlike(CONFORMED_BED), 0.16),
        Rule("admitted_ok", admitted.isNotNull(), 0.14),
        Rule("status_ok", F.col("status").isin(STATUSES), 0.10),
        DistinctKeys("not_duplicate", ["icu_unit", "bed_number", "admitted_at"], 0.10),
        RowCount("row_count_score", expected_rows, 0.10),
    ]


def clean_spec_rules(df: DataFrame, spec: dict) -> list:
    """Compile a declarative clean spec into equally weighted rules.

    Keys read: dedupe_keys, type_requirements, null_handling and
    string_normalization, the last three by column.
    """
    rules = []
    cells = {c: F.col(c) for c in df.columns}

    def cell(name):
        require_columns(df, [name])
        return cells[name], df.schema[name].dataType

    cases = {"upper": F.upper, "lower": F.lower}

    def normalized(c, case):
        return c.cast("string") == cases[case](strip(c))

    for name, wanted in spec.get("type_requirements", {}).items():
        c, dtype = cell(name)
        if wanted == "string":
            holds = c.isNotNull()
        elif wanted in ("string_upper", "string_lower"):
            holds = normalized(c, wanted.split("_")[1])
        elif wanted.startswith("date"):
            holds = parse_timestamp(c, ["yyyy-MM-dd"], dtype).isNotNull()
        elif wanted.startswith("int"):
            number = try_num(c, dtype)
            holds = number == to_whole(c, dtype)
            holds = holds | c.isNull() if wanted == "int_nullable" else holds
        elif wanted.startswith("float"):
            holds = try_num(c, dtype).isNotNull()
        else:
            raise SpecError(f"unknown type requirement '{wanted}' for column '{name}'")
        rules.append((f"{name}_type", holds))
    for name in spec.get("null_handling", {}):
        rules.append((f"{name}_present", cell(name)[0].isNotNull()))
    for name, how in spec.get("string_normalization", {}).items():
        case = "upper" if "upper" in how else "lower"
        rules.append((f"{name}_normalized", normalized(cell(name)[0], case)))
    keys = spec.get("dedupe_keys", [])
    weight = 1.0 / max(1, len(rules) + bool(keys))
    out: list = [Rule(n, h, weight) for n, h in rules]
    if keys:
        out.append(DistinctKeys("not_duplicate", list(keys), weight))
    return out


def coverage(candidate: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Share of the expected keys present, and share of repeated candidate rows."""
    keys = list(keys)
    sides = candidate.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("e")).unionByName(
        expected.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("e"))
    )
    per_key = sides.groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    wanted = F.count_if(F.col("e") > 0)
    rows = F.coalesce(F.sum("c"), F.lit(0))
    return per_key.agg(
        (F.count_if((F.col("e") > 0) & (F.col("c") > 0)) / F.greatest(wanted, F.lit(1))).alias("coverage"),
        ((rows - F.count_if(F.col("c") > 0)) / F.greatest(rows, F.lit(1))).alias("duplicate_share"),
    )
