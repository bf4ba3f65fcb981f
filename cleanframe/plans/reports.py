"""The report queries over cleaned tables."""

from __future__ import annotations

import threading

from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import SpecError, require_columns
from ..functions.values import (
    DAY_FIRST,
    computed,
    dosage,
    drug_name,
    mixed_timestamp,
    parse_date,
    strip,
    to_whole,
    try_num,
)
from ..operators.dedupe import first_per_key
from ..operators.nulls import exact_median
from .conform import known_parents

# The day from which the two count reports count.
REPORT_START = "2024-01-01"


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


# -- counts per ward --------------------------------------------------------


def clean_admissions(
    df: DataFrame, order_by, id="patient_id", date="admission_date", ward="ward", age="age"
) -> DataFrame:
    """One readable admission per patient.

    The missing ages take the median of all rows, before incomplete rows and
    copies go. Dates are read as ISO first, then day first.
    """
    order_by = list(order_by)
    number = try_num(F.col(age), _dtype(df, age)).alias("age")
    median = exact_median(df.select(number), "age")
    rows = computed(
        df,
        strip(F.col(id)).alias("patient_id"),
        parse_date(F.col(date), ["yyyy-MM-dd", *DAY_FIRST], _dtype(df, date)).alias("admission_date"),
        F.upper(strip(F.col(ward))).alias("ward"),
        F.col(age).alias("age"),
        *[F.col(c).alias(f"__order{i}") for i, c in enumerate(order_by)],
    ).dropna(subset=["patient_id", "admission_date", "ward"])
    kept = first_per_key(rows, ["patient_id"], [f"__order{i}" for i in range(len(order_by))])
    years = F.rint(F.coalesce(try_num(F.col("age"), _dtype(df, age)), median)).cast("bigint")
    return kept.select("patient_id", "admission_date", "ward", years.alias("age"))


def ward_counts(admissions: DataFrame, since: str = REPORT_START) -> DataFrame:
    """Patients per ward admitted since the day, largest ward first."""
    return (
        admissions.filter(F.col("admission_date") >= F.lit(since).cast("date"))
        .groupBy("ward")
        .agg(F.count(F.lit(1)).alias("patient_count"))
        .orderBy(F.desc("patient_count"), F.asc("ward"))
    )


# -- prescriptions per ward and drug ----------------------------------------

# A digit string of this length is an epoch.
EPOCH_DIGITS = r"^\d{10,13}$"


def prescribed_date(c: Column, dtype=None, formats=None) -> Column:
    return F.to_date(mixed_timestamp(c, formats, dtype, digits=EPOCH_DIGITS))


def clean_prescriptions(medications: DataFrame, patients: DataFrame, formats=None) -> DataFrame:
    """Prescriptions of known patients with a readable drug, dose and date."""
    known = known_parents(medications, patients, "patient_id", "patient_id")
    rows = computed(
        known,
        "medication_id",
        strip(F.col("patient_id")).alias("patient_id"),
        drug_name(F.col("drug_name")).alias("drug_name"),
        F.bround(dosage(F.col("dosage_mg"), _dtype(medications, "dosage_mg")), 2).alias("dosage_mg"),
        prescribed_date(F.col("prescribed_date"), _dtype(medications, "prescribed_date"), formats).alias(
            "prescribed_date"
        ),
    )
    return rows.filter(F.col("drug_name") != "").dropna(subset=["dosage_mg", "prescribed_date"])


def _per_patient(medications: DataFrame, since: str, normalize_drug: bool, formats) -> DataFrame:
    """Prescriptions per patient and drug since the day."""
    day = prescribed_date(F.col("prescribed_date"), _dtype(medications, "prescribed_date"), formats)
    drug = drug_name(F.col("drug_name")) if normalize_drug else F.coalesce(F.col("drug_name").cast("string"), F.lit(""))
    return (
        medications.filter(day >= F.lit(since).cast("date"))
        .groupBy(strip(F.col("patient_id")).alias("patient_id"), drug.alias("drug_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def prescription_counts(
    medications: DataFrame, patients: DataFrame, since: str = REPORT_START, normalize_drug: bool = True, formats=None
) -> DataFrame:
    """Prescriptions per ward and drug since the day, counted over an inner join.

    Counts per patient and drug are taken before the join, so a patient holding
    a large part of all prescriptions reaches it as a handful of rows.
    """
    per_patient = _per_patient(medications, since, normalize_drug, formats)
    wards = patients.select(strip(F.col("patient_id")).alias("patient_id"), F.upper(strip(F.col("ward"))).alias("ward"))
    return (
        per_patient.join(wards, "patient_id")
        .groupBy("ward", "drug_name")
        .agg(F.sum("n").alias("prescription_count"))
        .orderBy("ward", "drug_name")
    )


def normalized_counts(report: DataFrame, keys, measures, lower=()) -> DataFrame:
    """Report rows with stripped keys, upper-case but for those in `lower`, and whole measures.

    Rows with an empty key or an unreadable measure are left out, and rows
    whose keys became equal are added up.
    """
    require_columns(report, [*keys, *measures])
    cells = [(F.lower if k in lower else F.upper)(strip(F.col(k))).alias(k) for k in keys]
    values = [to_whole(F.col(m), _dtype(report, m), "trunc").alias(m) for m in measures]
    rows = report.select(*cells, *values).dropna(subset=[*keys, *measures])
    for k in keys:
        rows = rows.filter(F.col(k) != "")
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def join_fanout(
    medications: DataFrame, patients: DataFrame, reported: DataFrame | None = None, since: str = REPORT_START, formats=None
) -> DataFrame:
    """Is the reported total nearer to the inner join's size or to the cross join's?

    Neither join is run: the cross join's size is a product of two counts, and
    the inner join's a sum over counts per patient.
    """
    per_patient = _per_patient(medications, since, True, formats)
    children = per_patient.groupBy("patient_id").agg(F.sum("n").alias("n"))
    parents = patients.groupBy(strip(F.col("patient_id")).alias("patient_id")).agg(F.count(F.lit(1)).alias("m"))
    sizes = children.join(parents, "patient_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("inner_total"),
    )
    sizes = sizes.select(F.struct("eligible", "inner_total").alias("sizes")).scalar()
    patient_rows = patients.agg(F.count(F.lit(1)).alias("t"))
    if reported is None:
        reported = prescription_counts(medications, patients, since, formats=formats)
    total = reported.agg(
        F.coalesce(F.sum(F.greatest(F.col("prescription_count"), F.lit(0))), F.lit(0)).alias("reported_total"),
        F.count(F.lit(1)).alias("__rows"),
    )
    sized = total.select(
        "reported_total",
        sizes["inner_total"].alias("inner_total"),
        (sizes["eligible"] * patient_rows.scalar()).alias("cross_total"),
        "__rows",
    )
    nearer = F.abs(F.col("reported_total") - F.col("inner_total")) <= F.abs(
        F.col("reported_total") - F.col("cross_total")
    )
    return sized.select(
        "reported_total", "inner_total", "cross_total", ((F.col("__rows") > 0) & nearer).alias("join_fixed")
    )


# -- capacity per unit ------------------------------------------------------


def occupancy_measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("current_occupancy"), F.count_if(F.col("status") == "active").alias("active_count")]


def occupancy(conformed: DataFrame) -> DataFrame:
    return conformed.groupBy("icu_unit").agg(*occupancy_measures())


def capacity(beds: DataFrame, unit: str = "unit") -> DataFrame:
    return beds.groupBy(F.col(unit).alias("icu_unit")).agg(F.count(F.lit(1)).alias("total_capacity"))


def capacity_report(conformed: DataFrame, beds: DataFrame, how: str = "left", unit: str = "unit") -> DataFrame:
    """Beds, patients and active patients per unit, from two small pre-aggregates.

    how="left" lists the units that have beds; "full" also those with patients only.
    """
    if how not in ("left", "full"):
        raise SpecError("how must be 'left' or 'full'")
    joined = capacity(beds, unit).join(occupancy(conformed), "icu_unit", "left" if how == "left" else "full_outer")
    measures = ["current_occupancy", "total_capacity", "active_count"]
    return joined.select("icu_unit", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]).orderBy("icu_unit")


# -- SQL --------------------------------------------------------------------

# One query at a time gives its tables their names.
_NAMING = threading.Lock()


def read_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], args=None) -> DataFrame:
    """Run one query over the named tables. `args` are bound parameters.

    The text is parsed first and refused if any part of its plan is a command or writes. The
    names are visible to this query only, whatever other threads read meanwhile.
    """
    _only_reads(spark, query)
    with _NAMING:
        hidden = {}
        for name in tables:
            try:
                hidden[name] = spark._jsparkSession.sessionState().catalog().getRawTempView(name)
            except Py4JError:
                hidden[name] = None
        kept = {name: spark.table(name) for name, view in hidden.items() if view is not None and view.isDefined()}
        try:
            for name, table in tables.items():
                table.createOrReplaceTempView(name)
            return spark.sql(query, args=args)
        finally:
            for name in tables:
                spark.catalog.dropTempView(name)
            for name, table in kept.items():
                table.createOrReplaceTempView(name)


def _only_reads(spark: SparkSession, query: str) -> None:
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Py4JError as bad:
        raise SpecError(f"the query cannot be parsed: {str(bad).splitlines()[0]}") from bad
    except ParseException as bad:
        raise SpecError(f"the query cannot be parsed: {str(bad).splitlines()[0]}") from bad
    find = spark._jvm.java.lang.Class.forName
    # fixed values: what a plan that does more than read is made of
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    writing = [find(logical + name) for name in ("Command", "InsertIntoStatement", "CompoundPlanStatement")]
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if any(kind.isInstance(node) for kind in writing):
            raise SpecError(f"only queries that read are allowed, not {node.nodeName()}")
        for some in (node.children(), node.innerChildren()):
            nodes += [x for x in (some.apply(i) for i in range(some.length())) if "logical" in x.getClass().getName()]


def top_rows(df: DataFrame, order_by, n: int = 50) -> DataFrame:
    """The first n rows for display, each with the full row count beside it."""
    count = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order_by).limit(n).withColumn("row_count", count)
