"""Sources and sinks over Spark's readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..errors import SpecError, require_columns
from ..operators.dedupe import first_per_key


#: The file in a versioned table's folder that names the current version.
POINTER = "_current"


def utc(spark: SparkSession) -> SparkSession:
    """Let timestamps be read and rendered in UTC, as every function here assumes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read_table(spark: SparkSession, where: str, columns=None, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A table by path or catalog name, with only the columns needed.

    Spark tables have no row order; operators that need one take `order_by`. A folder that
    `replace_table` keeps is read in its current version.
    """
    if "/" in where:
        where = current_version(spark, where) or where
        reader = spark.read.format(format).options(**options)
        df = (reader.schema(schema) if schema is not None else reader).load(where)
    else:
        df = spark.table(where)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column=None, lower=None, upper=None, partitions=None, **options
) -> DataFrame:
    """A database table, read in parallel ranges of a numeric or date column.

    Without a partition column the whole table comes through one task, so that
    must be asked for by partitions=1.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column is None:
        if partitions != 1:
            raise SpecError("give partition_column, lower, upper and partitions, or partitions=1")
        return reader.load()
    if None in (lower, upper, partitions):
        raise SpecError("partition_column needs lower, upper and partitions")
    return reader.options(
        partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
    ).load()


def write_jdbc(df: DataFrame, url: str, table: str, partitions: int = 8, **options) -> None:
    """Replace a database table's rows, keeping its definition."""
    writer = df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", numPartitions=str(partitions))
    writer.options(**options).mode("overwrite").save()


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """A small table from literal rows; a DataFrame passes through.

    With a text column in the schema, cells of mixed type become their text.
    """
    if isinstance(rows, DataFrame):
        return rows
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = []
    for row in rows:
        cells = [row.get(f.name) if isinstance(row, dict) else row[i] for i, f in enumerate(schema.fields)]
        records.append(
            tuple(
                str(v) if v is not None and isinstance(f.dataType, T.StringType) else v
                for v, f in zip(cells, schema.fields)
            )
        )
    return spark.createDataFrame(records, schema)


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per element of a column holding JSON arrays of objects."""
    require_columns(df, [column])
    keep = [c for c in df.columns if c != column]
    parsed = F.from_json(F.col(column), f"array<struct<{T.StructType.fromDDL(schema).simpleString()[7:-1]}>>")
    return df.select(*keep, F.explode(parsed).alias("__row")).select(*keep, "__row.*")


def json_rows_drift(df: DataFrame, column: str, schema: str, malformed: str = "malformed") -> DataFrame:
    """One row per element of a column holding JSON arrays of objects (or one object), whatever came in them.

    Fields of the schema are read one by one, so a field that is missing or of another kind is null
    and costs no other field; numbers and texts that convert are converted. Fields that the schema
    lacks are kept as VARIANT in `extra`, and `json_schema` tells what there is. A text that is no
    JSON, or an element that is no object, is a row with its text in `malformed`. Null gives no row.
    """
    require_columns(df, [column])
    keep = [c for c in df.columns if c != column]
    fields = T.StructType.fromDDL(schema).fields
    taken = {*(f.name for f in fields), "extra", malformed} & set(keep)
    if taken:
        raise SpecError(f"the table has columns {sorted(taken)} already")
    text = F.col(column)
    parsed = df.filter(text.isNotNull()).withColumn("__json", F.try_parse_json(text))
    # a text that is no array is one element
    many = F.try_variant_get("__json", "$", "array<variant>")
    elements = F.coalesce(many, F.array(F.col("__json")))
    rows = parsed.select(*keep, text.alias("__text"), F.explode(elements).alias("__e"))
    entries = F.try_variant_get("__e", "$", "map<string,variant>")
    rows = rows.select(*keep, "__text", "__e", entries.alias("__m"))
    extra = F.map_filter("__m", lambda k, v: ~k.isin([f.name for f in fields]))
    return rows.select(
        *keep,
        *[F.try_variant_get(F.try_element_at("__m", F.lit(f.name)), "$", f.dataType.simpleString()).alias(f.name) for f in fields],
        F.when(F.size(extra) > 0, extra).alias("extra"),
        F.when(F.col("__m").isNull(), F.coalesce(F.to_json("__e"), F.col("__text"))).alias(malformed),
    )


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """One row with the schema that covers all JSON texts of a column, found in one aggregation."""
    require_columns(df, [column])
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("schema"))


def load_variant(spark: SparkSession, root: str, table: str, variant: str, into: str | None = None) -> DataFrame:
    """The chosen variant of a table, kept as <root>/<variant>/<table>.

    With `into` it also replaces the table stored there.
    """
    df = read_table(spark, f"{root.rstrip('/')}/{variant}/{table}")
    if into is None:
        return df
    return overwrite(df, into)


def overwrite(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Replace the table at the path, and return what was written.

    A table cannot be replaced by a plan that reads it, or reads a folder above or below it;
    write that elsewhere. The rows are written beside the old table, which goes only when they
    are complete.
    """
    spark = df.sparkSession
    at = _qualified(spark, path)
    for root in _roots(df):
        if _inside(root, at) or _inside(at, root):
            raise SpecError(f"the plan reads {root}; write its result to another path than {path}")
    beside = f"{at}-new-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(beside)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (at, beside))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"the new table is complete at {beside} but could not be moved to {at}")
    return spark.read.parquet(path)


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that the pointer of a versioned table names; None for other folders."""
    pointer, files = _files(spark, f"{path.rstrip('/')}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return f"{path.rstrip('/')}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def write_version(df: DataFrame, path: str, partition_by=()) -> str:
    """Write the rows as a further version of a table, which nothing reads until it is made current."""
    name = f"version-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path.rstrip('/')}/{name}")
    return name


def make_current(spark: SparkSession, path: str, name: str) -> None:
    """Let the pointer name another version, by one atomic rename over the old pointer."""
    path = path.rstrip("/")
    beside, files = _files(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    whole = files.makeQualified(beside)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(whole, files.makeQualified(_files(spark, f"{path}/{POINTER}")[0]), over)


def replace_table(df: DataFrame, path: str, partition_by=(), keep: int = 1) -> DataFrame:
    """Replace a versioned table in one step, and return what was written.

    The rows are written as a version of their own; then the pointer is renamed over the old one.
    Whoever stops in between leaves the old table current and whole. A plan may read the table it
    replaces. Of the versions before, the last `keep` stay for readers that still use them.
    On stores whose rename isn't atomic (most object stores) this is only as safe as their rename.
    """
    spark = df.sparkSession
    before = current_version(spark, path)
    name = write_version(df, path, partition_by)
    make_current(spark, path, name)
    folder, files = _files(spark, path)
    old = [f for f in files.listStatus(folder) if f.getPath().getName().startswith("version-") and f.getPath().getName() != name]
    # the version just replaced is the newest of them, whenever it was written
    old.sort(key=lambda f: (f.getPath().getName() != (before or "").rpartition("/")[2], -f.getModificationTime()))
    for version in old[keep:]:
        files.delete(version.getPath(), True)
    return read_table(spark, path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, absolute and without a trailing slash."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _inside(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder + "/")


def _roots(df: DataFrame) -> list[str]:
    """The paths that the plan was asked to read, not the files found there."""
    out, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            paths = relation.location().rootPaths()
            out += [_qualified(df.sparkSession, paths.apply(j).toString()) for j in range(paths.length())]
    return out


def snapshot_once(df: DataFrame, path: str) -> DataFrame:
    """Keep a copy of the table at the path unless one exists already."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(target: DataFrame, changes: DataFrame, key, order_by=(), stamp: str | None = None) -> DataFrame:
    """The target with changed rows replaced and new rows added, by key.

    Of several changes to a key the last by `order_by` wins; without an order, a second change to a key
    fails when the plan runs. `stamp` names a column to set to the current time in the changed rows.
    Columns of the changes that the target lacks are refused, but for those that only order them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(target, keys)
    unknown = set(changes.columns) - set(target.columns) - set(order_by)
    if unknown:
        raise SpecError(f"the target has no columns {sorted(unknown)}")
    if order_by:
        changes = first_per_key(changes, keys, order_by, keep="last")
    else:
        again = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
        refused = F.raise_error(F.lit(f"several changes to one {keys}: name an order_by")).cast("boolean")
        changes = changes.withColumn("__again", F.when(again, refused).otherwise(False)).filter(~F.col("__again")).drop("__again")
    if stamp:
        changes = changes.withColumn(stamp, F.current_timestamp())
    replaced = changes.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    kept = target.join(replaced, on=same, how="left_anti")
    return kept.unionByName(changes.select(*[c for c in changes.columns if c in target.columns or c == stamp]), allowMissingColumns=True)


def write_upsert(target_path: str, changes: DataFrame, key, new_path: str, **how) -> DataFrame:
    """Write the upserted table to a new path; the old one stays as it was."""
    merged = upsert(changes.sparkSession.read.parquet(target_path), changes, key, **how)
    return overwrite(merged, new_path)


def upsert_partitions(path: str, changes: DataFrame, key, partition_by, order_by=(), stamp: str | None = None) -> DataFrame:
    """Upsert into a partitioned table in place, rewriting only the partitions that the changes touch.

    These are the partitions in which changed keys are now and those to which they go. Their rows are
    read by partition, merged, stored beside and put in place by dynamic partition overwrite;
    partitions that the changes leave empty are removed at the end. Files of other partitions stay
    as they are. Partitions are replaced one after the other: a run that dies in between is
    repeated with the same result. `order_by` and `stamp` are those of `upsert`.
    """
    spark, parts = changes.sparkSession, [partition_by] if isinstance(partition_by, str) else list(partition_by)
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(changes, [*keys, *parts])
    changes = materialize(changes)
    target = spark.read.parquet(path)
    require_columns(target, [*keys, *parts])

    def matched(left: DataFrame, right: DataFrame, columns) -> DataFrame:
        told = right.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
        return left.join(told, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], "left_semi")

    now = matched(target, changes, keys).select(*parts)
    touched = materialize(now.unionByName(changes.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in parts])).distinct())
    merged = materialize(upsert(matched(target, touched, parts), changes, keys, order_by, stamp).select(*target.columns))
    writer = merged.write.mode("overwrite").partitionBy(*parts).option("partitionOverwriteMode", "dynamic")
    if not merged.isEmpty():
        writer.parquet(path)
    left = touched.join(merged.select(*[F.col(c).alias(f"__{c}") for c in parts]).distinct(), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parts], "left_anti")
    emptied = matched(spark.read.schema(target.schema).parquet(path), left, parts)
    folders = emptied.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    _, files = _files(spark, path)
    for row in folders.toLocalIterator():  # partitions, not rows
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["folder"])), True)
    return spark.read.schema(target.schema).parquet(path)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors reach.

    Only a local session, all of whose tasks share one machine, gets a folder of its own if that is unset.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and not context.master.startswith("local["):
        raise SpecError("set spark.checkpoint.dir to a folder all executors share")
    if folder is None:
        folder = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="shared-")
        _own[context.applicationId] = folder
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Store an intermediate table in the shared folder and read it from there.

    The plan behind it runs once, however often the table is used, and a lost
    executor costs no recomputation of it.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
