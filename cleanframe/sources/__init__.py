"""Reading and writing tables."""
from .tables import (
    current_version,
    from_rows,
    json_rows,
    json_rows_drift,
    json_schema,
    load_variant,
    materialize,
    overwrite,
    read_jdbc,
    read_table,
    replace_table,
    snapshot_once,
    upsert,
    upsert_partitions,
    utc,
    write_jdbc,
    write_upsert,
)

__all__ = [
    "current_version",
    "from_rows",
    "json_rows",
    "json_rows_drift",
    "json_schema",
    "load_variant",
    "materialize",
    "overwrite",
    "read_jdbc",
    "read_table",
    "replace_table",
    "snapshot_once",
    "upsert",
    "upsert_partitions",
    "utc",
    "write_jdbc",
    "write_upsert",
]
