"""Table-to-table operators. Each takes a DataFrame and returns a lazy one."""
from .columns import coalesce_columns, copy_column, derive_column, map_values, rename_columns
from .dedupe import first_per_key, remove_duplicates
from .nulls import exact_median, fill_nulls, fix_nulls
from .ordered import forward_fill, running_sum
from .outliers import remove_outliers
from .recipe import OPERATIONS, clean, clean_or_keep, clean_with_report, parse_operations
from .types import fix_dtypes, fix_unix_ms, normalize_strings

__all__ = [
    "OPERATIONS",
    "clean",
    "clean_or_keep",
    "clean_with_report",
    "coalesce_columns",
    "copy_column",
    "derive_column",
    "exact_median",
    "fill_nulls",
    "first_per_key",
    "fix_dtypes",
    "fix_nulls",
    "fix_unix_ms",
    "forward_fill",
    "map_values",
    "normalize_strings",
    "parse_operations",
    "remove_duplicates",
    "remove_outliers",
    "rename_columns",
    "running_sum",
]
