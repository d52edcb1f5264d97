"""The snapshot relation: twelve text columns and the place of each row in its source."""

from __future__ import annotations

from pyspark.sql import types as T

COLUMNS = ("record", "directory", "permissions", "links", "owner", "group", "size_or_device", "month", "day", "time_or_year", "name", "total")
RECORDS = ("directory", "total", "total_bytes", "entry", "ls_error", "unparsed")
SNAPSHOT = T.StructType([T.StructField("row_index", T.LongType()), *(T.StructField(c, T.StringType()) for c in COLUMNS)])

#: Limits in bytes, and the largest unsigned 64-bit integer.
FIND_FIELD, FIND_RECORD, TEXT_LINE = 64 << 10, 256 << 10, 256 << 10
U64_MAX = 2**64 - 1
U64 = T.DecimalType(20, 0)
WIDE = T.DecimalType(38, 0)

#: The counters of a directory, a path group or everything, by the names that the queries and their SQL share.
COUNTERS = (
    "old_files", "new_files", "old_dirs", "new_dirs", "old_links", "new_links", "old_bytes", "new_bytes", "old_blocks", "new_blocks",
    "added", "removed", "resized", "mtime_only", "attrs_only", "added_bytes", "removed_bytes", "grown_bytes", "shrunk_bytes",
)


class SnapshotError(ValueError):
    """A snapshot that can't be read as one, or options that don't fit together."""
