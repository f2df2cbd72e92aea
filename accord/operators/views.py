"""Views of collections: modified since, feed windows, component kinds, guards; catalogues as schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accord.functions.text import component_kind

#: The catalogue's kinds and their column types. Durations and JSON stay text.
KINDS = {
    "string": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType(), "datetime": T.TimestampType(), "duration": T.StringType(),
    "bytes": T.BinaryType(), "stringlist": T.ArrayType(T.StringType()), "json": T.StringType(),
}


def modified_since(records: DataFrame, since: Column, inclusive: bool = True) -> DataFrame:
    """Records modified at (files) or only after (feeds, inclusive=False) the time; a null time gives all."""
    later = F.col("last_modified") >= since if inclusive else F.col("last_modified") > since
    return records.where(since.isNull() | later)


def feed_window(records: DataFrame, today: Column, column: str = "start") -> DataFrame:
    """Records that start from a year before today to two years after it."""
    day = F.col(column).cast("date")
    return records.where(day.between(F.add_months(today, -12), F.add_months(today, 24)))


def demux(records: DataFrame, kinds: list[str]) -> DataFrame:
    """Calendar records (column data) of the given component kinds, with column kind; unknown kinds are in no view."""
    return records.withColumn("kind", component_kind(F.col("data"))).where(F.col("kind").isin(*kinds))


def catalogue_schema(rows: list[tuple[str, str, bool]]) -> T.StructType:
    """A schema from a catalogue of (property, kind, optional)."""
    return T.StructType([T.StructField(name, KINDS[kind.lower()], optional) for name, kind, optional in rows])


def emptied(before: Column, after: Column) -> Column:
    """Whether a record that held something came out empty."""
    return (F.coalesce(F.octet_length(before), F.lit(0)) > 0) & (F.coalesce(F.octet_length(after), F.lit(0)) == 0)


def failed_by_emptying(records: DataFrame) -> DataFrame:
    """mapping_id, failed: a mapping fails if any of its records (before, after) was emptied."""
    return records.groupBy("mapping_id").agg(F.bool_or(emptied(F.col("before"), F.col("after"))).alias("failed"))
