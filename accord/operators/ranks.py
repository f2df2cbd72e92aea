"""Places and running sums within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accord.sources.shared import written


def numbered(rows: DataFrame, key: str, order: list[str], running: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """rows with pos, their place from 0 within key in the given order (nulls first), and n, the rows of that key.

    running: name -> (aggregate, column): what the aggregate ('sum' or 'bit_xor') gives over the key's rows up to
    this one. Rows are dealt by ranges of key and order, so a key of any size is cut over many tasks; each task
    numbers its own rows, and what the tasks before it hold of the same key is added (a row for each
    task and key). Rows that are equal in key and order are ranked by their place in a written table,
    so that a task that runs again ranks them alike. key must not be null.
    """
    running = running or {}
    table = written(rows)
    tied = table.select(*table.columns, F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("__tie"))
    by = [F.col(key), *(F.col(c).asc_nulls_first() for c in order), F.col("__tie")]
    inside = Window.partitionBy("__part", key).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    of = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    # within a task monotonically_increasing_id counts up; what stands before the 33 low bits is the task's own
    dealt = tied.repartitionByRange(*by).sortWithinPartitions(*by).select(*table.columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
    dealt = written(dealt)
    spans = dealt.groupBy("__part", key).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"), *(of[f][0](c).alias(f"__{name}") for name, (f, c) in running.items()))
    spans = written(spans)
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    starts = spans.select("__part", key, "__first", F.coalesce(F.sum("__n").over(before), nothing).alias("__before"), F.sum("__n").over(Window.partitionBy(key)).alias("n"), *(F.coalesce(of[f][0](f"__{name}").over(before), nothing).alias(f"__{name}") for name, (f, _) in running.items()))
    met = dealt.join(written(starts), ["__part", key])
    sums = [of[f][1](F.col(f"__{name}"), of[f][0](c).over(inside)).alias(name) for name, (f, c) in running.items()]
    return met.select(*table.columns, (F.col("__before") + F.col("__row") - F.col("__first")).alias("pos"), "n", *sums)
