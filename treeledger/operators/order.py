"""Order-dependent operators without a global sort: positions of lines, and values carried from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in a stretch of the source that one window handles.
STRETCH = 1 << 20


def read_ordered(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """row_index (from 1) and value of each line of one file, in parallel.

    A split's lines are read in order by one task, so their ids differ from its first line's by their place in it; the
    splits' sizes, one row each, give the places of their first lines.
    """
    raw = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.select("_split", "_first", before.alias("_before")), "_split").select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("row_index"), "value")


def carry_forward(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the last non-null value at or before each row, in the order of row_index.

    Rows are dealt into stretches; the last value of each stretch, one row for a million, is carried over first.
    """
    dealt = rows.withColumns({"_stretch": F.floor(F.col("row_index") / STRETCH), "_value": value})
    last = dealt.groupBy("_stretch").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("row_index"))).alias("_last"))
    carried = last.select("_stretch", F.last("_last", True).over(W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    here = F.last("_value", True).over(W.partitionBy("_stretch").orderBy("row_index").rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(carried, "_stretch").withColumn(name, F.coalesce(here, "_carried")).drop("_stretch", "_value", "_carried")
