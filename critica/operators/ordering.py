"""Row numbers inside groups of any size.

A window over a group that holds a third of all rows is one task. Here the rows are range-partitioned
and sorted by (group, order), stored, counted per (group, partition), and each row's position inside its
partition is added to the group's rows in earlier partitions. No task sees more than a partition."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critica.session import scratch_path, stored

BROADCAST_FILES = 100_000


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3... in ``order`` inside each ``group`` (null groups count as a group)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "numbered")
    (df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
     .withColumn("__at", F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), "__first",
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out_row = (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("bigint")
    return rows.join(starts, same).select(*df.columns, out_row.alias(out))


def with_position(df: DataFrame, out: str = "position") -> DataFrame:
    """A table read from files with ``out``: 0, 1, 2... in file order (files by path, rows as they stand in them).

    Nothing is sorted or shuffled: a row's place is its row index in the file (for formats without one, its place in
    the file's split) plus the rows of the files (splits) before, of which there is one row each."""
    path = F.col("_metadata.file_path").alias("__path")
    try:
        rows = df.select("*", path, F.lit(0).cast("long").alias("__split"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:  # no row index in this format: ids rise along each split
        rows = stored(df.select("*", path, F.col("_metadata.file_block_start").alias("__split"),
                                F.monotonically_increasing_id().alias("__at")), "positions")
    counts = rows.groupBy("__path", "__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__path", "__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "starts")
    few = starts if starts.count() > BROADCAST_FILES else F.broadcast(starts)
    return rows.join(few, ["__path", "__split"]).select(
        *df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).cast("long").alias(out))
