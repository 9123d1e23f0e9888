"""Driver-table loader. Reads go through ``spark.read.parquet`` so column pruning and filter
pushdown reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Tables whose rows carry long texts: every operator on them is CPU-bound (regex, JSON, hashing).
TEXT_TABLES = ("documents", "pages", "conversations")
# A file of one row group is one task, whatever its size. Where the given files are like that, the
# caller of the session asks for a round-robin spread of the text tables over so many tasks.
SPREAD = "spark.critica.textPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; text tables are spread only where ``SPREAD`` is set."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df
