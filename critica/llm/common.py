"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critica.session import scratch_path

# The white space that separates words, and the word pattern.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back.

    This cuts the lineage: an executor lost later costs only its own tasks, and two branches
    read the same rows even where ``df`` is not deterministic."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda variable is a real variable, whereas a projected column may be inlined by the
    optimiser into a lambda and evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The ASCII-white-space separated words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column of the input has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


SALT = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` (a row per key, no clashing names) with each key's rows dealt to ``SALT`` tasks by a hash of ``by``."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")
    spread = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("__salt", salt).join(spread, [key, "__salt"], how).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


UPPER = bytes(range(65, 91))
TO_LOWER = bytes.maketrans(UPPER, UPPER.lower())
