"""Stripping: Python's str.strip, in time linear in the text."""

import time

from pyspark.sql import functions as F

from critica.functions.common import ustrip


def test_equal_to_python(spark):
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [None, "", " ", "a", "".join(blanks), "\r\n", "a \n", *(f"{b}{b}x{b}y{b}" for b in blanks), "​x​", "\x00 x \x00", " é 漢 😀 "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ustrip("t").alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: None if t is None else t.strip() for i, t in enumerate(texts)}


def test_blanks_inside_are_not_searched_again_and_again(spark):
    """300,000 blanks in the middle: a pattern reads them once from each of them, over 10**10 steps."""
    df = spark.range(1).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 300_000), F.lit("b ")).alias("t"))
    began = time.time()
    assert df.select(F.length(ustrip("t"))).first()[0] == 300_002
    assert time.time() - began < 10
