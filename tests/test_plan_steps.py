"""Steps of long texts: repeats go in one sort, not by a look through all for each."""

import time

from pyspark.sql import functions as F

from mnemospark.operators import plans


def test_repeats_go_whatever_their_case(spark):
    got = spark.createDataFrame([(["  One  two", "b", "ONE TWO", "three", None, "Three ", "zero"],), (None,), ([],)], "s array<string>").select(plans.normal_steps(F.col("s"))).collect()
    assert [r[0] for r in got] == [["One two", "three", "zero"], None, []]


def test_long_texts_take_no_squares(spark):
    frame = spark.range(4).select(F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda i: F.concat(F.lit("Step number "), (i % 4000).cast("string"))).alias("s"))
    start = time.time()
    assert [r[0] for r in frame.select(F.size(plans.normal_steps(F.col("s")))).collect()] == [4000] * 4
    assert time.time() - start < 60
