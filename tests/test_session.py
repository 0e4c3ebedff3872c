"""What a session is given."""

import pandas as pd
from pyspark.sql import functions as F

from tidewell.session import BATCH, bound_batches


def test_batches_for_python_are_bounded_in_bytes(spark):
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64MB")
    bound_batches(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    most = rows.select(size("t").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < most <= 2 * BATCH
    spark.conf.set(name, "1MB")
    bound_batches(spark)
    assert spark.conf.get(name) == "1MB"
    spark.conf.unset(name)
