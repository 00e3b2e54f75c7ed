"""Bounded samples of rows that hang on the rows alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def hash_sample(df: DataFrame, by: list[str | Column], n: int, seed: int) -> DataFrame:
    """About the `n` rows of `df` whose hashes are lowest, never more; all, if there are no more.

    A count says how low a hash must be, so that the rows that meet to be ordered are few more than
    n in all, and not n from each task. Rows with equal hashes are alike in `by`, so which of them
    stays doesn't matter to it.
    """
    total = df.count()
    share = min(1.0, (n + 4 * math.sqrt(n) + 16) / max(1, total))
    low = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(_RANGE))
    return df.withColumn("__h", low).where(F.col("__h") < math.ceil(share * _RANGE)).orderBy("__h", *by).limit(n).drop("__h")
