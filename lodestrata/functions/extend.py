"""Functions for SQL text: a table function and an aggregate, registered on a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class PrintableRuns:
    """printable_runs(text, least): (at, run) of each run of printable ASCII with at least ``least`` characters; null gives none."""

    def eval(self, text: str | None, least: int):
        import re

        for m in re.finditer(rf"[\x20-\x7e]{{{max(int(least), 1)},}}", text or ""):
            yield m.start(), m[0]


@F.pandas_udf(DoubleType())
def entropy_of_values(values: pd.Series) -> float:
    """Bits of the distribution of a group's values. A group reaches one call, so it is for groups of bounded size; see ``shannon_entropy`` for texts."""
    p = values.dropna().value_counts(normalize=True).to_numpy()
    return float(-(p * np.log2(p)).sum()) + 0.0 if len(p) else 0.0


def register(spark: SparkSession) -> None:
    spark.udtf.register("printable_runs", F.udtf(PrintableRuns, returnType="at int, run string"))
    spark.udf.register("entropy_of_values", entropy_of_values)
