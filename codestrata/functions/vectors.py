"""Vector expressions on array columns."""
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import text
from .binding import let

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    return let(norm(v), lambda length: F.transform(v, lambda x: x.cast("double") / length))


def hashed_counts(value: Column, dimensions: int = DIMENSIONS) -> Column:
    """Feature-hash the word parts of a text into a count vector inside the row, so no shuffle is needed; null for null.

    A part's bucket comes from the first 32 bits of its digest.
    """
    def buckets(parts: list[bytes]) -> list[int]:
        return [int.from_bytes(md5(part).digest()[:4], "big") % dimensions for part in parts]

    def counts(texts: pd.Series) -> pd.Series:
        known = text.RunValues(buckets)

        def vector(said: str) -> np.ndarray:
            total = [0.0] * dimensions
            for run, n in text.runs(said.encode()).items():
                for bucket in known[run]:
                    total[bucket] += n
            return np.array(total)
        return pd.Series([None if said is None else vector(said) for said in texts], dtype=object)
    # A filter on the vectors would count every text a second time below it, if it could be moved there.
    return F.pandas_udf(counts, ArrayType(DoubleType())).asNondeterministic()(value)


def vector_problem(v: Column, dimensions: int) -> Column:
    """Name of the first defect of a vector, null when it is usable."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.when(v.isNull() | (F.size(v) != dimensions), "dimension")
            .when(~finite, "not_finite").when(norm(v) == 0, "zero"))
