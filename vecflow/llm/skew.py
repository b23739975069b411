"""Joins on keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more rows than this are joined by broadcast,
HOT = 512
#: or of more than a part of all rows so large that there are no more such keys than this.
MOST = 500_000


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, rows: int, how: str = "inner") -> DataFrame:
    """left join right on key, an inner or left join. right has a key once, with the number of left's rows
    that have it in the column size; rows is left's number of rows, or more. Rows of hot keys stay
    where they are and the keys are broadcast: as each has more than rows / MOST rows, they are fewer
    than MOST. All other rows are shuffled."""
    least = max(HOT, -(-rows // MOST))
    hot = right.filter(F.col(size) > least)
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    some = left.join(F.broadcast(hot), key).select(*columns)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(size) <= least), key, how).select(*columns)
    return some.unionByName(rest)
