"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No key counts as hot with fewer rows than this.
HOT_FLOOR = 20_000
#: At most so many keys can be hot.
HOT_MAX = 5_000


def hot_at(n_rows: int) -> int:
    """Rows from which a key is hot. Rows are shared out among keys, so at most HOT_MAX keys reach this."""
    return max(HOT_FLOOR, -(-n_rows // HOT_MAX))


def lookup(facts: DataFrame, keys: list[str], table: DataFrame, weight: str, n_rows: int) -> DataFrame:
    """facts inner-joined with table, which has one row for each value of keys and, in weight, its number of facts.

    Keys with at least hot_at(n_rows) facts (no more than HOT_MAX by counting) are sent to all tasks, so their facts
    are never brought together; all other keys go through a hash-partitioned join. weight is dropped.
    """
    limit = hot_at(n_rows)
    hot = F.broadcast(table.where(F.col(weight) >= limit).drop(weight))
    cold = table.where(F.col(weight) < limit).drop(weight)
    spread = facts.join(hot, keys, "inner")
    rest = facts.join(F.broadcast(table.where(F.col(weight) >= limit).select(*keys)), keys, "left_anti")
    return spread.unionByName(rest.join(cold.hint("shuffle_hash"), keys, "inner"))
