"""Joins with one row a key that frequent keys do not hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: at most so many keys are broadcast: those with 1 / HOT of all rows or more
HOT = 10_000


def join_keyed(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left or left_semi) to ``table``, one row a key with ``size``, its number of rows.

    ``total`` is the number of rows or more. A key that holds total / HOT of them is frequent; there
    are HOT of these at most, so they are broadcast, and only the rows of other keys are shuffled.
    """
    least = max(2, -(-total // HOT))
    hot = F.broadcast(table.filter(F.col(size) >= least).drop(size))
    rare = rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col(size) < least).drop(size), keys, how)
    return rows.join(hot, keys, "left_semi" if how == "left_semi" else "inner").unionByName(rare)


def kept_rows(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, salt: list[str]) -> DataFrame:
    """The rows whose ``key`` is in ``table``; ``rows`` is computed once.

    A frequent key, as in ``join_keyed``, is dealt by the hash of the columns ``salt`` over as many groups as
    leave each with no more rows than the largest other key has; there are 2 * HOT such groups at most.
    """
    least = max(2, -(-total // HOT))
    groups = F.when(F.col(size) >= least, F.ceil(F.col(size) / F.lit(least)).cast("long")).otherwise(F.lit(1).cast("long"))
    hot = F.broadcast(table.filter(F.col(size) >= least).select(key, groups.alias("_groups")))
    dealt = F.pmod(F.xxhash64(*salt), F.coalesce("_groups", F.lit(1).cast("long"))).alias("_salt")
    wanted = table.select(key, F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("_salt"))
    return rows.join(hot, key, "left").select(*rows.columns, dealt).join(wanted, [key, "_salt"], "left_semi").select(*rows.columns)
