"""Joins that survive one key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one in so many rows; by counting there are fewer heavy keys than this.
HEAVY_PART = 1000


def heavy_split_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, count_col: str = "n_rows", how: str = "inner") -> DataFrame:
    """Inner or left join of `big` with `small`, which has at most one row a key.

    `counts` has the rows of `big` by key (it is already aggregated by the caller). Keys with more than a
    thousandth of all rows are joined by broadcast: there are fewer than HEAVY_PART of them whatever the data,
    so the broadcast side is bounded. All other keys are joined by shuffle, where no key is heavy any more."""
    total = counts.agg(F.sum(count_col).alias("_total"))
    heavy = counts.crossJoin(F.broadcast(total)).filter((F.col(count_col) > 1) & (F.col(count_col) * HEAVY_PART > F.col("_total"))).select(*keys)
    heavy_small = small.join(F.broadcast(heavy), keys, "left_semi")
    hot = big if how == "inner" else big.join(F.broadcast(heavy), keys, "left_semi")
    by_broadcast = hot.join(F.broadcast(heavy_small), keys, how)
    rest = big.join(F.broadcast(heavy), keys, "left_anti").join(small.hint("merge"), keys, how)
    return by_broadcast.unionByName(rest)


def hub_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """heavy_split_join on one key whose rows are counted here (gathered on the map side first). Rows with a null key
    have no partner. `big` stands in the plan four times: cut it first (cut_table) if it is itself such a join."""
    counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return heavy_split_join(big, small, [key], counts, how=how)
