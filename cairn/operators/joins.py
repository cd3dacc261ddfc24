"""Joins and sieves that no single key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than its share of all rows, is hot.
HOT_ROWS, HOT_SHARE = 512, 50_000


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, total // HOT_SHARE)


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row a key, whose column ``count`` says how many of ``rows`` have it.

    Table rows of hot keys are broadcast: as each stands for more than ``total / HOT_SHARE`` of the ``total`` rows, there are
    fewer than ``HOT_SHARE`` of them at any size. The rest is joined by shuffle, and none of its keys has more rows than
    the limit. The columns are those of ``rows``, then those of ``table`` but key and count.
    """
    added = [c for c in table.columns if c not in (key, count)]
    limit = hot_limit(total)
    hot = F.broadcast(table.where(F.col(count) > limit).withColumn("hot_", F.lit(True)).select(key, "hot_", *added))
    met = rows.join(hot, key, "left")
    rest = met.where("hot_ is null").select(*rows.columns).join(table.where(F.col(count) <= limit).select(key, *added), key)
    return met.where("hot_").select(*rows.columns, *added).unionByName(rest.select(*rows.columns, *added))
