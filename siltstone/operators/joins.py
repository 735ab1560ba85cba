"""Joins whose keys many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than a HOT-th of all rows have it, and over LEAST; a table of up to SMALL rows goes to all tasks.
HOT, LEAST, SMALL = 4096, 4096, 100_000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], often: str = "often") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``often`` how many of the rows have it.

    A small table is broadcast; of a larger one the hot keys, fewer than HOT
    whatever the size, are, and the others are joined by hash.
    """
    keys, total = table.agg(F.count(F.lit(1)), F.sum(often)).first()
    if keys <= SMALL:
        return rows.join(F.broadcast(table.drop(often)), on)
    is_hot = F.col(often) > max((total or 0) // HOT, LEAST)
    hot = F.broadcast(table.where(is_hot).drop(often))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(table.where(~is_hot).drop(often).hint("merge"), on))


def join_by(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key; rows are counted by key only where the table is too large to broadcast."""
    if table.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(table), on)
    often = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("often"))
    return join_counted(rows, table.join(often, on), on)
