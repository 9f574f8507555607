"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this are spread ...
HOT = 200_000
#: ... but never more keys than this, so their list, which is broadcast, has a bound.
MOST_HOT = 50_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, spread: tuple[str, ...], hot: int | None = None) -> DataFrame:
    """Inner join of `rows` (of which there are `total`) with `keyed`, one row a key, whose column `n` counts the key's rows.

    Hot keys are marked in the rows first, by a broadcast list of fewer than MOST_HOT keys (no more can have total / MOST_HOT
    rows each); their rows go to as many tasks as they have shares, by a hash of the columns `spread`. `n` is dropped.
    Neither `rows` nor `keyed` is broadcast, however small the optimizer takes them to be."""
    least = max(HOT if hot is None else hot, total // MOST_HOT)
    many = keyed.filter(F.col(n) > least)
    if not many.limit(1).count():
        return rows.join(keyed.drop(n).hint("merge"), key)
    parts = F.ceil(F.col(n) / least).cast("int")
    marked = rows.join(F.broadcast(many.select(key, parts.alias("__parts"))), key, "left")
    salted = marked.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    each = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return salted.join(each.hint("merge"), [key, "__salt"]).drop("__salt")
