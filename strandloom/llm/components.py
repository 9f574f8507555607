"""One group identifier for all records linked directly or over others.

Method: hash-to-min. Every vertex holds a cluster set, at first itself and its
neighbours. In each round it sends the set to the set's smallest member, and that
member to all others; equal rows merge. At the end the smallest vertex of a
component holds the whole component and every other one just that smallest vertex,
after about log(diameter) rounds. Cluster sets are rows (holder, member), never
arrays, so the set of a giant component is spread over partitions; rows of holders
with large sets are salted before they are joined with the holder's minimum.

Each round is written to the shared folder and read back, which cuts the lineage;
the round's count and checksum tell when nothing changes any more.
Null or missing ends are no links; self links and repeated links are allowed.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

#: Cluster sets above this many rows are salted in the join with their minimum ...
HOT = 200_000
#: ... but never more holders than this, so their list, which is broadcast, has a bound.
MOST_HOT = 50_000


def _with_minimum(rows: DataFrame, total: int) -> tuple[DataFrame, str]:
    """Each of the `total` rows (v, u) with m, the smallest member that v holds; and the path of the minima's table.

    Hot holders are marked before the join, so their rows meet the minimum in as many tasks as they have HOT rows."""
    mins, path = materialize(rows.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), "minima")
    least = max(HOT, total // MOST_HOT)
    hot = mins.filter(F.col("n") > least)
    if not hot.limit(1).count():
        return rows.join(mins.select("v", "m"), "v"), path
    parts = F.ceil(F.col("n") / least).cast("int")
    # fewer than MOST_HOT holders can have more than total / MOST_HOT rows
    marked = rows.join(F.broadcast(hot.select("v", parts.alias("parts"))), "v", "left")
    salted = marked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"), F.lit(0)))
    spread = mins.select("v", "m", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("salt"))
    return salted.join(spread, ["v", "salt"]).select("v", "u", "m"), path


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, group_id for every node of `links` (columns a, b: BIGINT, both not null)."""
    spark = links.sparkSession
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).dropna()
    first = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")),
        F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")),
    )).alias("x")).select("x.*").distinct()
    rows, path = materialize(first, "links")
    total, sign = rows.count(), None
    for _ in range(most_rounds):
        held, minima = _with_minimum(rows, total)
        sent = held.select(F.explode(F.array(
            F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
        )).alias("x")).select("x.*").distinct()
        after, new = materialize(sent, "round")
        discard(spark, path)
        discard(spark, minima)
        rows, path = after, new
        now = tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == sign:
            return rows.groupBy("v").agg(F.min("u").alias("group_id")).select(F.col("v").alias("node"), "group_id")
        total, sign = now[0], now
    raise RuntimeError(f"no stable groups after {most_rounds} rounds")
