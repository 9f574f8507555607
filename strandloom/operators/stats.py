"""Coverage, length statistics and filters over node tables.

Node tables have node_id BIGINT, length BIGINT (in k-mers) and cov BIGINT (k-mer
occurrences, summed over libraries). Densities that decide filters use integer
division, estimates use doubles. Nulls in length count as nought; a node without
length has no density and never passes a `below` test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running_total


def density(cov: str = "cov", length: str = "length") -> Column:
    return F.when(F.col(length) > 0, F.col(cov) / F.col(length))


def whole_density(cov: str = "cov", length: str = "length") -> Column:
    """Integer division, as the coverage filters use it."""
    return F.when(F.col(length) > 0, F.expr(f"{cov} div {length}"))


def _first_reaching(df: DataFrame, weight: str, order: Sequence, result: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: `result` of the first row whose running weight reaches half the total (integer half)."""
    totals = df.groupBy(*by).agg(F.sum(weight).alias("__t"))
    run = running_total(df, F.col(weight), order, "__r", by)
    if by:
        run = run.alias("r").join(totals.alias("t"), [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]).select("r.*", "t.__t")
    else:
        run = run.crossJoin(totals)  # one row
    hit = run.filter(F.expr("__r >= __t div 2"))
    return hit.groupBy(*by).agg(F.min_by(result, "__r").alias(result)).filter(F.col(result).isNotNull())


def weighted_median_coverage(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Length-weighted median density: the first node, by density, at which half the length is reached.

    Nodes without length are last and carry no weight. No nodes: no row."""
    rows = nodes.filter("length > 0 and cov is not null").withColumn("density", density())
    return _first_reaching(rows, "length", ["density", "length", "node_id"], "density", by).withColumnRenamed("density", "median_coverage")


def n50(lengths: DataFrame, length: str = "length", descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """N50 with ascending accumulation (or descending): first length at which half the total is reached."""
    col = F.col(length)
    rows = lengths.filter(col.isNotNull()).select(*by, col.alias("n50"), F.monotonically_increasing_id().alias("__tie"))
    order = [F.col("n50").desc() if descending else F.col("n50").asc(), "__tie"]
    return _first_reaching(rows, "n50", order, "n50", by)


def summary(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """nodes, longest, total_length."""
    return nodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"), F.max("length").alias("longest"), F.sum("length").alias("total_length")
    )


def low_coverage(nodes: DataFrame, cutoff: float, spared: DataFrame | None = None) -> DataFrame:
    """Nodes whose whole density lies below `cutoff`, but for the node ids in `spared`. Negative cutoff: none."""
    low = nodes.filter(whole_density() < cutoff) if cutoff >= 0 else nodes.limit(0)
    return low if spared is None else low.join(spared.select("node_id").distinct(), "node_id", "left_anti")


def high_coverage(nodes: DataFrame, most: float) -> DataFrame:
    """Nodes whose whole density lies above `most`. Negative limit: none."""
    return nodes.filter(whole_density() > most) if most >= 0 else nodes.limit(0)


def without(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    return nodes.join(removed.select("node_id").distinct(), "node_id", "left_anti")


def low_arcs(arcs: DataFrame, cutoff: int) -> DataFrame:
    """Arcs kept: multiplicity above the cutoff."""
    return arcs.filter(F.col("mult") > cutoff)


def arc_counts(arcs: DataFrame) -> DataFrame:
    """node_id (signed) with arc_count (a hairpin counts twice), simple_arc_count and out_mult.

    Both strands: an arc a to b is also one from -b to -a."""
    both = both_strands(arcs)
    return both.groupBy(F.col("src").alias("node_id")).agg(
        F.sum(F.when(F.col("src") == -F.col("dst"), 2).otherwise(1)).cast("bigint").alias("arc_count"),
        F.count(F.lit(1)).alias("simple_arc_count"),
        F.sum("mult").alias("out_mult"),
    )


def canonical_arcs(arcs: DataFrame) -> DataFrame:
    """One row for an arc and its twin: src, dst, mult summed. Ends null or 0 are no arcs; null mult is nought."""
    rows = arcs.filter("src is not null and dst is not null and src <> 0 and dst <> 0")
    twin = (F.abs("dst") < F.abs("src")) | ((F.abs("dst") == F.abs("src")) & (F.col("src") < 0) & (F.col("dst") < 0))
    return (
        rows.select(
            F.when(twin, -F.col("dst")).otherwise(F.col("src")).alias("src"),
            F.when(twin, -F.col("src")).otherwise(F.col("dst")).alias("dst"),
            F.coalesce("mult", F.lit(0)).alias("mult"),
        )
        .groupBy("src", "dst")
        .agg(F.sum("mult").alias("mult"))
    )


def both_strands(arcs: DataFrame) -> DataFrame:
    """Each canonical arc and its twin; a hairpin, its own twin, once."""
    pair = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")),
    )
    ends = F.when(F.col("src") == -F.col("dst"), F.slice(pair, 1, 1)).otherwise(pair)
    return arcs.select(F.explode(ends).alias("x"), "mult").select("x.src", "x.dst", "mult")


def histogram(nodes: DataFrame, width: float, cov: Column, by: Sequence[str] = ()) -> DataFrame:
    """Length in each coverage bin of the given width: bin (lower bound), length."""
    return (
        nodes.filter(F.col("length") > 0)
        .withColumn("bin", F.floor(cov / width).cast("bigint"))
        .groupBy(*by, "bin")
        .agg(F.sum("length").alias("length"))
    )


def smoothed(bins: DataFrame, half: int, by: Sequence[str] = ()) -> DataFrame:
    """Centred moving average over `half` bins to each side, absent bins counting as nought."""
    span = bins.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    every = span.select(*by, F.explode(F.sequence("lo", "hi")).alias("bin"))
    full = every.join(bins, [*by, "bin"], "left").fillna(0, ["length"])
    w = W.partitionBy(*by).orderBy("bin").rowsBetween(-half, half)
    return full.withColumn("smooth", F.sum("length").over(w) / (2 * half + 1))


def peaks(bins: DataFrame, noise_ratio: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Local maxima after the first valley, at least the highest of them / noise_ratio: bin, length, place (1 = rightmost).

    `bins` has one row for each bin; absent bins count as nought. Bins are a bounded
    domain (coverage up to a few thousand), so a window over one group's bins is small."""
    full = smoothed(bins, 0, by)
    w = W.partitionBy(*by).orderBy("bin")
    near = full.withColumn("prev", F.coalesce(F.lag("length").over(w), F.lit(0))).withColumn("next", F.coalesce(F.lead("length").over(w), F.lit(0)))
    rising = near.filter("length < next").groupBy(*by).agg(F.min("bin").alias("valley"))
    after = near.join(rising, list(by)) if by else near.crossJoin(rising)
    tops = after.filter("bin >= valley and length > prev and length > next")
    highest = W.partitionBy(*by)
    kept = tops.withColumn("most", F.max("length").over(highest)).filter(F.col("length") * noise_ratio >= F.col("most"))
    return kept.select(*by, "bin", "length", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("bin"))).alias("place"))


def low_coverage_intervals(markers: DataFrame, cutoff: int) -> DataFrame:
    """Sweep: stretches of a node where fewer than `cutoff` markers lie: node_id, start, stop.

    `markers` has node_id, start, stop (exclusive), and nodes' own span as rows with weight 0."""
    ends = markers.select(
        "node_id", F.explode(F.array(
            F.struct(F.col("start").alias("at"), F.coalesce("weight", F.lit(1)).alias("step")),
            F.struct(F.col("stop").alias("at"), (-F.coalesce("weight", F.lit(1))).alias("step")),
        )).alias("e"),
    ).select("node_id", "e.at", "e.step").groupBy("node_id", "at").agg(F.sum("step").alias("step"))
    w = W.partitionBy("node_id").orderBy("at")
    depth = ends.withColumn("depth", F.sum("step").over(w)).withColumn("next", F.lead("at").over(w)).filter("next is not null")
    low = depth.withColumn("low", F.col("depth") < cutoff).withColumn("edge", F.when(F.col("low") & ~F.coalesce(F.lag("low").over(w), F.lit(False)), 1).otherwise(0))
    runs = low.withColumn("run", F.sum("edge").over(w)).filter("low")
    return runs.groupBy("node_id", "run").agg(F.min("at").alias("start"), F.max("next").alias("stop")).drop("run")


def unique_node(expected: float, plus: bool = True) -> Column:
    """Uniqueness log-odds above 5 for nodes longer than 50. `plus` tells the sign of ln2/2
    (the metagenome variant subtracts it)."""
    half = 0.34657359027997264  # ln(2)/2
    d = F.col("cov") / F.col("length")
    odds = F.lit(half if plus else -half) + F.col("length") / F.lit(2.0 * expected) * (F.lit(expected * expected) - d * d / 2)
    return F.when(F.col("length") > 50, odds > 5).otherwise(False)
