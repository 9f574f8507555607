"""Metagenomes: coverage levels, chimera tests and repeat splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .ordered import numbered
from .stats import both_strands, canonical_arcs, histogram, peaks


def coverage_peaks(nodes: DataFrame, width: float = 1.0, noise_ratio: float = 10.0) -> DataFrame:
    """place, coverage, length of the coverage levels, highest coverage first."""
    found = peaks(histogram(nodes, width, F.col("cov") / F.col("length")), noise_ratio)
    return found.select("place", (F.col("bin") * width).alias("coverage"), "length")


#: Histograms for the mixture have at most so many bins.
LAST_BIN = 10_000


def poisson_mixture(bins: list[tuple[int, int]], classes: int, rounds: int = 200) -> list[tuple[float, float]]:
    """EM over a coverage histogram (bounded, on the driver): (mean, weight), peaks nearer than 4 or lighter than 0.01 merged."""
    x = np.array([b for b, _ in bins], float)
    n = np.array([c for _, c in bins], float)
    if not len(x) or not n.sum():
        return []
    cum = np.cumsum(n) / n.sum()
    mean = np.array([max(x[np.searchsorted(cum, (i + 0.5) / classes)], 0.5) for i in range(classes)])
    weight = np.full(classes, 1 / classes)
    sums = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(x.max()) + 1)))])
    logf = sums[x.astype(int)]
    for _ in range(rounds):
        log = np.log(weight) + np.outer(x, np.log(mean)) - mean - logf[:, None]
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mass = (p * n[:, None]).sum(0) + 1e-12
        new = np.maximum((p * n[:, None] * x[:, None]).sum(0) / mass, 1e-3)
        weight = mass / mass.sum()
        if np.abs(new - mean).max() < 1e-6:
            mean = new
            break
        mean = new
    out: list[list[float]] = []
    for m, w in sorted(zip(mean, weight, strict=True)):
        if w < 0.01:
            continue
        if out and m - out[-1][0] < 4:
            a, b = out[-1]
            out[-1] = [(a * b + m * w) / (b + w), b + w]
        else:
            out.append([m, w])
    return [(float(a), float(b)) for a, b in reversed(out)]


def nearest_peak(density: Column, levels: list[float]) -> Column:
    """The level nearest to a density; ties to the first."""
    array = F.array(*[F.struct(F.abs(density - F.lit(float(v))).alias("d"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(levels)])
    return F.array_min(array)["v"]


def chimera(parts: DataFrame, primary: float, secondary: float, rate: float = 0.0) -> DataFrame:
    """For parts(group_id, length, cov): share of length nearer to each level, chimeric when both exceed the rate."""
    d = F.col("cov") / F.col("length")
    near = F.abs(d - primary) <= F.abs(d - secondary)
    sums = parts.filter("length > 0").groupBy("group_id").agg(
        F.sum("length").alias("length"), F.sum(F.when(near, F.col("length")).otherwise(0)).alias("p"), F.sum(F.when(near, 0).otherwise(F.col("length"))).alias("s")
    )
    a, b = F.col("p") / F.col("length"), F.col("s") / F.col("length")
    return sums.select("group_id", "length", a.alias("primary_share"), b.alias("secondary_share"), ((a > rate) & (b > rate)).alias("chimeric"), (a >= b).alias("is_primary"))


def _linked(conns: DataFrame) -> DataFrame:
    """src, dst, links: counted links of signed nodes, both strands of canonical connections."""
    n = (F.coalesce("paired", F.lit(0)) + F.coalesce("direct", F.lit(0))).alias("links")
    rows = conns.select("src", "dst", n)
    return rows.unionByName(rows.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"), "links")).groupBy("src", "dst").agg(F.max("links").alias("links"))


def consistent(rows: DataFrame, conns: DataFrame, valid: int = 1, noise: int = 0) -> DataFrame:
    """Adds `linked`: entry and exit of each path share at least `valid` links, those of different paths at most `noise`."""
    links = _linked(conns)
    for name, a, b in (("pp", "in_primary", "out_primary"), ("ss", "in_secondary", "out_secondary"), ("ps", "in_primary", "out_secondary"), ("sp", "in_secondary", "out_primary")):
        rows = rows.join(links.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("links").alias(name)), [a, b], "left").fillna(0, [name])
    ok = (F.col("pp") >= valid) & (F.col("ss") >= valid) & (F.col("ps") <= noise) & (F.col("sp") <= noise)
    return rows.withColumn("linked", ok).drop("pp", "ss", "ps", "sp")


def repeat_splits(nodes: DataFrame, arcs: DataFrame, levels: list[float], sd: float = 0.1, least: int = 0) -> DataFrame:
    """Statistics and decision for each node with two ways in and two out: node_id, densities, levels, split.

    Split when neighbours are at least `least` long, the denser entry and exit share a level, so do the
    thinner ones, the levels differ, and the node's density lies within sd of the mean of both totals."""
    both = both_strands(arcs)
    info = nodes.filter("length > 0").select(F.col("node_id").alias("i"), F.col("length").alias("l"), (F.col("cov") / F.col("length")).alias("d"))
    outs = both.join(info, F.abs("dst") == F.col("i")).groupBy(F.col("src").alias("n")).agg(
        F.countDistinct("dst").alias("o"), F.max("d").alias("out_hi"), F.min("d").alias("out_lo"), F.min("l").alias("out_len"), F.max_by("dst", F.struct("d", "dst")).alias("out_primary"), F.min_by("dst", F.struct("d", "dst")).alias("out_secondary")
    )
    ins = both.join(info, F.abs("src") == F.col("i")).groupBy(F.col("dst").alias("n")).agg(
        F.countDistinct("src").alias("i_n"), F.max("d").alias("in_hi"), F.min("d").alias("in_lo"), F.min("l").alias("in_len"), F.max_by("src", F.struct("d", "src")).alias("in_primary"), F.min_by("src", F.struct("d", "src")).alias("in_secondary")
    )
    rows = outs.filter("o = 2 and n > 0").join(ins.filter("i_n = 2"), "n").join(info, F.col("n") == F.col("i"))
    level = {c: nearest_peak(F.col(c), levels) for c in ("in_hi", "in_lo", "out_hi", "out_lo")}
    mean = (F.col("in_hi") + F.col("in_lo") + F.col("out_hi") + F.col("out_lo")) / 2
    ok = (
        (F.least("in_len", "out_len") >= least) & (level["in_hi"] == level["out_hi"]) & (level["in_lo"] == level["out_lo"]) & (level["in_hi"] != level["in_lo"])
        & (F.abs(F.col("d") - mean) <= sd * mean)
    )
    return rows.select(
        F.col("n").alias("node_id"), F.col("d").alias("density"), "in_hi", "in_lo", "out_hi", "out_lo", "in_primary", "in_secondary", "out_primary", "out_secondary",
        level["in_hi"].alias("primary_level"), level["in_lo"].alias("secondary_level"), ok.alias("split"),
    )


def split_repeats(nodes: DataFrame, arcs: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each accepted repeat becomes two nodes, one on the primary and one on the secondary path."""
    yes = decided.filter("split")
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top"))  # one row
    fresh = numbered(yes.select("node_id"), ["node_id"], "r").crossJoin(top).select("node_id", (F.col("r") + F.col("top")).alias("twin_id"))
    yes = yes.join(fresh, "node_id")
    share = F.col("primary_level") / (F.col("primary_level") + F.col("secondary_level"))
    both = nodes.join(yes.select("node_id", "twin_id", share.alias("share")), "node_id", "left")
    first = both.withColumn("cov", F.when(F.col("share").isNotNull(), F.round(F.col("cov") * F.col("share"))).otherwise(F.col("cov")).cast("bigint"))
    second = both.filter("share is not null").withColumn("cov", (F.col("cov") - F.round(F.col("cov") * F.col("share"))).cast("bigint")).withColumn("node_id", F.col("twin_id"))
    out = first.drop("twin_id", "share").unionByName(second.drop("twin_id", "share"))
    # the secondary entry and exit now lead to the new node
    moves = yes.select(F.explode(F.array(
        F.struct(F.col("in_secondary").alias("a"), F.col("node_id").alias("b"), F.col("in_secondary").alias("src"), F.col("twin_id").alias("dst")),
        F.struct(F.col("node_id").alias("a"), F.col("out_secondary").alias("b"), F.col("twin_id").alias("src"), F.col("out_secondary").alias("dst")),
    )).alias("m")).select("m.*")
    twins = moves.select((-F.col("b")).alias("a"), (-F.col("a")).alias("b"), (-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))
    change = moves.unionByName(twins).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("src").alias("s2"), F.col("dst").alias("d2")).distinct()
    renamed = arcs.join(change, ["src", "dst"], "left")
    return out, canonical_arcs(renamed.select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "mult"))


def peeled(nodes: DataFrame, levels: list[float]) -> DataFrame:
    """Nodes with the coverage level each belongs to (nearest, highest first): node_id, level, place. Levels are a short list."""
    d = F.col("cov") / F.col("length")
    rows = nodes.filter("length > 0").withColumn("level", nearest_peak(d, levels))
    place = F.array_position(F.array(*[F.lit(float(v)) for v in sorted(levels, reverse=True)]), F.col("level"))
    return rows.select("node_id", "level", place.cast("int").alias("place"))


def chimeric_nodes(nodes: DataFrame, arcs: DataFrame, primary: float, secondary: float, rate: float) -> DataFrame:
    """node_id of the nodes in connected parts that hold more than `rate` of either level."""
    from .traverse import parts

    of, _ = materialize(parts(arcs, nodes), "parts")
    rows = nodes.join(of, "node_id").withColumn("group_id", F.col("part"))
    bad = chimera(rows, primary, secondary, rate).filter("chimeric").select(F.col("group_id").alias("part"))
    return of.join(bad, "part", "left_semi").select("node_id")


def level_parts(nodes: DataFrame, arcs: DataFrame, levels: list[float]) -> DataFrame:
    """level, place, part, nodes, length, cov: the connected parts of each level's own subgraph, from the highest level down.

    Each level is resolved as if it were a single genome, as the multi-level run does."""
    from .traverse import parts, subgraph

    at, _ = materialize(peeled(nodes, levels), "levels")
    out = None
    for place, level in enumerate(sorted(levels, reverse=True), 1):
        own, inner = subgraph(nodes, arcs, at.filter(F.col("place") == place))
        found = parts(inner, own).join(own, "node_id").groupBy("part").agg(F.count(F.lit(1)).alias("nodes"), F.sum("length").alias("length"), F.sum("cov").alias("cov"))
        one = found.select(F.lit(float(level)).alias("level"), F.lit(place).alias("place"), "part", "nodes", "length", "cov")
        out = one if out is None else out.unionByName(one)
    return out
