"""Read pairs: mates, insert sizes, connections between nodes, link filters, scaffolds.

Read placements: places(read_id, node signed, position, offset), at most one row for
a read and node; position -1 where a read enters a node more than once. libraries:
(library, ins_len, ins_var).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import erf
from ..runtime import materialize
from .ordered import running_last, running_total


def mates(reads: DataFrame) -> DataFrame:
    """read_id, category, mate_id: in each run of one odd category, by id, reads pair by adjacency;
    a run's dangling last read loses its pairing (category - 1). Even categories have no mates.

    One running count over all rows gives every row its place; a run begins where the category before differs, and that is
    told by the row before, which is joined by place. No step is keyed by a library or a run, of which there are few."""
    rows = reads.filter("read_id is not null and category is not null").select("read_id", F.col("category").cast("int").alias("category")).distinct()
    placed, _ = materialize(running_total(rows, F.lit(1).cast("bigint"), ["read_id", "category"], "n"), "places")
    before = placed.select((F.col("n") + 1).alias("n"), F.col("category").alias("before"))
    head = placed.join(before, "n", "left").withColumn("head", F.when(~F.col("before").eqNullSafe(F.col("category")), F.col("n")))
    run, _ = materialize(running_last(head, F.col("head"), ["n"], "first").select("n", "first", "read_id", "category"), "runs")
    second = (F.col("n") - F.col("first")) % 2 == 1
    odd = run.filter("category % 2 = 1").withColumn("o", F.when(second, F.col("n") - 1).otherwise(F.col("n") + 1))
    near = run.select(F.col("n").alias("o"), F.col("first").alias("o_first"), F.col("read_id").alias("mate"))
    both = odd.join(near, "o", "left").withColumn("mate_id", F.when(F.col("o_first") == F.col("first"), F.col("mate")))
    paired = both.select("read_id", F.when(F.col("mate_id").isNull(), F.col("category") - 1).otherwise(F.col("category")).alias("category"), "mate_id")
    return paired.unionByName(rows.filter("category % 2 = 0").withColumn("mate_id", F.lit(None).cast("bigint")))


def detach(pairs: DataFrame, dubious: DataFrame) -> DataFrame:
    """Pairs (read_id, mate_id, ...) without those of a dubious read or its mate."""
    bad = dubious.select("read_id").distinct()
    return pairs.join(bad, "read_id", "left_anti").join(bad.select(F.col("read_id").alias("mate_id")), "mate_id", "left_anti")


def paired_libraries(reads: DataFrame) -> DataFrame:
    """Number of paired libraries and of extension rounds (one more)."""
    n = F.countDistinct(F.when(F.col("category") % 2 == 1, F.expr("category div 2")))
    return reads.agg(n.alias("paired_libraries"), (n + 1).alias("rounds"))


def insert_sizes(places: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """library, insert_size for pairs with both mates on one node, on opposite strands, positions positive.

    `pairs` has read_id < mate_id once a pair, and library. Several hits: the smallest node."""
    a = places.select(F.col("read_id"), F.col("node").alias("n1"), F.col("position").alias("p1"), F.col("offset").alias("o1"))
    b = places.select(F.col("read_id").alias("mate_id"), F.col("node").alias("n2"), F.col("position").alias("p2"), F.col("offset").alias("o2"))
    both = pairs.filter("read_id < mate_id").join(a, "read_id").join(b, "mate_id").filter("n1 = -n2 and p1 > 0 and p2 > 0")
    size = F.col("length") + (k - 1) - (F.col("p1") - F.col("o1")) - (F.col("p2") - F.col("o2"))
    found = both.join(nodes.select(F.col("node_id"), "length"), F.abs("n1") == F.col("node_id")).withColumn("x", size)
    return found.groupBy("read_id", "library").agg(F.min_by("x", F.struct(F.abs("n1"), "x")).alias("insert_size")).select("library", "insert_size")


def insert_estimates(sizes: DataFrame) -> DataFrame:
    """library, n, ins_len (upper median), ins_var: mean squared deviation from it, in whole numbers, at least 1,
    over sizes between 0 and five medians, or over all where none lies there."""
    rows = sizes.filter("insert_size is not null")
    r = running_total(rows.withColumn("tie", F.monotonically_increasing_id()), F.lit(1).cast("bigint"), ["insert_size", "tie"], "place", ["library"])
    n = rows.groupBy("library").agg(F.count(F.lit(1)).alias("n"))
    med = r.join(n, "library").filter("place = n div 2 + 1").select("library", "n", F.col("insert_size").alias("ins_len"))
    dev = rows.join(med, "library").withColumn("d", (F.col("insert_size") - F.col("ins_len")) * (F.col("insert_size") - F.col("ins_len")))
    near = F.expr("insert_size > 0 and insert_size < 5 * ins_len")
    agg = dev.groupBy("library", "n", "ins_len").agg(
        F.sum(F.when(near, F.col("d"))).alias("s"), F.count(F.when(near, 1)).alias("c"), F.sum("d").alias("sa")
    )
    var = F.when(F.col("c") > 0, F.expr("s div c")).otherwise(F.expr("sa div n"))
    return agg.select("library", "n", "ins_len", F.greatest(var, F.lit(1)).alias("ins_var"))


def pair_links(places: DataFrame, pairs: DataFrame, nodes: DataFrame, libraries: DataFrame) -> DataFrame:
    """src, dst, distance, variance, paired, direct: one estimate for each pair whose mates lie on different nodes.

    Distance is between node centres, from the insert length and both positions; estimates more than
    six deviations below touching are dropped, others are raised to touching."""
    a = places.select(F.col("read_id"), F.col("node").alias("src"), F.col("position").alias("p1"), F.col("offset").alias("o1"))
    b = places.select(F.col("read_id").alias("mate_id"), (-F.col("node")).alias("dst"), F.col("position").alias("p2"), F.col("offset").alias("o2"))
    ln = nodes.select("node_id", "length")
    rows = (
        pairs.filter("read_id < mate_id").join(a, "read_id").join(b, "mate_id").filter("abs(src) <> abs(dst)")
        .join(ln.select(F.col("node_id").alias("i1"), F.col("length").alias("l1")), F.abs("src") == F.col("i1"))
        .join(ln.select(F.col("node_id").alias("i2"), F.col("length").alias("l2")), F.abs("dst") == F.col("i2"))
        .join(libraries, "library")
    )
    blurred = (F.col("p1") < 0, F.col("p2") < 0)
    dist = F.col("ins_len") - F.when(blurred[0], 0).otherwise(F.col("l1") / 2 - (F.col("p1") - F.col("o1"))) - F.when(blurred[1], 0).otherwise(F.col("l2") / 2 - (F.col("p2") - F.col("o2")))
    var = F.col("ins_var") + F.when(blurred[0], F.col("l1") * F.col("l1") / 16).otherwise(0) + F.when(blurred[1], F.col("l2") * F.col("l2") / 16).otherwise(0)
    touch = (F.col("l1") + F.col("l2")) / 2
    out = rows.withColumn("distance", dist).withColumn("variance", var.cast("double")).withColumn("touch", touch)
    out = out.filter(F.col("distance") >= F.col("touch") - 6 * F.sqrt("variance"))
    return out.select("src", "dst", F.greatest("distance", "touch").alias("distance"), "variance", F.lit(0).cast("bigint").alias("direct"), F.lit(1).cast("bigint").alias("paired"))


def read_links(places: DataFrame, nodes: DataFrame, slack: float = 10.0) -> DataFrame:
    """src, dst, distance, variance, direct, paired: single reads on two nodes; signed distance between centres.

    A blurred position costs length^2/16 of variance; overlaps beyond `slack` are dropped, others raised to touching."""
    a = places.select("read_id", F.col("node").alias("src"), F.col("position").alias("p1"), F.col("offset").alias("o1"))
    b = places.select("read_id", F.col("node").alias("dst"), F.col("position").alias("p2"), F.col("offset").alias("o2"))
    ln = nodes.select("node_id", "length")
    rows = (
        a.join(b, "read_id").filter("abs(src) < abs(dst)")
        .join(ln.select(F.col("node_id").alias("i1"), F.col("length").alias("l1")), F.abs("src") == F.col("i1"))
        .join(ln.select(F.col("node_id").alias("i2"), F.col("length").alias("l2")), F.abs("dst") == F.col("i2"))
    )
    at = lambda p, o, length: F.when(F.col(p) < 0, 0).otherwise(F.col(p) - F.col(o) + F.col(length) / 2)
    var = F.when(F.col("p1") < 0, F.col("l1") * F.col("l1") / 16).otherwise(0) + F.when(F.col("p2") < 0, F.col("l2") * F.col("l2") / 16).otherwise(0)
    gap = F.abs(at("p2", "o2", "l2") - at("p1", "o1", "l1"))
    touch = (F.col("l1") + F.col("l2")) / 2
    out = rows.withColumn("distance", gap).withColumn("touch", touch).withColumn("variance", F.greatest(var.cast("double"), F.lit(1.0)))
    return out.filter(F.col("distance") - F.col("touch") >= -slack).select(
        "src", "dst", F.greatest("distance", "touch").alias("distance"), "variance", F.lit(1).cast("bigint").alias("direct"), F.lit(0).cast("bigint").alias("paired")
    )


def connections(links: DataFrame) -> DataFrame:
    """Links of one pair of nodes, twins included, as one: inverse-variance mean distance, harmonic variance, summed counts.

    Links without an end are none; without a distance or a positive variance they add counts only."""
    rows = links.filter("src is not null and dst is not null and src <> 0 and dst <> 0")
    twin = F.abs("dst") < F.abs("src")
    one = rows.select(
        F.when(twin, -F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(twin, -F.col("src")).otherwise(F.col("dst")).alias("dst"),
        "distance", F.when((F.col("variance") > 0) & F.col("distance").isNotNull(), F.col("variance")).alias("variance"),
        F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("paired", F.lit(0)).alias("paired"),
    )
    return one.groupBy("src", "dst").agg(
        (F.sum(F.col("distance") / F.col("variance")) / F.sum(1 / F.col("variance"))).alias("distance"),
        (1 / F.sum(1 / F.col("variance"))).alias("variance"), F.sum("direct").alias("direct"), F.sum("paired").alias("paired"),
    )


def expected_links(rows: DataFrame) -> DataFrame:
    """Adds `expected`: whole number of pairs a Gaussian insert model puts across the gap.

    A pair of insert length L that starts x bases before the end of one node ends y bases into the other if L = x + gap + y.
    The number of such places is a trapezium in L: it begins at the gap, grows with L up to the shorter length, stays, and
    falls to nothing at gap + l1 + l2; as a sum of ramps, (L - c)+ with c = gap, gap + l1, gap + l2, gap + l1 + l2 and signs
    + - - +. So the expectation is the density times the same sum of E (L - c)+, each of which is known for a Gaussian.

    Needs l1, l2 (lengths), distance (between centres), ins_len, ins_var and density (reads a base on the longer node)."""
    gap = F.col("distance") - (F.col("l1") + F.col("l2")) / 2
    # fixed values of the model: the density's peak as 0.4, its integral as erf at 0.7
    sd = F.sqrt("ins_var")

    def ramp(c):
        z = (c - F.col("ins_len")) / sd
        return sd * (F.lit(0.4) * F.exp(-z * z / 2) - z * (F.lit(0.5) - erf(F.lit(0.7) * z) / 2))

    places = ramp(gap) - ramp(gap + F.col("l1")) - ramp(gap + F.col("l2")) + ramp(gap + F.col("l1") + F.col("l2"))
    return rows.withColumn("expected", F.floor(F.greatest(places * F.col("density"), F.lit(0.0))).cast("bigint"))


def accepted(conns: DataFrame, min_pairs: int = 5, fraction: float = 0.1) -> DataFrame:
    """Connections kept: to a node that is not unique, or with enough counts and enough of the expected pairs.

    Needs columns dst_unique BOOLEAN and expected BIGINT."""
    enough = (F.col("paired") + F.col("direct") >= min_pairs) & (F.col("paired") >= F.col("expected") * fraction)
    return conns.filter(~F.coalesce("dst_unique", F.lit(False)) | enough)


def with_twins(conns: DataFrame) -> DataFrame:
    return conns.unionByName(conns.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"), "distance", "variance", "direct", "paired"))


def neighbourhood(conns: DataFrame, unique: DataFrame) -> DataFrame:
    """node, other, distance, variance: nodes linked to a unique node directly or over one unique node."""
    both = with_twins(conns).filter("variance > 0 and distance is not null")
    u = unique.select(F.col("node_id"))
    start = both.join(u, F.abs("src") == F.col("node_id"), "left_semi")
    direct = start.select(F.col("src").alias("node"), F.col("dst").alias("other"), "distance", "variance")
    mid = start.join(u, F.abs("dst") == F.col("node_id"), "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("mid"), F.col("distance").alias("d1"), F.col("variance").alias("v1"))
    hop = mid.join(both, F.col("mid") == F.col("src")).filter("abs(dst) <> abs(node)").select(
        "node", F.col("dst").alias("other"), (F.col("d1") + F.col("distance")).alias("distance"), (F.col("v1") + F.col("variance")).alias("variance")
    )
    return direct.unionByName(hop).groupBy("node", "other").agg(
        (F.sum(F.col("distance") / F.col("variance")) / F.sum(1 / F.col("variance"))).alias("distance"), (1 / F.sum(1 / F.col("variance"))).alias("variance")
    )


def nearest_unique(near: DataFrame, unique: DataFrame) -> DataFrame:
    """node, target, distance: the nearest unique node ahead; ties go to the smaller id."""
    ahead = near.join(unique.select("node_id"), F.abs("other") == F.col("node_id"), "left_semi").filter("distance > 0")
    return ahead.groupBy("node").agg(F.min_by("other", F.struct("distance", "other")).alias("target"), F.min("distance").alias("distance"))


def mutual_targets(conns: DataFrame, unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links u, v, distance of unique nodes that choose each other as nearest, on both strands; the neighbourhoods)."""
    near, _ = materialize(neighbourhood(conns, unique), "near")
    best, _ = materialize(nearest_unique(near, unique), "nearest")
    back = best.select((-F.col("target")).alias("u"), (-F.col("node")).alias("v"))
    return best.select(F.col("node").alias("u"), F.col("target").alias("v"), "distance").join(back, ["u", "v"]).filter("abs(u) <> abs(v)"), near


def scaffolds(nodes: DataFrame, conns: DataFrame, unique: DataFrame, k: int, least_gap: int = 10, arcs: DataFrame | None = None, jump: bool = True) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Unique nodes joined over their nearest unique neighbours: (nodes, gaps, members), see `joining.joined`; None where none are.

    A join needs both nodes to choose each other. With `arcs`, a single shortest walk through the node's neighbourhood
    fills the gap; otherwise, if gaps may be jumped, it is the centre distance less the half lengths, at least `least_gap` Ns."""
    from .joining import joined
    from .traverse import walks_between

    mutual, near = mutual_targets(conns, unique)
    ln = nodes.select(F.col("node_id").alias("i"), F.col("length").alias("l"))
    rows = mutual.join(ln, F.abs("u") == F.col("i")).drop("i").withColumnRenamed("l", "l1").join(ln, F.abs("v") == F.col("i"))
    gap = F.greatest(F.floor(F.col("distance") - (F.col("l1") + F.col("l")) / 2), F.lit(least_gap)).cast("int")
    links = rows.select("u", "v", gap.alias("gap"))
    if arcs is None:
        links = links.withColumn("inner", F.lit(None).cast("array<bigint>"))
    else:
        links = links.join(walks_between(arcs, mutual.select("u", "v"), near), ["u", "v"], "left")
    if not jump:
        links = links.filter("inner is not null")
    links, _ = materialize(links, "mutual")
    return joined(nodes, links, k) if links.limit(1).count() else None
