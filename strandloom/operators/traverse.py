"""Walks over the graph: connected parts, bounded path searches, bypass merges, flanking nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .joining import joined
from .stats import both_strands


def parts(arcs: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """node_id, part: the smallest node of each connected part, strands ignored.

    Each round takes the smallest label of the neighbours and then the label's own label, so
    labels travel in doubling steps. Nodes of `nodes` without arcs are parts of their own."""
    spark = arcs.sparkSession
    e = arcs.filter("src is not null and dst is not null and src <> 0 and dst <> 0").select(F.abs("src").alias("a"), F.abs("dst").alias("b"))
    edges, _ = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    ids = edges.select(F.col("a").alias("node_id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("node_id"))
    labels, path = materialize(ids.distinct().withColumn("part", F.col("node_id")), "labels")
    sign = None
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("b") == F.col("node_id")).groupBy("a").agg(F.min("part").alias("low"))
        hooked = labels.join(near, F.col("node_id") == F.col("a"), "left").select("node_id", F.least("part", F.coalesce("low", "part")).alias("part"))
        hooked, half = materialize(hooked, "labels")
        to = hooked.select(F.col("node_id").alias("n2"), F.col("part").alias("p2"))
        after, new = materialize(hooked.join(to, F.col("part") == F.col("n2")).select("node_id", F.least("part", "p2").alias("part")), "labels")
        discard(spark, path)
        discard(spark, half)
        labels, path = after, new
        now = tuple(labels.agg(F.sum("part"), F.countDistinct("part")).first())
        if now == sign:
            return labels
        sign = now
    raise RuntimeError(f"no stable parts after {most_rounds} rounds")


def paths(arcs: DataFrame, starts: DataFrame, stops: DataFrame, steps: int | None = None, least_mult: int = 1) -> DataFrame:
    """start, stop, path: loop-free walks from signed `starts`(node) that end at the first node of `stops`(node_id).

    Each round joins the open walks with the arcs, until none goes on; their number grows with the degree, which
    `least_mult` thins. `steps` asks for walks of at most so many arcs."""
    both = both_strands(arcs).filter(F.col("mult") >= least_mult).select(F.col("src").alias("s"), F.col("dst").alias("d"))
    ends = stops.select(F.col("node_id").alias("e")).distinct().withColumn("is_end", F.lit(True))
    walk = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    done, i = None, 0
    while steps is None or i < steps:
        i += 1
        step = walk.join(both, F.col("at") == F.col("s")).filter(~F.array_contains(F.transform("path", F.abs), F.abs("d")))
        step = step.select("start", F.col("d").alias("at"), F.array_append("path", F.col("d")).alias("path"))
        step = step.join(ends, F.abs("at") == F.col("e"), "left")
        step, _ = materialize(step, "walks")
        found = step.filter("is_end").select("start", F.col("at").alias("stop"), "path")
        done = found if done is None else done.unionByName(found)
        walk = step.filter("is_end is null").select("start", "at", "path")
        if not walk.limit(1).count():
            break
    return done


def walks_between(arcs: DataFrame, links: DataFrame, near: DataFrame) -> DataFrame:
    """u, v, inner for those of links(u, v) with a single shortest loop-free walk from u to v over nodes of u's neighbourhood.

    near(node, other) are the signed nodes around u. Twins of links get the walk turned around: it is searched from the end
    with the smaller id. Walks of one link over the same nodes to the same node are one."""
    both, _ = materialize(both_strands(arcs).select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct(), "steps")
    turn = F.col("u") > -F.col("v")
    asked = links.select(F.when(turn, -F.col("v")).otherwise(F.col("u")).alias("a"), F.when(turn, -F.col("u")).otherwise(F.col("v")).alias("b")).distinct()
    around = near.select(F.col("node").alias("a"), F.col("other").alias("d"), F.lit(True).alias("inside"))
    none = F.array().cast("array<bigint>")
    walk, done = asked.select("a", "b", F.col("a").alias("at"), none.alias("inner")), None
    while True:
        step = walk.join(both, F.col("at") == F.col("s")).join(around, ["a", "d"], "left").filter((F.col("d") == F.col("b")) | (F.col("inside") & (F.abs("d") != F.abs("a")) & (F.abs("d") != F.abs("b")) & ~F.array_contains(F.transform("inner", F.abs), F.abs("d"))))
        step, _ = materialize(step.select("a", "b", F.col("d").alias("at"), F.when(F.col("d") == F.col("b"), F.col("inner")).otherwise(F.array_append("inner", F.col("d"))).alias("inner")), "between")
        found = step.filter("at = b").select("a", "b", "inner")
        done = found if done is None else done.unionByName(found)
        # a link whose shortest walk is known asks no further
        walk = step.filter("at <> b").join(found.select("a", "b").distinct(), ["a", "b"], "left_anti")
        walk = walk.groupBy("a", "b", "at", F.array_sort(F.transform("inner", F.abs)).alias("seen")).agg(F.min("inner").alias("inner")).select("a", "b", "at", "inner")
        walk, _ = materialize(walk, "walk")
        if not walk.limit(1).count():
            break
    single = done.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("inner").alias("inner")).filter("n = 1")
    back = single.select((-F.col("b")).alias("u"), (-F.col("a")).alias("v"), F.reverse(F.transform("inner", lambda x: -x)).alias("inner"))
    return single.select(F.col("a").alias("u"), F.col("b").alias("v"), "inner").unionByName(back).dropDuplicates(["u", "v"])


def nearest_paths(arcs: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """start, stop, path: as `paths` without a limit of steps, each start only as far as the first round in which it meets a stop.

    Of a start's walks over the same nodes to the same end the first in order is kept."""
    both, _ = materialize(both_strands(arcs).select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct(), "steps")
    ends = stops.select(F.col("node_id").alias("e")).distinct().withColumn("is_end", F.lit(True))
    walk = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    done = None
    while True:
        step = walk.join(both, F.col("at") == F.col("s")).filter(~F.array_contains(F.transform("path", F.abs), F.abs("d")))
        step = step.select("start", F.col("d").alias("at"), F.array_append("path", F.col("d")).alias("path"))
        step = step.groupBy("start", "at", F.array_sort(F.transform("path", F.abs)).alias("seen")).agg(F.min("path").alias("path"))
        step, _ = materialize(step.join(ends, F.abs("at") == F.col("e"), "left").select("start", "at", "path", "is_end"), "walks")
        found = step.filter("is_end").select("start", F.col("at").alias("stop"), "path")
        done = found if done is None else done.unionByName(found)
        walk = step.filter("is_end is null").join(found.select("start").distinct(), "start", "left_anti").select("start", "at", "path")
        if not walk.limit(1).count():
            return done


def best_paths(found: DataFrame) -> DataFrame:
    """One walk for each start: to the stop with the fewest nodes between, ties to the smaller ids; walks between which
    that rule cannot choose a single stop are left out."""
    n = F.size("path")
    w = W.partitionBy("start").orderBy(n, "stop", "path")
    same = F.countDistinct
    targets = found.withColumn("n", n).groupBy("start").agg(F.min("n").alias("least"))
    near = found.join(targets, "start").filter(F.size("path") == F.col("least"))
    single = near.groupBy("start").agg(same("stop").alias("k")).filter("k = 1").select("start")
    return near.join(single, "start", "left_semi").withColumn("r", F.row_number().over(w)).filter("r = 1").select("start", "stop", "path")


def bypass(nodes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Nodes after merging along accepted links(u, v), one for each u and each v: node_id (of the chain's head), length, cov, seq.

    The k - 1 bases that consecutive nodes share are written once."""
    none = F.array().cast("array<bigint>")
    return joined(nodes, links.select("u", "v", none.alias("inner"), F.lit(0).alias("gap")), k)[0].select("node_id", "length", "cov", "seq")


def flanks(nodes: DataFrame, arcs: DataFrame, insertions: DataFrame, reliable: int = 500, steps: int | None = None) -> DataFrame:
    """node_id, side (5 or 3), flank: reliable nodes (at least `reliable` long) first met on loop-free walks from insertion nodes.

    Without `steps` the search ends when no walk goes on. Reached nodes alone do not decide: over a hairpin a walk comes
    back through its start to the other side. Walks of one start over the same nodes to the same end are one."""
    spark = arcs.sparkSession
    both, _ = materialize(both_strands(arcs).select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct(), "steps")
    ends = nodes.filter(F.col("length") >= reliable).select(F.col("node_id").alias("e"), F.lit(True).alias("is_end")).distinct()
    walk = insertions.select(F.explode(F.array(F.col("node_id"), -F.col("node_id"))).alias("start")).select("start", F.col("start").alias("at"), F.array(F.abs("start")).alias("seen"))
    done, path, i = None, None, 0
    while steps is None or i < steps:
        i += 1
        step = walk.join(both, F.col("at") == F.col("s")).filter(~F.array_contains("seen", F.abs("d")))
        step = step.select("start", F.col("d").alias("at"), F.array_sort(F.array_append("seen", F.abs("d"))).alias("seen")).distinct()
        step, new = materialize(step.join(ends, F.abs("at") == F.col("e"), "left"), "walks")
        found = step.filter("is_end").select(F.abs("start").alias("node_id"), F.when(F.col("start") > 0, 3).otherwise(5).alias("side"), F.abs("at").alias("flank"))
        found, _ = materialize(found.distinct(), "flanks")
        done = found if done is None else done.unionByName(found)
        if path:
            discard(spark, path)
        walk, path = step.filter("is_end is null").select("start", "at", "seen"), new
        if not walk.limit(1).count():
            break
    return done.distinct()


def subgraph(nodes: DataFrame, arcs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of `chosen`(node_id) and the arcs between them."""
    ids = chosen.select("node_id").distinct()
    end = ids.select(F.col("node_id").alias("c"))
    inner = arcs.join(end, F.abs("src") == F.col("c"), "left_semi").join(end, F.abs("dst") == F.col("c"), "left_semi")
    return nodes.join(ids, "node_id", "left_semi"), inner
