"""Nodes joined end to end: over shared bases, over the nodes of a walk, or over a gap of unknown bases.

The one merge behind long-read resolution, bypasses and scaffolds. What happened to each
old node is kept as members(old, new, start, total), so that read starts and gaps of the
old nodes can follow (`moved_places`, `moved_spans`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..runtime import materialize
from .stats import canonical_arcs


def _text(signed: str) -> F.Column:
    return F.when(F.col(signed) > 0, F.col("seq")).otherwise(dna.revcomp(F.col("seq")))


def joined(nodes: DataFrame, links: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, gaps, members) after joining along links(u, v, inner, gap), one link for each u and each v, twins included.

    `inner` is the list of signed nodes between u and v: their bases are written between them and they are absorbed; an
    empty list joins u and v over the k - 1 bases they share; null leaves a gap of `gap` Ns. A joined node takes
    the id of its chain's first node; lengths (in k-mers) follow the bases, coverages are summed over the joined nodes.
    gaps(node_id, start, stop) in bases; members(old, new, start, total): node `old` begins `start` bases into the node `new`
    of `total` k-mers. A node that a chain would hold twice is taken once. No links: nodes come back as they are."""
    from .graph import chains

    links, _ = materialize(links.select("u", "v", "inner", "gap"), "joins")
    ranks = chains(links.select("u", "v"))
    tails = ranks.groupBy("head").agg(F.max_by("u", "rank").alias("tail"))
    # one strand of each chain
    kept = ranks.join(tails.filter("head <= -tail"), "head")
    once = W.partitionBy("head", F.abs("u")).orderBy("rank")
    kept, _ = materialize(kept.withColumn("i", F.row_number().over(once)).filter("i = 1").select("head", "u", "rank"), "chains")
    # the bases of the walk in front of each node, without the k - 1 that its nodes share with the node before them
    walk = links.filter("size(inner) > 0").select("v", F.posexplode("inner").alias("at", "x"))
    own = nodes.select("node_id", "length", *(["cov"] if "cov" in nodes.columns else []), "seq")
    fill = walk.join(own.select("node_id", "seq"), F.abs("x") == F.col("node_id")).groupBy("v").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", _text("x").substr(F.lit(k), F.length("seq")).alias("p")))), lambda x: x["p"])).alias("fill")
    )
    rows = kept.join(links.select(F.col("v").alias("u"), "inner", "gap"), "u", "left").join(fill.withColumnRenamed("v", "u"), "u", "left")
    rows = rows.join(own, F.abs("u") == F.col("node_id")).withColumn("s", _text("u"))
    first = F.col("rank") == 0
    over = ~first & F.col("inner").isNotNull()
    ns = F.when(first | over, 0).otherwise(F.col("gap")).cast("int")
    before = F.when(first, "").when(over, F.coalesce("fill", F.lit(""))).otherwise(F.expr("repeat('N', gap)"))
    rows = rows.withColumn("ns", ns).withColumn("piece", F.concat(before, F.when(over, F.col("s").substr(F.lit(k), F.length("s"))).otherwise(F.col("s"))))
    w = W.partitionBy("head").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows, _ = materialize(rows.withColumn("stop", F.sum(F.length("piece")).over(w)).withColumn("start", F.col("stop") - F.length("s")), "pieces")
    merged = rows.groupBy(F.abs("head").alias("node_id")).agg(
        *([F.sum("cov").alias("cov")] if "cov" in nodes.columns else []),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"])).alias("seq"), F.max("stop").alias("bases"),
    ).withColumn("length", (F.col("bases") - (k - 1)).cast("bigint")).drop("bases")
    gone = rows.select(F.abs("u").alias("node_id")).unionByName(walk.select(F.abs("x").alias("node_id"))).distinct()
    alone = own.join(gone, "node_id", "left_anti")
    gaps = rows.filter("ns > 0").select(F.abs("head").alias("node_id"), (F.col("start") - F.col("ns")).alias("start"), F.col("start").alias("stop"))
    total = merged.select("node_id", F.col("length").alias("total"))
    members = rows.select(F.col("u").alias("old"), F.abs("head").alias("node_id"), "start").join(total, "node_id").select(
        "old", F.col("node_id").alias("new"), "start", "total"
    )
    stay = alone.select(F.col("node_id").alias("old"), F.col("node_id").alias("new"), F.lit(0).cast("bigint").alias("start"), F.col("length").alias("total"))
    out, _ = materialize(alone.unionByName(merged.select(*own.columns)), "joined")
    return out, materialize(gaps, "gaps")[0], materialize(members.unionByName(stay), "members")[0]


def _both_ways(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members by signed node: x, y (the signed node it lies in) and the shift of positions."""
    ln = nodes.select(F.col("node_id").alias("i"), F.col("length").alias("l"))
    rows = members.join(ln, F.abs("old") == F.col("i"))
    pair = F.array(
        F.struct(F.col("old").alias("x"), F.col("new").alias("y"), F.col("start").alias("shift")),
        F.struct((-F.col("old")).alias("x"), (-F.col("new")).alias("y"), (F.col("total") - F.col("start") - F.col("l")).alias("shift")),
    )
    return rows.select(F.explode(pair).alias("m")).select("m.*")


def moved_arcs(arcs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs of the joined nodes: those that leave from an end and enter at a beginning. `nodes` are the old ones."""
    ln = nodes.select(F.col("node_id").alias("i"), F.col("length").alias("l"))
    size = members.select(F.col("new").alias("n"), "total").distinct()
    both = _both_ways(members, nodes).join(ln, F.abs("x") == F.col("i")).join(size, F.abs("y") == F.col("n"))
    out = both.filter(F.col("shift") + F.col("l") == F.col("total")).select(F.col("x").alias("src"), F.col("y").alias("a"))
    into = both.filter("shift = 0").select(F.col("x").alias("dst"), F.col("y").alias("b"))
    return canonical_arcs(arcs.join(out, "src").join(into, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "mult"))


def moved_markers(markers: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Passages (seq_id, ord, node, ...) over the joined nodes: absorbed nodes drop out, a stay on one node is one marker."""
    w = W.partitionBy("seq_id").orderBy("ord")
    rows = markers.select("seq_id", "ord", "node").join(_both_ways(members, nodes), F.col("node") == F.col("x")).select("seq_id", "ord", F.col("y").alias("node"))
    return rows.withColumn("p", F.lag("node").over(w)).filter("p is null or p <> node").drop("p")


def merged_places(places: DataFrame) -> DataFrame:
    """One place for each read and node, as lists of read starts are united: the first one, blurred (-1) where there are several."""
    best = F.min_by(F.struct("position", "offset"), F.struct("offset", "position"))
    each = places.groupBy("node", "read_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    return each.select("node", "read_id", F.when(F.col("n") > 1, -1).otherwise(F.col("b.position")).cast("bigint").alias("position"), F.col("b.offset").alias("offset"))


def moved_places(places: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Read starts on the joined nodes: positions shift by what lies before the old node, blurred ones stay blurred.

    `nodes` are the old ones. Places on nodes that are no member are lost with them."""
    rows = places.join(_both_ways(members, nodes), F.col("node") == F.col("x"))
    return merged_places(rows.select(
        F.col("y").alias("node"), "read_id", F.when(F.col("position") < 0, F.col("position")).otherwise(F.col("position") + F.col("shift")).alias("position"), "offset"
    ))


def common_reads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads with a place in both lists: node pairs (a_node, b_node), read_id. Lists are places of the nodes to compare."""
    return a.select(F.col("node").alias("a_node"), "read_id").join(b.select(F.col("node").alias("b_node"), "read_id"), "read_id").distinct()


def split_places(places: DataFrame, cuts: DataFrame) -> DataFrame:
    """Places when node x is cut at `at` k-mers into front and back: cuts(node, at, front, back), signed.

    A start before the cut goes to the front, one behind it to the back, at its position there; a blurred one to both."""
    rows = places.join(cuts.select(F.col("node"), "at", "front", "back"), "node")
    blurred = F.col("position") < 0
    ends = F.when(blurred, F.array("front", "back")).when(F.col("position") < F.col("at"), F.array("front")).otherwise(F.array("back"))
    moved = F.when(blurred | (F.col("position") < F.col("at")), F.col("position")).otherwise(F.col("position") - F.col("at"))
    return rows.select(F.explode(ends).alias("node"), "read_id", moved.cast("bigint").alias("position"), "offset")


def moved_spans(spans: DataFrame, members: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Spans (node_id, start, stop in bases), such as gaps, on the joined nodes."""
    size = nodes.select(F.col("node_id").alias("i"), (F.col("length") + (k - 1)).alias("bases"))
    to = members.select(F.abs("old").alias("n"), "old", "new", F.col("start").alias("shift"))
    rows = spans.join(to, F.col("node_id") == F.col("n")).join(size, F.col("n") == F.col("i"))
    turned = F.col("old") < 0
    start = F.when(turned, F.col("bases") - F.col("stop")).otherwise(F.col("start")) + F.col("shift")
    return rows.select(F.col("new").alias("node_id"), start.alias("start"), (start + F.col("stop") - F.col("start")).alias("stop"))
