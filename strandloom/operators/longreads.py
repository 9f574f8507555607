"""Long-read repeat resolution over passage markers.

markers(seq_id, ord, node signed, start, finish, start_off, finish_off): the path of a
long read over nodes. unique(node_id): nodes flagged unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from .joining import joined


def passage_markers(threads: DataFrame, categories: tuple[int, ...]) -> DataFrame:
    """Markers of the reads of the given (long) categories: runs of consecutive positions on one node."""
    rows = threads.filter(F.col("category").isin(*categories))
    w = W.partitionBy("read_id").orderBy("pos")
    prev = F.lag(F.struct("node", "off", "pos")).over(w)
    step = F.when(F.col("node") > 0, 1).otherwise(-1)
    goes_on = (F.col("p.node") == F.col("node")) & (F.col("off") == F.col("p.off") + step) & (F.col("pos") == F.col("p.pos") + 1)
    runs = rows.withColumn("p", prev).withColumn("head", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("ord", F.sum("head").over(w))
    return runs.groupBy(F.col("read_id").alias("seq_id"), "ord").agg(
        F.first("node").alias("node"), F.min("pos").cast("bigint").alias("start"), (F.max("pos") + 1).cast("bigint").alias("finish"),
        F.min_by("off", "pos").alias("start_off"), F.max_by("off", "pos").alias("finish_off"),
    )


def terminal(markers: DataFrame) -> DataFrame:
    """The first and the last marker of each sequence."""
    w = W.partitionBy("seq_id")
    ends = markers.withColumn("lo", F.min("ord").over(w)).withColumn("hi", F.max("ord").over(w))
    return ends.filter("ord = lo or ord = hi").drop("lo", "hi")


def trimmed(markers: DataFrame, unique: DataFrame) -> DataFrame:
    """Markers between a read's first and last one on a unique node."""
    u = unique.select("node_id", F.lit(True).alias("is_unique"))
    rows = markers.join(u, F.abs("node") == F.col("node_id"), "left").drop("node_id").fillna(False, ["is_unique"])
    w = W.partitionBy("seq_id")
    lo, hi = F.min(F.when(F.col("is_unique"), F.col("ord"))).over(w), F.max(F.when(F.col("is_unique"), F.col("ord"))).over(w)
    return rows.withColumn("lo", lo).withColumn("hi", hi).filter("ord between lo and hi").drop("lo", "hi")


def unique_links(markers: DataFrame, least: int = 2) -> DataFrame:
    """u, v, votes, inner: from each unique node to the next one along long reads, with at least `least` reads, one target
    for each source and one source for each target, on both strands alike. `markers` comes from `trimmed`.

    inner are the nodes between, as most reads have them, ties to the smaller list; a twin link has the list turned around."""
    w = W.partitionBy("seq_id").orderBy("ord")
    # the nodes since the last unique one go with the unique one that follows them
    part = markers.withColumn("part", F.coalesce(F.sum(F.col("is_unique").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    walk = part.groupBy("seq_id", "part").agg(
        F.max(F.when(F.col("is_unique"), F.struct("ord", "node")))["node"].alias("v"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_unique"), F.struct("ord", "node")))), lambda x: x["node"]).alias("inner")
    )
    steps = walk.withColumn("u", F.lag("v").over(W.partitionBy("seq_id").orderBy("part"))).filter("u is not null and v is not null and v <> u").select("u", "v", "inner")
    both = steps.unionByName(steps.select((-F.col("v")).alias("u"), (-F.col("u")).alias("v"), F.reverse(F.transform("inner", lambda x: -x)).alias("inner")))
    each = both.groupBy("u", "v", "inner").agg(F.count(F.lit(1)).alias("n"))
    # the same choice on both strands: by votes, then by the smaller of the list and its twin
    twin = F.reverse(F.transform("inner", lambda x: -x))
    votes = each.groupBy("u", "v").agg(F.sum("n").alias("votes"), F.min_by("inner", F.struct((-F.col("n")).alias("m"), F.least(F.col("inner"), twin).alias("k"))).alias("inner")).filter(F.col("votes") >= least)
    kept = votes.withColumn("o", F.count(F.lit(1)).over(W.partitionBy("u"))).withColumn("i", F.count(F.lit(1)).over(W.partitionBy("v")))
    return kept.filter("o = 1 and i = 1 and u <> -v").select("u", "v", "votes", "inner")


def resolved(nodes: DataFrame, markers: DataFrame, unique: DataFrame, k: int, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One round over the long reads: nodes, gaps, members (see `joining.joined`) after joining unique nodes that they link; None if none are."""
    links, _ = materialize(unique_links(trimmed(markers, unique), least), "links")
    if not links.limit(1).count():
        return None
    return joined(nodes, links.select("u", "v", "inner", F.lit(0).alias("gap")), k)


def strain_coverage(markers: DataFrame, seqs: DataFrame) -> DataFrame:
    """node_id, strain, covered: long-read bases on each node by strain, seqs(seq_id, strain)."""
    return markers.join(seqs, "seq_id").groupBy(F.abs("node").alias("node_id"), "strain").agg(F.sum(F.col("finish") - F.col("start")).alias("covered"))


def strain_classes(markers: DataFrame, seqs: DataFrame, genome: str) -> DataFrame:
    """node_id, genome_copies, strain_copies, class: only_genome, only_strain or mixed, by the sequences that pass the node.

    seqs(seq_id, strain); `genome` names the reference strain."""
    own = F.col("strain") == genome
    rows = markers.join(seqs, "seq_id").groupBy(F.abs("node").alias("node_id")).agg(
        F.sum(own.cast("bigint")).alias("genome_copies"), F.sum((~own).cast("bigint")).alias("strain_copies")
    )
    kind = F.when(F.col("strain_copies") == 0, "only_genome").when(F.col("genome_copies") == 0, "only_strain").otherwise("mixed")
    return rows.withColumn("class", kind)


def break_points(markers: DataFrame) -> DataFrame:
    """node_id, breaks: how many distinct nodes come next on either side of a node along its sequences, less one a side."""
    w = W.partitionBy("seq_id").orderBy("ord")
    steps = markers.withColumn("v", F.lead("node").over(w)).filter("v is not null").select(F.col("node").alias("u"), "v")
    both = steps.unionByName(steps.select((-F.col("v")).alias("u"), (-F.col("u")).alias("v")))
    each = both.groupBy("u").agg(F.countDistinct("v").alias("n"))
    return each.groupBy(F.abs("u").alias("node_id")).agg(F.sum(F.col("n") - 1).alias("breaks"))


def virtual_length(markers: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, virtual_length: a node's length plus those of all nodes that follow, on either strand, as long as every marker
    that goes on from a node goes on to the same one; a walk that comes back to a node ends there."""
    from .graph import chains

    w = W.partitionBy("seq_id").orderBy("ord")
    steps = markers.withColumn("v", F.lead("node").over(w)).select(F.col("node").alias("u"), "v")
    ahead = steps.unionByName(markers.withColumn("p", F.lag("node").over(w)).select((-F.col("node")).alias("u"), (-F.col("p")).alias("v")))
    nxt = ahead.groupBy("u").agg(F.countDistinct("v").alias("targets"), F.count(F.lit(1)).alias("n"), F.count("v").alias("m"), F.first("v", True).alias("v")).filter("targets = 1 and n = m and v <> u")
    nxt, _ = materialize(nxt.select("u", "v"), "next")
    ln = nodes.select(F.col("node_id").alias("i"), "length")
    state, _ = materialize(nxt.join(ln, F.abs("v") == F.col("i")).select("u", F.col("v").alias("at"), F.col("length").alias("more"), F.array(F.abs("u"), F.abs("v")).alias("seen")), "walks")
    open_ = state
    while open_.limit(1).count():
        step = open_.join(nxt.select(F.col("u").alias("at"), F.col("v").alias("to")), "at").filter(~F.array_contains("seen", F.abs("to"))).join(ln, F.abs("to") == F.col("i"))
        open_, _ = materialize(step.select("u", F.col("to").alias("at"), F.col("length").alias("more"), F.array_append("seen", F.abs("to")).alias("seen")), "walks")
        state = state.unionByName(open_)
    total = state.groupBy(F.abs("u").alias("node_id")).agg(F.sum("more").alias("more"))
    return nodes.select("node_id", "length").join(total, "node_id", "left").select("node_id", (F.col("length") + F.coalesce("more", F.lit(0))).alias("virtual_length"))
