"""The doubly-stranded graph: chains, concatenation, threading, tips and bubbles.

Tables: nodes(node_id BIGINT > 0, length BIGINT in k-mers, cov BIGINT, seq STRING of
length + k - 1 bases) and arcs(src, dst, mult) in canonical direction; `-n` is the
twin of node n, and an arc a to b is also -b to -a.

Order-dependent edits are done in synchronous rounds with fixed ties: of two equal
rivals the one with the higher id gives way. Every round is written to the shared
folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.arrow import mix64
from ..functions.kernels import lcs_score
from ..runtime import discard, materialize, materialize_split, shuffle_partitions
from . import stats
from ..functions.packed import packed_kmers
from .hashing import kmer_rows
from .ordered import numbered


def _double(rows: DataFrame, spark) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling on (u, ptr, dist, low, done) until the rest can only be cycles: (settled, in cycles).

    A round writes the rows that were open, settled ones apart, and no settled one again; what was open before is discarded.
    A round that settles nothing leaves cycles only; rounds then go on until each window has covered its whole cycle, so
    that `low` is the cycle's smallest node."""
    (settled, _), (open_, path) = materialize_split(rows, "done", "ptr")
    left, reach = open_.count(), 1
    while left:
        reach *= 2
        to = settled.unionByName(open_).select(F.col("u").alias("t"), F.col("ptr").alias("t_ptr"), F.col("dist").alias("t_dist"), F.col("low").alias("t_low"), F.col("done").alias("t_done"))
        moved = open_.join(to, F.col("ptr") == F.col("t")).select(
            "u", F.col("t_ptr").alias("ptr"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.least("low", "t_low").alias("low"), F.col("t_done").alias("done")
        )
        (more, _), (after, new) = materialize_split(moved, "done", "ptr")
        discard(spark, path)
        settled, open_, path = settled.unionByName(more), after, new
        now = open_.count()
        if now == left and reach >= left:
            break
        left = now
    return settled, open_


def _starts(links: DataFrame) -> DataFrame:
    """Rows for `_double` of links(u, v, w): every vertex points at the one before it, w steps back."""
    vertices = links.select("u").unionByName(links.select(F.col("v").alias("u"))).distinct()
    back = links.select(F.col("v").alias("u"), F.col("u").alias("p"), "w")
    return vertices.join(back, "u", "left").select(
        "u", F.coalesce("p", "u").alias("ptr"), F.coalesce("w", F.lit(0)).cast("bigint").alias("dist"), F.least(F.abs("u"), F.abs(F.coalesce("p", "u"))).alias("low"), F.col("p").isNull().alias("done"),
    )


def chains(links: DataFrame) -> DataFrame:
    """u, head, rank for every vertex of links(u, v), where each u and each v occurs once.

    List ranking by pointer doubling, about log2(longest chain) rounds. A pure cycle is cut
    at its smallest node and ranked from there."""
    spark = links.sparkSession
    back = links.select(F.col("v").alias("u"), F.col("u").alias("p"))
    settled, cyclic = _double(_starts(links.withColumn("w", F.lit(1))), spark)
    out = settled.select("u", F.col("ptr").alias("head"), F.col("dist").alias("rank"))
    if cyclic.limit(1).count():
        # every window has long covered its cycle: `low` is the cycle's smallest node. The cut lies in
        # front of that node on its own strand and behind it on the other, so twins stay twins
        cut = (F.col("u") == F.col("low")) | (F.col("p") == -F.col("low"))
        again = cyclic.select("u", "low").join(back, "u").select(
            "u", F.when(cut, F.col("u")).otherwise(F.col("p")).alias("ptr"), F.when(cut, 0).otherwise(1).cast("bigint").alias("dist"), "low", cut.alias("done"),
        )
        rest, _ = _double(again, spark)
        out = out.unionByName(rest.select("u", F.col("ptr").alias("head"), F.col("dist").alias("rank")))
    return out


#: Letters of the words that tell which k-mers go to one place.
PLACE = 10
#: Links that a task holds before it ranks those of whole places.
HELD = 1 << 20


def place_ranks(k: int) -> tuple[int, np.ndarray]:
    """Letters of the shorter words that tell the places of k-mers, and the hash of each such packed word, strands alike."""
    m = min(k, PLACE)
    word = np.arange(4**m, dtype=np.int64)
    turned, left = np.zeros_like(word), word.copy()
    for _ in range(m):
        turned, left = (turned << 2) | (3 - (left & 3)), left >> 2
    return m, mix64(np.minimum(word, turned).astype(np.uint64) + np.uint64(1)) >> np.uint64(1)


def kmer_places(k: int) -> Callable[[np.ndarray], np.ndarray]:
    """The place of k-mer nodes (signed packed codes plus one): the least hash among their shorter words, strands alike.

    Neighbours share all but one letter and so mostly the place."""
    m, rank = place_ranks(k)

    def place(ids: np.ndarray) -> np.ndarray:
        code = np.abs(ids) - 1
        out = np.full(len(ids), np.iinfo(np.uint64).max, np.uint64)
        for i in range(k - m + 1):
            out = np.minimum(out, rank[(code >> (2 * i)) & (4**m - 1)])
        return out.astype(np.int64)

    return place


def _placed(place: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            p = place(u)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(p == place(v))], names=["u", "v", "place", "near"])

    return run


_RANKED = "x bigint, first bigint, within bigint, next bigint"


def _ranked_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v, place) sorted by place, each inside one place: every vertex with the first one of its stretch there and its
    rank in it. Vertices of a cycle inside a place stay alone, with their next one."""

    def ranked(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        ids = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
        here = np.arange(len(ids))
        before, after = np.full(len(ids), -1), np.full(len(ids), -1)
        before[b], after[a] = a, b
        to, dist = np.where(before < 0, here, before), (before >= 0).astype(np.int64)
        for _ in range(len(ids).bit_length() + 1):
            step = to[to]
            if (step == to).all():
                break
            dist, to = dist + dist[to], step
        round_ = before[to] >= 0
        first, within = np.where(round_, here, to), np.where(round_, 0, dist)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(ids[first]), pa.array(within), pa.array(ids[after], mask=~round_)], names=["x", "first", "within", "next"]
        )

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append(rows)
        size += len(rows[0])
        if size > HELD:
            u, v, place = (np.concatenate(x) for x in zip(*held, strict=True))
            # the last place may go on
            cut = int(np.searchsorted(place, place[-1], "left"))
            if cut:
                yield ranked(u[:cut], v[:cut])
            held, size = [(u[cut:], v[cut:], place[cut:])], len(u) - cut
    if size:
        yield ranked(*(np.concatenate(x) for x in list(zip(*held, strict=True))[:2]))


def placed_chains(links: DataFrame, place: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """As `chains`, for vertices of which neighbours mostly have one place.

    The links inside a place are ranked there, in one pass; only the stretches that come out, a fraction of the vertices,
    are ranked by pointer doubling."""
    spark = links.sparkSession
    parts = shuffle_partitions(spark)
    (near, a), (far, b) = materialize_split(links.select("u", "v").mapInArrow(_placed(place), "u bigint, v bigint, place bigint, near boolean"), "near", "placed")
    local, c = materialize(near.select("u", "v", "place").repartition(parts, "place").sortWithinPartitions("place").mapInArrow(_ranked_places, _RANKED), "places")
    cross = far.select("u", "v").unionByName(local.filter("next is not null").select(F.col("x").alias("u"), F.col("next").alias("v")))
    of = local.select("x", "first", "within")
    between = cross.join(of, F.col("u") == F.col("x"), "left").select(F.coalesce("first", "u").alias("u"), "v", (F.coalesce("within", F.lit(0)) + 1).alias("w"))
    between, d = materialize(between, "between")
    settled, cyclic = _double(_starts(between), spark)
    # a vertex with far links only stands in no place
    ends = cross.select("u").unionByName(cross.select(F.col("v").alias("u"))).distinct()
    alone = ends.join(of.select(F.col("x").alias("u")), "u", "left_anti").select(F.col("u").alias("x"), F.col("u").alias("first"), F.lit(0).cast("bigint").alias("within"))
    every = of.unionByName(alone)
    ahead = settled.select(F.col("u").alias("first"), F.col("ptr").alias("head"), "dist")
    round_ = cyclic.select(F.col("u").alias("first"))
    some = bool(round_.limit(1).count())
    if some:
        inside = every.join(round_, "first", "left_semi").select(F.col("x").alias("u"))
        again, _ = materialize(chains(links.join(inside, "u", "left_semi").select("u", "v")), "cycles")
        every = every.join(round_, "first", "left_anti")
    out = every.join(ahead, "first", "left").select(F.col("x").alias("u"), F.coalesce("head", "first").alias("head"), (F.coalesce("dist", F.lit(0)) + F.col("within")).alias("rank"))
    ranks, _ = materialize(out.unionByName(again) if some else out, "ranks")
    for path in (a, b, c, d):
        discard(spark, path)
    return ranks


def simple_links(arcs: DataFrame) -> DataFrame:
    """u, v on both strands: arcs that are the only one at both facing ends; no self loops or hairpins."""
    both = stats.both_strands(arcs)
    degrees_out = both.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    degrees_in = both.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    one = both.filter("src <> dst and src <> -dst")
    return one.join(degrees_out.filter("o = 1"), "src").join(degrees_in.filter("i = 1"), "dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))


def concatenate(nodes: DataFrame, arcs: DataFrame, k: int, scratch: list[str] | None = None, place: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge all unambiguous chains: (nodes, arcs, members as in `joining`: old signed id, new id, start, total).

    New ids are dense, in order of the smallest old id in the chain. One strand of each chain
    is kept; of a chain that is its own twin, the half from the smaller head. Paths of the tables written are
    added to `scratch`; who passes it may discard them once nothing reads this result any more. `place` is for nodes of
    which neighbours mostly have one place, see `placed_chains`."""
    spark, kept_paths = nodes.sparkSession, []

    def written(df: DataFrame, label: str) -> DataFrame:
        out, path = materialize(df, label)
        kept_paths.append(path)
        return out

    simple = written(simple_links(arcs), "simple")
    ranks = written(chains(simple) if place is None else placed_chains(simple, place), "ranks")
    tails = ranks.groupBy("head").agg(F.max_by("u", "rank").alias("tail"), F.min(F.abs("u")).alias("low"))
    kept = tails.filter("head < -tail or head = -tail").select("head", "low")
    members = ranks.join(kept, "head")
    # a chain that is its own twin holds each node twice: keep the first visit
    first = W.partitionBy(F.col("head"), F.abs("u")).orderBy("rank")
    members = members.withColumn("visit", F.row_number().over(first)).filter("visit = 1").drop("visit")
    single = nodes.select(F.col("node_id").alias("u")).join(members.select(F.abs("u").alias("u")).distinct(), "u", "left_anti")
    alone = single.select("u", F.col("u").alias("head"), F.lit(0).cast("bigint").alias("rank"), F.col("u").alias("low"))
    every = written(members.select("u", "rank", "low").unionByName(alone.select("u", "rank", "low")), "members")
    # one chain can come from either strand, so its smallest member names it
    heads = numbered(every.select("low").distinct(), ["low"], "new_id")
    length = nodes.select(F.col("node_id").alias("__n"), "length")
    mapping = every.join(heads, "low").join(length, F.abs("u") == F.col("__n")).select(F.col("u").alias("old"), F.col("new_id").alias("new"), "rank", "length")
    mapping = written(mapping, "map")
    placed = mapping.join(nodes.select(F.col("node_id").alias("__n"), "cov", "seq"), F.abs("old") == F.col("__n"))
    seq = F.when(F.col("old") > 0, F.col("seq")).otherwise(dna.revcomp(F.col("seq")))
    piece = F.when(F.col("rank") == 0, F.col("s")).otherwise(F.expr(f"substring(s, {k})"))
    merged = placed.withColumn("s", seq).withColumn("piece", piece).groupBy(F.col("new").alias("node_id")).agg(
        F.sum("length").alias("length"), F.sum("cov").alias("cov"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"])).alias("seq"),
    )
    merged = written(merged, "nodes")
    both = mapping.select("old", "new").unionByName(mapping.select((-F.col("old")).alias("old"), (-F.col("new")).alias("new")))
    # a link inside a chain, unless it is the one at which a cycle was cut: that leads to a chain's first vertex
    inside = simple.join(ranks.filter("rank = 0").select(F.col("u").alias("v")), "v", "left_anti").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    outer = arcs.join(inside, ["src", "dst"], "left_anti")
    renamed = outer.join(both.select(F.col("old").alias("src"), F.col("new").alias("a")), "src").join(
        both.select(F.col("old").alias("dst"), F.col("new").alias("b")), "dst"
    ).select(F.col("a").alias("src"), F.col("b").alias("dst"), "mult")
    new_arcs = written(stats.canonical_arcs(renamed), "arcs")
    before = W.partitionBy("new").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    at = mapping.select(
        "old", "new", (F.sum("length").over(before) - F.col("length")).alias("start"), F.sum("length").over(W.partitionBy("new")).alias("total")
    )
    if scratch is not None:
        scratch += kept_paths
    else:
        for path in kept_paths[:3]:
            discard(spark, path)
    return merged, new_arcs, at


def kmer_graph(reads: DataFrame, k: int, strand_specific: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of one k-mer each and arcs between consecutive k-mers of reads(read_id, seq), k <= 31 and odd.

    Ids are packed k-mers plus one. With `strand_specific` a k-mer and its reverse complement are two nodes."""
    rows = kmer_rows(reads, k, strand_specific, packed=True).withColumn("node", (F.col("kmer") + 1) * F.when(F.col("fwd"), 1).otherwise(-1))
    nodes = rows.groupBy((F.col("kmer") + 1).alias("node_id")).agg(F.lit(1).cast("bigint").alias("length"), F.count(F.lit(1)).alias("cov"))
    nodes = nodes.withColumn("seq", dna.unpack(F.col("node_id") - 1, k))
    w = W.partitionBy("read_id").orderBy("pos")
    steps = rows.withColumn("dst", F.lead("node").over(w)).filter("dst is not null")
    arcs = stats.canonical_arcs(steps.select(F.col("node").alias("src"), "dst", F.when(F.col("node") == -F.col("dst"), 2).otherwise(1).cast("bigint").alias("mult")))
    return nodes, arcs


def unitigs(reads: DataFrame, k: int, strand_specific: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs of the graph with all unambiguous chains merged."""
    spark = reads.sparkSession
    (nodes, a), (arcs, b) = (materialize(x, "kmers") for x in kmer_graph(reads, k, strand_specific))
    merged, new_arcs, _ = concatenate(nodes, arcs, k, place=kmer_places(k))
    discard(spark, a)
    discard(spark, b)
    return merged, new_arcs


def node_kmers(nodes: DataFrame, k: int, strand_specific: bool = False) -> DataFrame:
    """kmer (packed, canonical), node (signed: strand on which the node spells it), off; k-mers with other letters are left out.

    A k-mer that stands on nodes more than once is taken at its first place in order of node and offset."""
    rows = nodes.select(F.col("node_id").alias("read_id"), "seq", F.lit(False).alias("second_in_pair"))
    words = packed_kmers(rows, k, strand_specific, known=True)
    place = F.struct(F.col("read_id").alias("id"), F.col("pos").cast("bigint").alias("off"), (F.col("read_id") * F.when(F.col("fwd"), 1).otherwise(-1)).alias("node"))
    return words.groupBy("kmer").agg(F.min(place).alias("p")).select("kmer", "p.node", "p.off")


def thread(reads: DataFrame, nodes: DataFrame, k: int, strand_specific: bool = False) -> DataFrame:
    """read_id, category, pos, node (signed), off for the k-mers of each read that lie on the graph.

    K-mers before the first hit are passed over; the first miss after a hit ends the read."""
    of = W.partitionBy("read_id")
    # k-mers of each copy of a read that is given more than once; null for the others
    copies = F.when(F.count(F.lit(1)).over(of) > 1, F.collect_list(F.length("seq") - (k - 1)).over(of))
    kmers = packed_kmers(reads.filter("read_id is not null and seq is not null").withColumn("copies", copies), k, strand_specific, extra=("category", "copies"))
    # the optimizer reckons k-mers as rows of the size of a read, about a hundred times too few bytes: neither side is broadcast
    hits = kmers.join(node_kmers(nodes, k, strand_specific).hint("merge"), "kmer").withColumn("node", F.when(F.col("fwd"), F.col("node")).otherwise(-F.col("node")))
    # only hits are brought together by read: a miss is a gap between their positions, or a copy that is not among them
    w = W.partitionBy("read_id").orderBy("pos")
    due = F.when(F.col("copies").isNull(), 1).otherwise(F.size(F.filter("copies", lambda n: n > F.col("pos"))))
    whole = hits.withColumn("all", F.count(F.lit(1)).over(w.rangeBetween(W.currentRow, W.currentRow)) == due)
    run = whole.withColumn("unbroken", F.min("all").over(w) & (F.dense_rank().over(w) - 1 == F.col("pos") - F.min("pos").over(w)))
    return run.filter("unbroken").select("read_id", "category", "pos", "node", "off")


def coverage(threads: DataFrame) -> DataFrame:
    """node_id, category, cov: threaded k-mers."""
    return threads.groupBy(F.abs("node").alias("node_id"), "category").agg(F.count(F.lit(1)).alias("cov"))


def read_starts(threads: DataFrame, nodes: DataFrame) -> DataFrame:
    """node (signed), read_id, position (k-mers from the signed node's start), offset (in the read) of each read's first
    entry into a node; position -1 when it enters again. A read's twin strand is not listed."""
    w = W.partitionBy("read_id").orderBy("pos")
    entry = threads.withColumn("prev", F.lag("node").over(w)).filter("prev is null or prev <> node")
    rows = entry.groupBy("node", "read_id").agg(F.min(F.struct("pos", "off")).alias("p"), F.count(F.lit(1)).alias("n"))
    at = rows.join(nodes.select(F.col("node_id").alias("i"), "length"), F.abs("node") == F.col("i"))
    position = F.when(F.col("n") > 1, -1).when(F.col("node") > 0, F.col("p.off")).otherwise(F.col("length") - 1 - F.col("p.off"))
    return at.select("node", "read_id", position.cast("bigint").alias("position"), F.col("p.pos").cast("bigint").alias("offset"))


def arcs_of_threads(threads: DataFrame) -> DataFrame:
    w = W.partitionBy("read_id").orderBy("pos")
    steps = threads.withColumn("dst", F.lead("node").over(w)).filter("dst is not null and dst <> node")
    return stats.canonical_arcs(steps.select(F.col("node").alias("src"), "dst", F.when(F.col("node") == -F.col("dst"), 2).otherwise(1).cast("bigint").alias("mult")))


def dead_ends(nodes: DataFrame, arcs: DataFrame, k: int, minority: bool) -> DataFrame:
    """node_id of tips: nodes shorter than 2k with nothing on one side.

    With `minority` a tip must be isolated, or hang on an arc of multiplicity 1, or on one that is
    not the strongest at its junction. Without it every such tip is meant."""
    both = stats.both_strands(arcs)
    out = both.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("o"))
    short = nodes.filter(F.col("length") < 2 * k).select("node_id")
    sides = short.select(F.explode(F.array(F.col("node_id"), -F.col("node_id"))).alias("n"))
    dead = sides.join(out, "n", "left_anti")  # nothing leaves on this side
    if not minority:
        return dead.select(F.abs("n").alias("node_id")).distinct()
    at = both.withColumn("best", F.max("mult").over(W.partitionBy("src")))
    held = dead.join(at.select(F.col("dst").alias("n"), "mult", "best", F.col("src")), "n", "left")
    # the strongest arc at the junction keeps its tip; equal rivals: the higher id gives way
    rival = at.filter("mult = best").groupBy("src").agg(F.min(F.abs("dst")).alias("winner"))
    judged = held.join(rival, "src", "left")
    lost = F.col("src").isNull() | (F.col("mult") == 1) | (F.col("mult") < F.col("best")) | (F.abs("n") != F.col("winner"))
    return judged.groupBy(F.abs("n").alias("node_id")).agg(F.min(lost.cast("int")).alias("all_lost")).filter("all_lost = 1").select("node_id")


def _thrown_away(spark, paths: list[str]) -> None:
    for p in paths:
        discard(spark, p)


def clip_tips(nodes: DataFrame, arcs: DataFrame, k: int, minority: bool = True, spared: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Clip tips and merge what became unambiguous, until nothing changes: every round takes nodes away, so it ends.

    `spared` gives, for the nodes of a round, those (node_id) that are never clipped."""
    spark, before = nodes.sparkSession, []
    while True:
        gone = dead_ends(nodes, arcs, k, minority)
        if spared is not None:
            gone = gone.join(spared(nodes), "node_id", "left_anti")
        gone, path = materialize(gone, "tips")
        if not gone.limit(1).count():
            return nodes, arcs
        new: list[str] = []
        nodes, arcs = removed(nodes, arcs, gone)
        nodes, arcs, _ = concatenate(nodes, arcs, k, new)
        _thrown_away(spark, [*before, path])
        before = new


def removed(nodes: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of `gone` (node_id) and their arcs."""
    left = nodes.join(gone, "node_id", "left_anti")
    ends = gone.select(F.col("node_id").alias("g"))
    kept = arcs.join(ends, F.abs("src") == F.col("g"), "left_anti").join(ends, F.abs("dst") == F.col("g"), "left_anti")
    return left, kept


def tours(nodes: DataFrame, arcs: DataFrame, max_branch: int = 100) -> DataFrame:
    """start, stop, fast, slow: two walks of distinct nodes from one start that meet again at one stop.

    From every signed node with several arcs, walks go on together, an arc a round. A step takes the time length /
    multiplicity of the node it leaves. Of the walks of one start that reach a node, the one with the least time goes on;
    each other one makes a pair with it. The nodes between are at most `max_branch` k-mers long in all, so a start's
    walks stay near it. A pair is given once for both strands."""
    info = nodes.select(F.col("node_id").alias("i"), F.col("length").alias("l"))
    both, _ = materialize(
        stats.both_strands(arcs).join(info, F.abs("src") == F.col("i")).select(F.col("src").alias("s"), F.col("dst").alias("d"), (F.col("l") / F.greatest("mult", F.lit(1))).alias("cost")), "steps"
    )
    several = both.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s")
    none = F.array().cast("array<bigint>")
    walk = both.join(several, "s").filter("abs(d) <> abs(s)").select(F.col("s").alias("start"), F.col("d").alias("at"), none.alias("path"), F.lit(0).cast("bigint").alias("inner"), F.col("cost").alias("time"))
    settled = met = None
    while True:
        order = W.partitionBy("start", "at").orderBy("time", "path")
        ranked = walk.withColumn("r", F.row_number().over(order)).withColumn("best", F.first(F.struct("path", "time")).over(order))
        if settled is None:
            ranked = ranked.withColumn("old", F.lit(None).cast("struct<path:array<bigint>,time:double>"))
        else:
            ranked = ranked.join(settled.select("start", "at", F.struct("path", "time").alias("old")), ["start", "at"], "left")
        ranked, _ = materialize(ranked, "tours")
        other = F.coalesce("old", "best")
        pair = ranked.filter("old is not null or r > 1").select("start", F.col("at").alias("stop"), F.struct("time", "path").alias("a"), F.struct(other["time"].alias("time"), other["path"].alias("path")).alias("b"))
        met = pair if met is None else met.unionByName(pair)
        new = ranked.filter("old is null and r = 1").select("start", "at", "path", "inner", "time")
        settled = new if settled is None else settled.unionByName(new)
        on = new.join(info, F.abs("at") == F.col("i")).filter(F.col("inner") + F.col("l") <= max_branch).join(both, F.col("at") == F.col("s"))
        on = on.filter((F.abs("d") != F.abs("start")) & (F.abs("d") != F.abs("at")) & ~F.array_contains(F.transform("path", F.abs), F.abs("d")))
        walk, _ = materialize(on.select("start", F.col("d").alias("at"), F.array_append("path", F.col("at")).alias("path"), (F.col("inner") + F.col("l")).alias("inner"), (F.col("time") + F.col("cost")).alias("time")), "tour")
        if not walk.limit(1).count():
            break
    fast, slow = F.least("a", "b")["path"], F.greatest("a", "b")["path"]
    plain = lambda c: F.transform(c, F.abs)
    found = met.select("start", "stop", fast.alias("fast"), slow.alias("slow")).filter(
        (F.size("fast") > 0) & (F.size("slow") > 0) & (F.col("fast")[0] != F.col("slow")[0]) & ~F.arrays_overlap(plain("fast"), plain("slow"))
        & ~F.array_contains(plain("fast"), F.abs("stop")) & ~F.array_contains(plain("slow"), F.abs("stop"))
    )
    # the other strand tells of the same pair
    turn = F.col("start") > -F.col("stop")
    back = lambda c: F.when(turn, F.reverse(F.transform(c, lambda x: -x))).otherwise(F.col(c))
    one = found.select(F.when(turn, -F.col("stop")).otherwise(F.col("start")).alias("start"), F.when(turn, -F.col("start")).otherwise(F.col("stop")).alias("stop"), back("fast").alias("fast"), back("slow").alias("slow"))
    set_ = F.array_sort(F.concat(plain("fast"), plain("slow")))
    return one.groupBy("start", "stop", set_.alias("set")).agg(F.min(F.struct("fast", "slow")).alias("x")).select("start", "stop", "x.fast", "x.slow")


def bubbles(nodes: DataFrame, arcs: DataFrame, k: int, max_gaps: int = 3, max_divergence: float = 0.2, max_branch: int = 100) -> DataFrame:
    """start, stop, fast, slow and the nodes' lengths: the pairs of `tours` whose letters align well enough, no two in conflict.

    A pair is in conflict with another one that holds a node of its slow walk; the one with the smaller key stays for now."""
    pairs, _ = materialize(tours(nodes, arcs, max_branch).withColumn("id", F.xxhash64("start", "stop", "fast", "slow")), "pairs")
    own = nodes.select(F.col("node_id").alias("i"), "length", "seq")
    letters = F.when(F.col("x") > 0, F.col("seq")).otherwise(dna.revcomp(F.col("seq"))).substr(F.lit(k), F.length("seq"))
    for side in ("fast", "slow"):
        rows = pairs.select("id", F.posexplode(side).alias("at", "x")).join(own, F.abs("x") == F.col("i"))
        listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", letters.alias("p"), "length"))).alias("rows"))
        pairs = pairs.join(listed.select("id", F.concat_ws("", F.transform("rows", lambda x: x["p"])).alias(f"{side}_text"), F.transform("rows", lambda x: x["length"]).alias(f"{side}_length")), "id")
    most = F.greatest(F.length("fast_text"), F.length("slow_text"))
    good = pairs.withColumn("score", lcs_score(F.col("fast_text"), F.col("slow_text"))).filter(
        (F.col("score") >= most - max_gaps) & (1 - F.col("score") / F.greatest(most, F.lit(1)) <= max_divergence)
    ).select("id", "start", "stop", "fast", "slow", "fast_length", "slow_length")
    good, _ = materialize(good, "aligned")
    held = good.select("id", F.explode(F.array_union(F.array(F.abs("start"), F.abs("stop")), F.transform("fast", F.abs))).alias("n"), F.lit(False).alias("goes")).unionByName(
        good.select("id", F.explode(F.transform("slow", F.abs)).alias("n"), F.lit(True).alias("goes"))
    )
    least = held.groupBy("n").agg(F.min("id").alias("least"), F.max("goes").alias("goes")).filter("goes").select("n", "least")
    late = held.join(least, "n").filter("id <> least").select("id").distinct()
    return good.join(late, "id", "left_anti")


_FOLD = "x bigint, out_to bigint, in_to bigint, cov_to bigint"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a slow walk, where arcs that leave or enter it go, and which node takes its coverage.

    Both walks are laid over each other in proportion; a border between slow nodes moves to the nearest border of the fast
    walk, the start's end and the stop's beginning included, so arcs inside the slow walk fall on arcs of the fast one."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ends = np.cumsum(r["fast_length"])
            borders = np.concatenate([[0], ends])
            leaving, entering = [r["start"], *r["fast"]], [*r["fast"], r["stop"]]
            scale, at = ends[-1] / sum(r["slow_length"]), 0
            for x, size in zip(r["slow"], r["slow_length"], strict=True):
                first, last = (int(np.abs(borders - scale * p).argmin()) for p in (at, at + size))
                middle = int(np.searchsorted(ends, scale * (at + size / 2), "left"))
                out.append((x, leaving[last], entering[first], abs(r["fast"][min(middle, len(ends) - 1)])))
                at += size
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["x", "out_to", "in_to", "cov_to"])


def pop_bubbles(nodes: DataFrame, arcs: DataFrame, k: int, **limits) -> tuple[DataFrame, DataFrame]:
    """Merge bubbles until none is left; every round takes nodes away, so it ends.

    The slow walk's coverage moves to the fast one, its arcs are added to those of the fast walk, and side branches hang on
    the fast walk's border nearest to their place."""
    spark, before = nodes.sparkSession, []
    while True:
        found = bubbles(nodes, arcs, k, **limits)
        moves, path = materialize(found.select("start", "stop", "fast", "slow", "fast_length", "slow_length").mapInArrow(_folded, _FOLD), "bubbles")
        if not moves.limit(1).count():
            return nodes, arcs
        more = moves.select(F.abs("x").alias("node_id"), "cov_to").join(nodes.select("node_id", "cov"), "node_id").groupBy(F.col("cov_to").alias("node_id")).agg(F.sum("cov").alias("more"))
        left = nodes.join(moves.select(F.abs("x").alias("node_id")), "node_id", "left_anti").join(more, "node_id", "left")
        left = left.withColumn("cov", F.col("cov") + F.coalesce("more", F.lit(0))).drop("more")
        # the twin of a slow node: what leaves it is what enters the node
        as_src = moves.select(F.col("x").alias("src"), F.col("out_to").alias("a")).unionByName(moves.select((-F.col("x")).alias("src"), (-F.col("in_to")).alias("a")))
        as_dst = moves.select(F.col("x").alias("dst"), F.col("in_to").alias("b")).unionByName(moves.select((-F.col("x")).alias("dst"), (-F.col("out_to")).alias("b")))
        renamed = arcs.join(as_src, "src", "left").join(as_dst, "dst", "left")
        moved = stats.canonical_arcs(renamed.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "mult"))
        new: list[str] = []
        nodes, arcs, _ = concatenate(left, moved, k, new)
        _thrown_away(spark, [*before, path])
        before = new


def local_handicaps(nodes: DataFrame, arcs: DataFrame, chosen: DataFrame, k: int, **limits) -> DataFrame:
    """node_id of the nodes that correction would take away in the part of the graph made of `chosen` (node_id): the slow
    walks of its bubbles and its dead ends. The graph stays as it is; scaffolding passes these nodes over."""
    from .traverse import subgraph

    own, inner = subgraph(nodes, arcs, chosen)
    slow = bubbles(own, inner, k, **limits).select(F.explode(F.transform("slow", F.abs)).alias("node_id"))
    return slow.unionByName(dead_ends(own, inner, k, minority=True)).distinct()


def dot(arcs: DataFrame) -> DataFrame:
    """GraphViz lines of arcs with left and right ports."""
    def end(c: str, near: str, far: str):
        return F.format_string(f"%d:%s", F.abs(c), F.when(F.col(c) > 0, near).otherwise(far))

    return arcs.select(F.format_string("  %s -> %s [label=%d];", end("src", "right", "left"), end("dst", "left", "right"), F.col("mult")).alias("line"))
