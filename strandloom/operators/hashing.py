"""K-mer hashing: first occurrences, roadmaps, reference hits and anchors.

K-mer rows have read_id BIGINT, pos INT (0-based) and kmer (canonical, any
orderable type), fwd BOOLEAN (the read spells the canonical form). Reads own
k-mers in order of (read_id, pos), whatever the order of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.packed import packed_kmers
from ..runtime import materialize
from .skew import join_counted


def kmer_rows(reads: DataFrame, k: int, strand_specific: bool = False, packed: bool = False) -> DataFrame:
    """read_id, pos, kmer, fwd for all k-mers of reads(read_id, seq, ...). Reads shorter than k give none.

    With `strand_specific`, the word itself is the key for first or single reads and the reverse
    complement for second mates (column second_in_pair). With `packed` (k <= 31) the keys are BIGINTs,
    made over Arrow batches, several times faster than cutting out texts."""
    if packed:
        return packed_kmers(reads, k, strand_specific)
    rows = reads.filter("seq is not null").select(
        "read_id", *(["second_in_pair"] if strand_specific else []), F.explode(dna.kmer_positions(dna.bases(F.col("seq")), k)).alias("x")
    )
    word, rc = F.col("x.word"), dna.revcomp(F.col("x.word"))
    if strand_specific:
        turned = F.coalesce("second_in_pair", F.lit(False))
        key, fwd = F.when(turned, rc).otherwise(word), ~turned
    else:
        key, fwd = F.least(word, rc), word <= rc
    return rows.select("read_id", F.col("x.pos").alias("pos"), key.alias("kmer"), fwd.alias("fwd"))


def first_occurrences(kmers: DataFrame, counted: bool = False) -> DataFrame:
    """kmer, owner (read), owner_pos, owner_fwd, coord: the number of the owner's new k-mers before it; n occurrences if asked for."""
    first = kmers.groupBy("kmer").agg(F.min(F.struct("read_id", "pos", "fwd")).alias("f"), *([F.count(F.lit(1)).alias("n")] if counted else []))
    rows = first.select("kmer", F.col("f.read_id").alias("owner"), F.col("f.pos").alias("owner_pos"), F.col("f.fwd").alias("owner_fwd"), *(["n"] if counted else []))
    w = W.partitionBy("owner").orderBy("owner_pos")
    return rows.withColumn("coord", (F.row_number().over(w) - 1).cast("bigint"))


def hits(kmers: DataFrame, hot: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """Each k-mer of each read with its owner: read_id, pos, novel, target (signed by strand), coord, written.

    `written` is the number of the read's new k-mers so far. K-mers with many occurrences are spread over tasks.
    `first` are the counted first occurrences where they have been written already."""
    if first is None:
        first, _ = materialize(first_occurrences(kmers, counted=True), "first")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_counted(kmers, first, "kmer", "n", total, ("read_id", "pos"), hot)
    novel = (F.col("owner") == F.col("read_id")) & (F.col("owner_pos") == F.col("pos"))
    w = W.partitionBy("read_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    sign = F.when(F.col("fwd") == F.col("owner_fwd"), 1).otherwise(-1)
    return joined.select("read_id", "pos", novel.alias("novel"), (F.col("owner") * sign).alias("target"), "coord").withColumn(
        "written", F.coalesce(F.sum(F.col("novel").cast("bigint")).over(w), F.lit(0))
    )


def roadmaps(kmers: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Run-length encoded hits: read_id, ord, target, position, start, finish (exclusive in its direction).

    Consecutive known k-mers with one target whose coordinates advance by +1 (or -1 if
    reversed) form a run; a new k-mer closes it. Position is the number of the read's new
    k-mers before the run. `first` as for `hits`."""
    rows = hits(kmers, first=first)
    w = W.partitionBy("read_id").orderBy("pos")
    step = F.when(F.col("target") > 0, 1).otherwise(-1)
    prev = F.lag(F.struct("novel", "target", "coord")).over(w)
    goes_on = ~F.col("p.novel") & (F.col("p.target") == F.col("target")) & (F.col("coord") == F.col("p.coord") + step)
    runs = (
        rows.withColumn("p", prev)
        .withColumn("head", (~F.col("novel") & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
        .withColumn("ord", F.sum("head").over(w))
        .filter(~F.col("novel"))
    )
    return runs.groupBy("read_id", "ord").agg(
        F.first("target").alias("target"), F.min("written").alias("position"), F.min_by("coord", "pos").alias("start"),
        (F.max_by("coord", "pos") + F.when(F.first("target") > 0, 1).otherwise(-1)).alias("finish"),
    )


def n_masks(seqs: DataFrame) -> DataFrame:
    """ref_id, start, finish (inclusive): runs of N (anything but ACGT) of seqs(ref_id, seq)."""
    marks = F.regexp_replace(dna.normalise(F.col("seq")), "[ACGT]", ".")
    parts = F.expr("split(m, '(?<=N)(?=[.])|(?<=[.])(?=N)')")
    rows = seqs.filter("length(seq) > 0").select("ref_id", marks.alias("m")).select("ref_id", F.posexplode(parts).alias("i", "part"))
    w = W.partitionBy("ref_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("part")).over(w), F.lit(0)))
    return placed.filter("part like 'N%'").select("ref_id", "start", (F.col("start") + F.length("part") - 1).alias("finish"))


def reference_index(seqs: DataFrame, k: int) -> DataFrame:
    """All unmasked k-mers of the references: kmer, ref_id (signed by strand), coord. A window with a masked base is left out."""
    rows = seqs.filter("seq is not null").select("ref_id", F.explode(dna.kmer_positions(dna.normalise(F.col("seq")), k)).alias("x"))
    word = F.col("x.word")
    rows = rows.filter(~word.contains("N"))
    rc = dna.revcomp(word)
    return rows.select(F.least(word, rc).alias("kmer"), (F.col("ref_id") * F.when(word <= rc, 1).otherwise(-1)).alias("ref"), F.col("x.pos").cast("bigint").alias("coord"))


def reference_hits(kmers: DataFrame, index: DataFrame) -> DataFrame:
    """read_id, pos, ref (signed by the read's strand on it), coord for each hit, duplicates kept."""
    return kmers.join(index, "kmer").select("read_id", "pos", (F.col("ref") * F.when(F.col("fwd"), 1).otherwise(-1)).alias("ref"), "coord")


def resolved_hits(found: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """One hit for each (read_id, pos): the only one, or the only one at the mapped position.

    mappings(read_id, ref, at): the read's base 0 lies at `at` of the signed reference.
    Several hits without a matching mapping, or two matching ones, are rejected."""
    n = F.count(F.lit(1)).over(W.partitionBy("read_id", "pos"))
    rows = found.withColumn("n", n)
    single = rows.filter("n = 1").select("read_id", "pos", "ref", "coord")
    if mappings is None:
        return single
    at = F.when(F.col("ref") > 0, F.col("at") + F.col("pos")).otherwise(F.col("at") - F.col("pos"))
    several = rows.filter("n > 1").join(mappings, ["read_id", "ref"]).filter(F.col("coord") == at).select("read_id", "pos", "ref", "coord").distinct()
    kept = several.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("read_id", "pos"))).filter("m = 1").drop("m")
    return single.unionByName(kept)


def nearest_anchor(rows: DataFrame) -> DataFrame:
    """For rows(read_id, pos, anchor nullable): the nearest anchored position before or after, ties to the later one."""
    back = W.partitionBy("read_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("read_id").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    here = F.when(F.col("anchor").isNotNull(), F.struct("pos", "anchor"))
    both = rows.withColumn("b", F.last(here, True).over(back)).withColumn("a", F.first(here, True).over(ahead))
    later = F.col("b").isNull() | (F.col("a").isNotNull() & (F.col("a.pos") - F.col("pos") <= F.col("pos") - F.col("b.pos")))
    near = F.when(later, F.col("a")).otherwise(F.col("b"))
    return both.select("read_id", "pos", "anchor", near.alias("near")).select("read_id", "pos", "anchor", F.col("near.pos").alias("near_pos"), F.col("near.anchor").alias("near_anchor"))


def anchored_hits(found: DataFrame, k: int) -> DataFrame:
    """Hits kept by the anchored scan of each read: after a break that follows an anchor, the next k-1 positions are
    passed over. The next state depends on the last decision, so each read is scanned in order (Arrow, one read a group)."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        pos, ref, coord = (pdf[c].to_numpy() for c in ("pos", "ref", "coord"))
        keep = np.zeros(len(pdf), bool)
        last, blocked = -1, -1
        for i in range(len(pdf)):
            if pos[i] < blocked:
                continue
            if last >= 0:
                step = 1 if ref[last] > 0 else -1
                if ref[i] != ref[last] or coord[i] - coord[last] != step * (pos[i] - pos[last]) or pos[i] != pos[last] + 1:
                    blocked = pos[last] + k
                    last = -1
                    if pos[i] < blocked:
                        continue
            keep[i], last = True, i
        return pdf[keep]

    return found.select("read_id", "pos", "ref", "coord").groupBy("read_id").applyInPandas(scan, "read_id bigint, pos int, ref bigint, coord bigint")
