"""Running k-mer counts and coverage over arriving reads (Structured Streaming).

Counts are kept by event-time windows with a watermark, so state stays bounded;
rows later than the watermark are dropped by Spark and counted in its progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def kmer_counts(reads: DataFrame, k: int, time: str = "loaded_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window, kmer (packed), n for streaming or batch reads(seq, <time>). Reads delivered again inside the watermark count once."""
    rows = reads.filter("seq is not null").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    words = rows.select(F.col(time), F.explode(dna.kmer_positions(dna.bases(F.col("seq")), k)).alias("x"))
    return words.groupBy(F.window(time, window).alias("window"), dna.pack(dna.canonical(F.col("x.word"))).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def read_lengths(reads: DataFrame, time: str = "loaded_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window, library, reads, bases; a read delivered again inside the watermark counts once."""
    rows = reads.filter("read_id is not null and seq is not null").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.dropDuplicatesWithinWatermark(["read_id"]) if reads.isStreaming else rows.dropDuplicates(["read_id"])
    return rows.groupBy(F.window(time, window).alias("window"), "library").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))
