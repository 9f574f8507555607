"""Equivalence of layouts, and files that must be refused."""

import bz2
import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.sources import seqreads, sinks

FASTA = ">r1 note\nACGT\nACG\n>r2\nNNAC\n\n>r3\n"
FASTQ = "@r1 note\nACGT\nACG\n+\nIIII\n@II\n@r2\nNNAC\n+r2\nIIII\n"


def write(path, data, how=open):
    with how(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return str(path)


def rows(df):
    return [(r.name, r.seq) for r in df.orderBy("file", "ordinal").collect()]


def test_fasta_equals_fastq_in_any_packing(spark, tmp_path):
    want = [("r1", "ACGTACG"), ("r2", "NNAC")]
    fq = write(tmp_path / "a.fq", FASTQ)
    gz = write(tmp_path / "a.fq.gz", FASTQ, gzip.open)
    bz = write(tmp_path / "a.fq.bz2", FASTQ, bz2.open)
    for p in (fq, gz, bz):
        assert rows(seqreads.scan(spark, p)) == want
    fa = write(tmp_path / "a.fa", FASTA)
    assert rows(seqreads.scan(spark, fa)) == [*want, ("r3", "")]
    assert rows(seqreads.scan(spark, fa, "fasta")) == [*want, ("r3", "")]
    split = seqreads.fasta_split(spark, fa).orderBy("block", "within").collect()
    assert [(r.name, r.seq) for r in split] == [*want, ("r3", "")]


def test_short_quality_ends_the_file(spark, tmp_path):
    p = write(tmp_path / "b.fq", "@a\nAC\n+\nII\n@b\nACG\n+\nII\n@c\nAC\n+\nII\n")
    assert [n for n, _ in rows(seqreads.scan(spark, p, "fastq"))] == ["a"]


def test_wrong_first_byte_and_missing_file(spark, tmp_path):
    p = write(tmp_path / "c.txt", "hello\n")
    with pytest.raises(Exception):
        seqreads.scan(spark, p).count()
    with pytest.raises(Exception):
        seqreads.scan(spark, str(tmp_path / "none.fa")).count()


def test_pairs_by_position(spark, tmp_path):
    a = seqreads.scan(spark, write(tmp_path / "1.fa", ">x\nAA\n>y\nCC\n"))
    b = seqreads.scan(spark, write(tmp_path / "2.fa", ">x2\nGG\n>y2\nTT\n"))
    got = seqreads.zipped(a, b).orderBy("ordinal").collect()
    assert [(r.ordinal, r.name) for r in got] == [(0, "x"), (1, "x2"), (2, "y"), (3, "y2")]
    ids = seqreads.read_ids(seqreads.zipped(a, b), 1).orderBy("read_id").collect()
    assert [(r.read_id, r.is_paired) for r in ids] == [(1, True), (2, True), (3, True), (4, True)]
    c = seqreads.scan(spark, write(tmp_path / "3.fa", ">z\nGG\n"))
    with pytest.raises(Exception):
        seqreads.zipped(a, c).collect()


def test_sam_and_bam_agree(spark, tmp_path):
    text = "@HD\tVN:1\nr1\t99\tref\t5\t60\t2S4M\t=\t20\t0\tACGTAC\t*\nr1\t147\tref\t20\t60\t3M1D3M\t=\t5\t0\tGGGTTT\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\n"
    s = seqreads.scan(spark, write(tmp_path / "a.sam", text), "sam")

    def record(name, flag, ref, pos, cigar, seq):
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        packed = bytes(("=ACMGRSVTWYHKDBN".index((seq + "=")[i]) << 4) | "=ACMGRSVTWYHKDBN".index((seq + "=")[i + 1]) for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + b"\xff" * len(seq)
        return struct.pack("<i", len(body)) + body

    bam = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"ref\0" + struct.pack("<i", 100)
    bam += record("r1", 99, 0, 5, [(2, "S"), (4, "M")], "ACGTAC") + record("r1", 147, 0, 20, [(3, "M"), (1, "D"), (3, "M")], "GGGTTT") + record("r2", 4, -1, 0, [], "ACG")
    b = seqreads.scan(spark, write(tmp_path / "a.bam", bam, gzip.open), "bam")
    key = lambda df: [(r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq) for r in df.orderBy("ordinal").collect()]
    assert key(s) == key(b)
    reads = {r.name: r for r in seqreads.aligned_reads(s, paired=True).collect()}
    assert reads["r1/2"].seq == "AAACCC" and reads["r1/1"].is_paired and not reads["r2"].is_paired and reads["r2"].mappings == []
    blocks = sorted((r.qname, r.block_pos) for r in seqreads.cigar_blocks(s).collect())
    assert blocks == [("r1", 3), ("r1", 20), ("r1", 21)]


def test_blocks_give_what_the_data_source_gives(spark, tmp_path):
    """Files cut into many small blocks, in an order of sizes that differs from that of names."""
    fq = {f"{i}.fq": "".join(f"@r{i}_{j} x\nACGT{'ACGT'[j % 4] * (j % 9)}\n+\nIIII{'I' * (j % 9)}\n" for j in range(n)) for i, n in enumerate((3, 90, 40))}
    paths = [write(tmp_path / n, t) for n, t in fq.items()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        got = [(r.name, r.seq, r.qual) for r in seqreads.fastq_split(spark, paths).orderBy("file_name", "ordinal").collect()]
        assert got == [(r.name, r.seq, r.qual) for r in seqreads.scan(spark, paths, "fastq").orderBy("file", "ordinal").collect()]
        lines = [f"q{j // 3}\t{64 if j % 3 < 2 else 128}\tref\t{j + 1}\t60\t4M\t*\t0\t0\tACGT\t*" for j in range(120)]
        sam = [write(tmp_path / f"{n}.sam", "@HD\tVN:1\n" + "\n".join(part) + "\n") for n, part in (("a", lines[:30]), ("b", lines[30:]))]
        key = lambda df: [tuple(r) for r in df.orderBy("ordinal").select("qname", "flag", "pos", "seq", "qual").collect()]
        whole = seqreads.sam_split(spark, sam)
        assert key(whole) == key(seqreads.scan(spark, sam, "sam").withColumn("ordinal", F.col("file") * 1000 + F.col("ordinal")))
        reads = seqreads.aligned_reads(whole, paired=True).collect()
        assert len(reads) == 80 and all(r.is_paired for r in reads) and sorted({len(r.mappings) for r in reads}) == [1, 2]
        text = "".join(f">s{i}\t{i}\t0\n{'ACGT' * (i % 40 + 1)}\n" for i in range(1, 200))
        back = seqreads.sequences_file(spark, write(tmp_path / "Sequences", text)).collect()
        assert {r.read_id: len(r.seq) for r in back} == {i: 4 * (i % 40 + 1) for i in range(1, 200)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception):
        seqreads.fastq_split(spark, write(tmp_path / "bad.fq", "@a\nAC\n+\nI\n")).collect()


def test_long_raw_lines_are_refused(spark, tmp_path):
    assert rows(seqreads.scan(spark, write(tmp_path / "a.raw", "ACGT\n\n" + "A" * 4998 + "\n"), "raw")) == [("RAW", "ACGT"), ("RAW", "A" * 4998)]
    with pytest.raises(Exception):
        seqreads.scan(spark, write(tmp_path / "b.raw", "A" * 4999 + "\n"), "raw").count()


def test_mapped_reads_are_written_with_their_places(spark):
    reads = spark.createDataFrame([(1, "a", 0, "ACGT", [(7, 3), (None, 4), (-8, 0)]), (2, "b", 0, "C" * 60, []), (3, "c", 0, "G", None)], "read_id bigint, name string, category int, seq string, mappings array<struct<ref_id:bigint,pos:bigint>>")
    got = [r.line for r in sinks.sequences(reads).orderBy("read_id").collect()]
    assert got == [">a\t1\t0\nACGT\nM\t7\t3\nM\t-8\t0", ">b\t2\t0\n" + "C" * 60, ">c\t3\t0\nG"]


def test_regions_and_range_join(spark):
    heads = spark.createDataFrame([(1, "chr1:100-200"), (2, "chr1:400-300"), (3, "chr2")], "ref_id bigint, header string")
    areas = seqreads.regions(heads)
    assert sorted((r.ref_id, r.start, r.finish, r.positive) for r in areas.collect()) == [(1, 100, 200, True), (2, 300, 400, False), (3, 1, -1, True)]
    spots = spark.createDataFrame([("chr1", 150), ("chr1", 250), ("chr1", 300), ("chr2", 7)], "name string, at bigint")
    assert sorted((r.name, r.at, r.ref_id) for r in seqreads.in_regions(spots, areas, 64).collect()) == [("chr1", 150, 1), ("chr1", 300, 2), ("chr2", 7, 3)]
    with pytest.raises(Exception):
        seqreads.regions(spark.createDataFrame([(1, "a:1-10"), (2, "a:10-20")], "ref_id bigint, header string")).collect()


def test_contig_masks(spark):
    nodes = spark.createDataFrame([(1, 30, 60, "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTAC"), (2, 3, 6, "ACGT")], "node_id bigint, length bigint, cov bigint, seq string")
    gaps = spark.createDataFrame([(1, 25, 28)], "node_id bigint, start bigint, stop bigint")
    low = spark.createDataFrame([(1, 10, 24)], "node_id bigint, start bigint, stop bigint")
    row = sinks.contigs(nodes, 10, 21, gaps, low).first()
    s = nodes.first().seq
    assert row.seq == s[:21] + s[21:24].lower() + s[24] + "NNN" + s[28:]
    assert row.name == "NODE_1_length_30_cov_2.000000"


def test_sequence_lines(spark):
    reads = spark.createDataFrame([(1, "a", 0, "A" * 60), (2, None, 1, "C" * 61), (3, "c", 0, None)], "read_id bigint, name string, category int, seq string")
    got = [r.line for r in sinks.sequences(reads).orderBy("read_id").collect()]
    assert got == [">a\t1\t0\n" + "A" * 60 + "\n", ">\t2\t1\n" + "C" * 60 + "\nC"]
