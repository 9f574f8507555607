"""Sequence files as Spark data sources.

`spark.read.format("seqreads").option("layout", ...)` reads fasta, fastq, raw, sam and
bam files, plain, gzip or bzip2, one partition a file (compressed files don't split).
Paths may be local or on a shared store (hdfs, s3, gs), which pyarrow opens.
Large plain files are read in blocks, inside the JVM: FASTA by `fasta_split`, FASTQ
by `fastq_split`, SAM by `sam_split`.

Records keep their order: `file` (place in the list) and `ordinal` (from 0 in the file).
Names end at the first white space. Sequences may run over several lines. A FASTQ
record with a quality shorter than its sequence ends its file. An empty file gives no
records; a first byte that fits no layout is an error.
"""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ordered import lagged, running_total
from ..runtime import materialize

READS = "file int, ordinal bigint, name string, seq string, qual string"
SAM = (
    "file int, ordinal bigint, qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, "
    "pnext bigint, tlen bigint, seq string, qual string"
)
BATCH = 4096


def _stream(path: str):
    """A binary stream of a local file or of one on a shared store."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        return io.BufferedReader(where.open_input_file(name), 1 << 20)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


def opened(path: str):
    """The file, decompressed by its first bytes."""
    f = _stream(path)
    head = f.peek(3)[:3]
    if head[:2] == b"\x1f\x8b":
        return gzip.open(f, "rb")
    if head == b"BZh":
        return bz2.open(f, "rb")
    return f


def sniffed(path: str) -> str:
    """Layout by the first bytes: fasta, fastq, bam or an error."""
    with opened(path) as f:
        head = f.read(4)
    if head == b"BAM\x01":
        return "bam"
    kind = {b">": "fasta", b"@": "fastq"}.get(head[:1])
    if head and kind is None:
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    return kind or "fasta"


def fastx(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str | None]]:
    """Records of FASTA or FASTQ lines: name, sequence, quality (null for FASTA)."""
    line = next(lines, None)
    while line is not None and line[:1] not in b">@":
        line = next(lines, None)
    while line is not None:
        name = (line[1:].split(None, 1) or [b""])[0].decode("utf-8", "replace")
        seq: list[bytes] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (b">", b"@", b"+"):
            seq.append(b"".join(line.split()))
            line = next(lines, None)
        text = b"".join(seq)
        if line is None or line[:1] != b"+":
            yield name, text.decode("latin-1"), None
            continue
        qual = b""
        line = next(lines, None)
        while line is not None and len(qual) < len(text):
            qual += line.strip()
            line = next(lines, None)
        if len(qual) != len(text):
            return
        yield name, text.decode("latin-1"), qual.decode("latin-1")
        while line is not None and line[:1] not in b">@":
            line = next(lines, None)


def bam(f) -> Iterator[tuple]:
    """Alignments of a BAM file in the columns of SAM; positions from 1."""
    def ints(fmt: str):
        return struct.unpack("<" + fmt, f.read(struct.calcsize("<" + fmt)))

    if f.read(4) != b"BAM\x01":
        raise ValueError("no BAM file")
    f.read(ints("i")[0])
    refs = []
    for _ in range(ints("i")[0]):
        refs.append(f.read(ints("i")[0])[:-1].decode())
        f.read(4)
    while len(head := f.read(4)) == 4:
        data = f.read(struct.unpack("<i", head)[0])
        ref, pos, ln, mapq, _, nc, flag, ls, nref, npos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        name = data[at : at + ln - 1].decode()
        at += ln
        cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in struct.unpack_from(f"<{nc}I", data, at))
        at += 4 * nc
        packed = data[at : at + (ls + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:ls]
        at += (ls + 1) // 2
        q = data[at : at + ls]
        qual = "*" if not ls or q[0] == 255 else "".join(chr(33 + x) for x in q)
        where = lambda r: refs[r] if r >= 0 else "*"
        yield name, flag, where(ref), pos + 1, mapq, cigar or "*", where(nref), npos + 1, tlen, seq or "*", qual


def sam(lines: Iterator[bytes]) -> Iterator[tuple]:
    for line in lines:
        if line[:1] == b"@" or not line.strip():
            continue
        p = line.rstrip(b"\r\n").decode("latin-1").split("\t")
        if len(p) < 10:
            continue
        yield p[0], int(p[1]), p[2], int(p[3]), int(p[4]), p[5], p[6], int(p[7]), int(p[8]), p[9], p[10] if len(p) > 10 else "*"


#: A raw line of this many letters or more is refused.
LONGEST_RAW = 4999


def raw(lines: Iterator[bytes]) -> Iterator[tuple[str, str, None]]:
    """Reads of one line each, all named RAW."""
    for line in lines:
        text = line.strip()
        if len(text) >= LONGEST_RAW:
            raise ValueError(f"a raw read has {len(text)} letters; at most {LONGEST_RAW - 1} are taken")
        if text:
            yield "RAW", text.decode("latin-1"), None


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class SeqReadsReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.layout = options.get("layout", "auto")
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.schema = schema
        if not self.paths:
            raise ValueError("no file is given")
        for p in self.paths:
            opened(p).close()

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        layout = sniffed(part.path) if self.layout == "auto" else self.layout
        with opened(part.path) as f:
            if layout in ("fasta", "fastq"):
                want = {"fasta": b">", "fastq": b"@"}[layout]
                first = f.peek(1)[:1] if hasattr(f, "peek") else b""
                if first and first != want and self.layout != "auto":
                    raise ValueError(f"{part.path}: not a {layout} file")
                rows = fastx(iter(f))
            elif layout == "raw":
                rows = raw(f)
            elif layout == "sam":
                rows = sam(iter(f))
            elif layout == "bam":
                rows = bam(f)
            else:
                raise ValueError(f"unknown layout {layout}")
            held: list[tuple] = []
            ordinal = 0
            for r in rows:
                held.append((part.number, ordinal, *r))
                ordinal += 1
                if len(held) == BATCH:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)


class SeqReads(DataSource):
    """Format name `seqreads`; options path or paths (comma separated), layout."""

    @classmethod
    def name(cls):
        return "seqreads"

    def schema(self):
        return SAM if self.options.get("layout") in ("sam", "bam") else READS

    def reader(self, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        return SeqReadsReader(self.options, to_arrow_schema(schema))


def scan(spark: SparkSession, paths: list[str] | str, layout: str = "auto") -> DataFrame:
    # the planner's Python process need not find this package: the source travels whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(SeqReads)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    files = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("seqreads").option("paths", ",".join(files)).option("layout", layout).load()


def lines_in_order(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """file_name, block, o, value: lines of text files read in blocks. (file_name, block, o) orders them.

    `o` grows inside a block only: blocks of one file may go to any task."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("o", F.monotonically_increasing_id())


LINE_ORDER = ["file_name", "block", "o"]


def fasta_split(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain FASTA files read in blocks: file_name, block, within, name, seq.

    (block, within) orders the records of a file."""
    rows = lines_in_order(spark, path, "\n>").filter("length(trim(value)) > 0")
    record = F.regexp_replace("value", "^>", "")
    w = W.partitionBy("file_name", "block").orderBy("o")
    return rows.select(
        "file_name", "block", (F.row_number().over(w) - 1).alias("within"), F.regexp_extract(record, r"^(\S*)", 1).alias("name"),
        F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"),
    )


def fastq_split(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of FASTQ files of four lines a record, read in blocks: file_name, ordinal, name, seq, qual. Other lines are an error."""
    kept, _ = materialize(lines_in_order(spark, path), "lines")
    lines = running_total(kept, F.lit(1).cast("bigint"), LINE_ORDER, "n", ())
    first = lines.groupBy("file_name").agg(F.min("n").alias("first"))
    at = lines.join(F.broadcast(first), "file_name").withColumn("n", F.col("n") - F.col("first"))  # one row a file
    line = lambda i: F.max(F.when(F.col("n") % 4 == i, F.col("value")))
    four = at.groupBy("file_name", F.expr("n div 4").alias("ordinal")).agg(line(0).alias("head"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("qual"))
    bad = ~(F.coalesce(F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False)))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no FASTQ record: "), F.coalesce("head", F.lit(""))))).otherwise(F.col("seq"))
    return four.select("file_name", "ordinal", F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), checked.alias("seq"), "qual")


def sam_split(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text files read in blocks, in the columns of the data source; `file` numbers the files by name."""
    kept, _ = materialize(lines_in_order(spark, path).filter("value not like '@%' and length(trim(value)) > 0"), "lines")
    rows = running_total(kept, F.lit(1).cast("bigint"), LINE_ORDER, "n")
    names = kept.select("file_name").distinct()
    files = names.withColumn("file", (F.row_number().over(W.orderBy("file_name")) - 1).cast("int"))  # one row a file
    p = F.split("value", "\t")
    kinds = [x.split() for x in SAM.split(", ")][2:]
    columns = [F.coalesce(F.get(p, F.lit(i)), F.lit("*")).cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)]
    return rows.filter(F.size(p) >= 10).join(F.broadcast(files), "file_name").select("file", (F.col("n") - 1).alias("ordinal"), *columns)


def in_order(records: DataFrame) -> DataFrame:
    """Records of several files that follow each other, as of one: file 0 and ordinals from 0."""
    rows = running_total(records, F.lit(1).cast("bigint"), ["file", "ordinal"], "__n")
    return rows.withColumn("file", F.lit(0)).withColumn("ordinal", F.col("__n") - 1).drop("__n")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs from two files by position: left and right records in turn. Unequal counts are an error."""
    key = ["file", "ordinal"]
    both = left.select(*key, F.struct("name", "seq").alias("l")).join(right.select(*key, F.struct("name", "seq").alias("r")), key, "full_outer")
    checked = both.withColumn("ok", F.when(F.col("l").isNull() | F.col("r").isNull(), F.raise_error(F.lit("the two files hold different numbers of records"))).otherwise(F.lit(True)))
    return checked.filter("ok").select("file", "ordinal", F.posexplode(F.array("l", "r")).alias("side", "x")).select(
        "file", (F.col("ordinal") * 2 + F.col("side")).alias("ordinal"), "x.name", "x.seq"
    )


def read_ids(records: DataFrame, category: int, first: int = 1) -> DataFrame:
    """read_id (dense, in file and record order), name, category, library, is_paired, seq normalised."""
    from ..functions.dna import normalise

    rows = running_total(records.select("file", "ordinal", "name", "seq"), F.lit(1).cast("bigint"), ["file", "ordinal"], "n")
    return rows.select(
        (F.col("n") + (first - 1)).alias("read_id"), "name", F.lit(category).cast("tinyint").alias("category"), F.lit(category // 2).cast("tinyint").alias("library"),
        F.lit(category % 2 == 1).alias("is_paired"), normalise(F.col("seq")).alias("seq"),
    )


# --- alignments ------------------------------------------------------------------


def cigar_blocks(rows: DataFrame) -> DataFrame:
    """One row for each aligned block: adds block_pos (reference position from 1 of the read's base 0 on the block's diagonal).

    M, = and X give blocks; I and S move the read, D and N the reference, H and P nothing; others are errors."""
    parts = F.regexp_extract_all("cigar", F.lit(r"(\d+)([A-Za-z=])"), 0)
    step = F.transform(parts, lambda p: F.struct(F.expr("0").alias("z"), F.regexp_extract(p, r"^(\d+)", 1).cast("bigint").alias("n"), F.substring(p, -1, 1).alias("op")))
    start = F.struct(F.col("pos").cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def go(acc, x):
        at = F.when(x["op"].isin("S", "I"), acc["at"] - x["n"]).when(x["op"].isin("D", "N"), acc["at"] + x["n"]).otherwise(acc["at"])
        out = F.when(x["op"].isin("M", "=", "X"), F.array_append(acc["out"], acc["at"])).otherwise(acc["out"])
        bad = ~x["op"].isin("M", "=", "X", "S", "I", "D", "N", "H", "P")
        return F.struct(F.when(bad, F.raise_error(F.concat(F.lit("unknown CIGAR operation "), x["op"])).cast("bigint")).otherwise(at).alias("at"), out.alias("out"))

    return rows.filter("cigar is not null and cigar <> '*'").withColumn("block_pos", F.explode(F.aggregate(step, start, go)["out"]))


def aligned_reads(rows: DataFrame, paired: bool = False) -> DataFrame:
    """Reads of a SAM table: consecutive rows of one name and mate are one read with all its mappings.

    Rows without sequence are left out; reversed ones are turned. In a paired category, a read whose mate
    does not follow or precede it loses its pairing (is_paired false)."""
    from ..functions.dna import revcomp

    flag = F.col("flag")
    mate = F.when(flag.bitwiseAND(64) > 0, "/1").when(flag.bitwiseAND(128) > 0, "/2").otherwise("")
    use = rows.filter("seq is not null and seq <> '*'").withColumn("read_name", F.concat("qname", mate)).withColumn(
        "fwd_seq", F.when(flag.bitwiseAND(16) > 0, revcomp(F.upper("seq"))).otherwise(F.upper("seq"))
    )
    # no window is keyed by a file, of which there may be one: rows are compared with the row before over ranges of the order
    named = lagged(use, F.struct("file", "read_name"), ["file", "ordinal"], "before")
    head = F.when(F.col("before").eqNullSafe(F.struct("file", "read_name")), 0).otherwise(1).cast("bigint")
    runs = running_total(named, head, ["file", "ordinal"], "run")
    mapped = F.when(flag.bitwiseAND(4) == 0, F.struct("ordinal", "rname", "pos", "cigar", (flag.bitwiseAND(16) > 0).alias("reverse")))
    reads = runs.groupBy("file", "run").agg(
        F.first("qname").alias("qname"), F.first("read_name").alias("name"), F.min_by("fwd_seq", "ordinal").alias("seq"), F.array_sort(F.collect_list(mapped)).alias("mappings")
    )
    if not paired:
        return reads.withColumn("is_paired", F.lit(False))
    key = F.struct("file", "qname")
    beside = lagged(lagged(reads, key, ["run"], "a"), key, [F.desc("run")], "b")
    return beside.withColumn("is_paired", F.col("a").eqNullSafe(key) | F.col("b").eqNullSafe(key)).drop("a", "b")


def regions(headers: DataFrame) -> DataFrame:
    """ref_id, name, start, finish, positive for headers(ref_id, header): `name:start-finish` (from 1, inclusive; start
    after finish: negative strand) or a bare name (1, -1). Overlapping regions of one name are an error."""
    h = F.col("header")
    pattern = r"^(.*):(\d+)-(\d+)$"
    a, b = F.regexp_extract(h, pattern, 2).cast("bigint"), F.regexp_extract(h, pattern, 3).cast("bigint")
    has = h.rlike(pattern)
    rows = headers.select(
        "ref_id", F.when(has, F.regexp_extract(h, pattern, 1)).otherwise(h).alias("name"), F.when(has, F.least(a, b)).otherwise(1).cast("bigint").alias("start"),
        F.when(has, F.greatest(a, b)).otherwise(-1).cast("bigint").alias("finish"), (~has | (a <= b)).alias("positive"),
    )
    w = W.partitionBy("name").orderBy("start", "ref_id")
    end = F.when(F.col("finish") < 0, F.lit(2**62)).otherwise(F.col("finish"))
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("r", reach).withColumn("start", F.when(F.col("r") >= F.col("start"), F.raise_error(F.lit("reference regions overlap")).cast("bigint")).otherwise(F.col("start"))).drop("r")


def in_regions(spots: DataFrame, areas: DataFrame, block: int = 100_000) -> DataFrame:
    """Range join of spots(name, at, ...) with regions, by blocks of coordinates so that no key is shared by all."""
    cut = areas.withColumn("hi", F.when(F.col("finish") < 0, F.lit(None)).otherwise(F.col("finish")))
    bounded = cut.filter("hi is not null").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("hi") / block))))
    a = spots.withColumn("b", F.floor(F.col("at") / block)).join(bounded, ["name", "b"]).filter("at between start and hi").drop("b", "hi")
    b = spots.join(cut.filter("hi is null"), "name").drop("hi")
    return a.unionByName(b)


# --- text forms of the intermediate tables -----------------------------------------


def _sections(spark: SparkSession, path: str, head: str) -> DataFrame:
    """Lines of a text file with their place o and the number of the section (line starting with `head`) each belongs to: o, line, section.

    Files follow each other by name and their blocks by start, whatever tasks they went to."""
    kept, _ = materialize(lines_in_order(spark, path).withColumnRenamed("value", "line"), "lines")
    rows = running_total(kept, F.lit(1).cast("bigint"), LINE_ORDER, "n")
    return running_total(rows.select(F.col("n").alias("o"), "line"), F.col("line").startswith(head).cast("bigint"), ["o"], "section")


def sequences_file(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name, category, seq of a Sequences file (`>name<TAB>id<TAB>category`, lines of bases, M lines skipped)."""
    rows = _sections(spark, path, ">").filter("section > 0 and line not like 'M\\t%'")
    both = rows.groupBy("section").agg(
        F.max(F.when(F.col("line").startswith(">"), F.col("line"))).alias("head"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").startswith(">"), F.struct("o", "line")))), lambda x: x["line"])).alias("seq"),
    )
    p = F.split(F.expr("substring(head, 2)"), "\t")
    return both.select(p[1].cast("bigint").alias("read_id"), p[0].alias("name"), p[2].cast("tinyint").alias("category"), "seq")


def roadmaps_file(spark: SparkSession, path: str) -> DataFrame:
    """read_id, ord, target, position, start, finish of a Roadmaps file."""
    rows = _sections(spark, path, "ROADMAP ").filter("section > 0")
    w = W.partitionBy("section").orderBy("o")
    named = rows.withColumn("ord", F.row_number().over(w) - 1).withColumn("read_id", F.first(F.get(F.split("line", " "), F.lit(1)).cast("bigint")).over(w))
    p = F.split("line", "\t")
    column = lambda i: F.get(p, F.lit(i)).cast("bigint")
    return named.filter("ord > 0").select(
        "read_id", "ord", column(0).alias("target"), column(1).alias("position"), column(2).alias("start"), column(3).alias("finish")
    )


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(node_id, length, cov, tail, twin_tail) and arcs(src, dst, mult) of a graph file."""
    lines = _sections(spark, path, "NODE\t")
    w = W.partitionBy("section").orderBy("o")
    at = lines.filter("section > 0").withColumn("i", F.row_number().over(w))
    p = F.split("line", "\t")
    tops = at.filter("i <= 3").groupBy("section").agg(*(F.max(F.when(F.col("i") == i, F.col("line"))).alias(c) for i, c in ((1, "head"), (2, "tail"), (3, "twin_tail"))))
    h = F.split("head", "\t")
    cov = F.aggregate(F.filter(F.slice(h, 4, 1000), lambda x, i: i % 2 == 0), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    nodes = tops.select(h[1].cast("bigint").alias("node_id"), h[2].cast("bigint").alias("length"), cov.alias("cov"), "tail", "twin_tail")
    arcs = lines.filter("line like 'ARC\\t%'").select(*(F.get(p, F.lit(i)).cast("bigint").alias(c) for i, c in ((1, "src"), (2, "dst"), (3, "mult"))))
    return nodes, arcs


def pregraph_file(spark: SparkSession, path: str) -> DataFrame:
    """node_id, length, seq of a pre-graph file (`NODE<TAB>id<TAB>length`, bases on the next lines)."""
    rows = _sections(spark, path, "NODE\t").filter("section > 0")
    both = rows.groupBy("section").agg(
        F.max(F.when(F.col("line").startswith("NODE\t"), F.col("line"))).alias("head"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").startswith("NODE\t"), F.struct("o", "line")))), lambda x: x["line"])).alias("seq"),
    )
    h = F.split("head", "\t")
    return both.select(h[1].cast("bigint").alias("node_id"), h[2].cast("bigint").alias("length"), "seq")


def connected_graph(nodes: DataFrame, arcs: DataFrame, reads: DataFrame, k: int):
    """A graph built elsewhere: nodes and arcs as given, read starts computed anew: (nodes, arcs, read starts)."""
    from ..operators import graph
    from ..operators.stats import canonical_arcs

    return nodes, canonical_arcs(arcs), graph.read_starts(graph.thread(reads, nodes, k), nodes)
