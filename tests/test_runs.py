"""Whole runs on simulated reads: pairs, long reads, gaps, levels, options and the shell."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from strandloom.plans import commands
from strandloom.plans.assemble import assemble
from strandloom.plans.metagenome import assemble_levels
from strandloom.settings import AssemblySettings

from tests.test_graph import bases, turned

READS = "read_id bigint, category int, library int, mate_id bigint, seq string"


def pairs_of(genome, n, seed, size=60, insert=200, first=1, spread=8):
    """Mates at both ends of fragments, from either strand."""
    r, out = random.Random(seed), []
    for i in range(n):
        length = max(size, round(r.gauss(insert, spread)))
        at = r.randrange(0, len(genome) - length + 1)
        f = genome[at : at + length]
        if r.random() < 0.5:
            f = turned(f)
        a, b = first + 2 * i, first + 2 * i + 1
        out += [(a, 1, 0, b, f[:size]), (b, 1, 0, a, turned(f[-size:]))]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, READS).repartition(4)


def test_pairs_lead_over_a_repeat(spark):
    k, r = 21, bases(90, 50)
    a, b, c = bases(500, 51), bases(500, 52), bases(500, 53)
    genome = a + r + b + r + c
    run = assemble(frame(spark, pairs_of(genome, 900, 54)), AssemblySettings(k=k, exp_cov="auto", cov_cutoff=0, ins_length={0: 200}, ins_length_sd={0: 8}, unused_reads=True, amos_file=True))
    longest = max((x.seq for x in run.contigs.collect()), key=len)
    assert len(longest) > 1300
    # the unique parts stand in order; gaps, if any, are unknown bases
    text = longest if a[100:400] in longest else turned(longest)
    assert -1 < text.find(a[100:400]) < text.find(b[100:400]) < text.find(c[100:400])
    line = run.summary.first().line
    used = int(line.split("using ")[1].split("/")[0])
    assert used > 1500 and run.unused.count() == 1800 - used
    kinds = {x["part"]: x["count"] for x in run.amos.groupBy("part").count().collect()}
    assert kinds[0] == 1 and kinds[1] == 900 and kinds[2] == 1800 and kinds[3] == run.contigs.count()
    # coverage is that of the joined nodes, not an average
    assert run.nodes.agg(F.sum("cov")).first()[0] <= 1800 * 40


def test_long_reads_lead_over_a_repeat(spark):
    r = bases(120, 60)
    a, b, c = bases(400, 61), bases(400, 62), bases(400, 63)
    genome = a + r + b + r + c
    rows = [(i + 1, 0, 0, None, genome[at : at + 60]) for i, at in enumerate(range(0, len(genome) - 59, 4))]
    n = len(rows)
    rows += [(n + 1 + i, 4, 2, None, s) for i, s in enumerate([genome[250:750], turned(genome[240:760]), genome[760:1290], turned(genome[750:1300])])]
    run = assemble(frame(spark, rows), AssemblySettings(k=21, exp_cov=10, cov_cutoff=0))
    longest = max((x.seq for x in run.contigs.collect()), key=len)
    assert longest in (genome, turned(genome))


def test_filters_and_dubious_reads(spark):
    genome, rare = bases(400, 70), bases(200, 71)
    rows = [(i + 1, 0, 0, None, genome[at : at + 60]) for i, at in enumerate(range(0, 341, 4))]
    n = len(rows)
    rows += [(n + 1, 0, 0, None, rare)]
    run = assemble(frame(spark, rows), AssemblySettings(k=21, cov_cutoff=3, read_trkg=True, export_filtered=True))
    assert [x.read_id for x in run.dubious.collect()] == [n + 1] and run.filtered.count() == 1
    assert [len(x.seq) for x in run.contigs.collect()] == [400]
    # a reference spares what it marks
    rows += [(n + 2, 6, 3, None, rare)]
    kept = assemble(frame(spark, rows), AssemblySettings(k=21, cov_cutoff=3, read_trkg=True, alignments=True))
    assert sorted(len(x.seq) for x in kept.contigs.collect()) == [200, 400]
    assert [(x.node_start, x.node_stop, x.ref_start, x.ref_stop) for x in kept.alignments.collect()] in ([(1, 200, 1, 200)], [(180, 1, 1, 200)], [(200, 1, 1, 200)])
    low = assemble(frame(spark, rows[:-1]), AssemblySettings(k=21, long_cov_cutoff=1))
    assert low.nodes.count() == 0


def test_strand_specific_runs_keep_strands_apart(spark):
    s = bases(120, 72)
    rows = frame(spark, [(1, 0, 0, None, s), (2, 0, 0, None, turned(s))]).withColumn("second_in_pair", F.lit(False))
    assert assemble(rows, AssemblySettings(k=21)).nodes.count() == 1
    assert sorted(x.seq for x in assemble(rows, AssemblySettings(k=21, strand_specific=True)).nodes.collect()) == sorted([s, turned(s)])


def test_options_are_checked():
    for bad in ({"clean": True}, {"very_clean": True}, {"max_chimera_rate": 2.0}, {"min_peak_cov": 9.0, "max_peak_cov": 3.0}, {"cov_cutoff": "often"}):
        with pytest.raises(ValueError):
            AssemblySettings(**bad)


def test_two_levels_share_a_repeat(spark):
    """Two genomes of different depth that share a stretch: the stretch becomes one node for each."""
    shared = bases(60, 80)
    high = bases(300, 81) + shared + bases(300, 82)
    low = bases(300, 83) + shared + bases(300, 84)
    rows = []
    for genome, step in ((high, 1), (low, 4)):
        for at in range(0, len(genome) - 59, step):
            rows.append((len(rows) + 1, 0, 0, None, genome[at : at + 60]))
    reads = frame(spark, rows).drop("mate_id")
    run = assemble_levels(reads, AssemblySettings(k=21, exp_covs=(40.0, 10.0), repeat_cov_sd=0.4, report_split_detail=True, report_subgraph=True))
    assert run.levels == [40.0, 10.0] and run.splits.filter("split").count() == 1
    got = {x.seq for x in run.assembly.contigs.collect()}
    assert {min(x, turned(x)) for x in got} == {min(high, turned(high)), min(low, turned(low))}
    assert {x.place for x in run.parts.collect()} == {1, 2}


def test_runs_from_the_shell(spark, tmp_path):
    genome = bases(500, 90)
    for name, rows in (("1.fa", pairs_of(genome, 120, 91)[::2]), ("2.fa", pairs_of(genome, 120, 91)[1::2])):
        (tmp_path / name).write_text("".join(f">r{i}\n{r[4]}\n" for i, r in enumerate(rows)))
    out = str(tmp_path / "out")
    line = commands.main(["assemble", out, "21", "--separate", "--short-paired", str(tmp_path / "1.fa"), str(tmp_path / "2.fa"), "--exp_cov", "auto", "--ins_length", "0:200", "--unused_reads", "yes"], spark)
    assert line.startswith("Final graph has ") and line.endswith("/240 reads")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/contigs.fa/part-*")))
    assert text.startswith(">NODE_") and len(text) > 400
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{out}/*")} == {"contigs.fa", "stats.txt", "Graph", "Log", "UnusedReads.fa"}
    commands.main(["kmers", str(tmp_path / "k"), "17,21", "--short", str(tmp_path / "1.fa")], spark)
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/k_*")} == {"k_17", "k_19"}
    with pytest.raises(SystemExit):
        commands.parsed(["assemble", out, "21", "--colour", "yes"])
    with pytest.raises(ValueError):
        commands.parsed(["assemble", out, "21", "--read_trkg", "maybe"])
