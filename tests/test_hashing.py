import random

from strandloom.functions import dna
from tests.test_graph import bases
from strandloom.operators import hashing, pregraph
from strandloom.runtime import materialize
from pyspark.sql import functions as F


def simulate(reads, k):
    """Roadmaps by walking through the reads in order."""
    comp = str.maketrans("ACGT", "TGCA")
    first, out = {}, []
    for rid, s in reads:
        novel, run, prev = 0, None, None
        runs = []
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            rc = w[::-1].translate(comp)
            key, fwd = (w, True) if w <= rc else (rc, False)
            if key not in first:
                first[key] = (rid, novel, fwd)
                novel += 1
                run = None
                continue
            owner, coord, ofwd = first[key]
            target = owner if fwd == ofwd else -owner
            step = 1 if target > 0 else -1
            if run and run[0] == target and coord == run[3] + step:
                run[3] = coord
            else:
                run = [target, novel, coord, coord]
                runs.append(run)
        out += [(rid, n + 1, t, p, a, b + (1 if t > 0 else -1)) for n, (t, p, a, b) in enumerate(runs)]
    return sorted(out)


def test_roadmaps_equal_a_walk(spark):
    r = random.Random(3)
    genome = "".join(r.choice("ACGT") for _ in range(120))
    turned = genome[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(1, genome[:60]), (2, genome[20:90]), (3, turned[:70]), (4, "ACG"), (5, genome[:30] + genome[:30]), (6, "A" * 30)]
    df = spark.createDataFrame([*reads, (7, None)], "read_id bigint, seq string")
    got = sorted((x.read_id, x.ord, x.target, x.position, x.start, x.finish) for x in hashing.roadmaps(hashing.kmer_rows(df, 11)).collect())
    assert got == simulate(reads, 11)


def test_long_texts_are_cut_in_blocks(spark):
    s = "".join(random.Random(1).choice("ACGT") for _ in range(5000))
    df = spark.createDataFrame([(1, s), (2, s[:2048]), (3, s[:10])], "i bigint, seq string")
    rows = df.select("i", F.explode(dna.kmer_positions(F.col("seq"), 21)).alias("x")).select("i", "x.*").collect()
    assert sorted((r.i, r.pos) for r in rows) == [(1, p) for p in range(4980)] + [(2, p) for p in range(2028)]
    assert all(r.word == s[r.pos : r.pos + 21] for r in rows)


def test_pack_round_trip(spark):
    words = ["A" * 31, "T" * 31, "ACGT" * 7 + "ACG"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("c", dna.pack(F.col("w")))
    assert [r.w for r in df.orderBy("c").collect()] == sorted(words)
    assert all(r.w == r.u for r in df.withColumn("u", dna.unpack(F.col("c"), 31)).collect())
    odd = spark.createDataFrame([(None,), ("",), ("acgt",), ("ACGT" * 8,), ("N" * 31,), ("A" * 31 + "\n",)], "w string")
    assert all(r.c is None for r in odd.select(dna.canonical_code(F.col("w")).alias("c")).collect())


def test_nearest_anchor_prefers_the_later_one(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 2, 5), (1, 4, None), (1, 6, 7), (1, 9, None), (2, 1, None)], "read_id bigint, pos bigint, anchor bigint")
    got = {(r.read_id, r.pos): r.near_anchor for r in hashing.nearest_anchor(df).collect()}
    assert got == {(1, 0): 5, (1, 2): 5, (1, 4): 7, (1, 6): 7, (1, 9): 7, (2, 1): None}


def test_n_masks(spark):
    df = spark.createDataFrame([(1, "NNACxGN"), (2, "ACGT"), (3, ""), (4, None)], "ref_id bigint, seq string")
    got = sorted((r.ref_id, r.start, r.finish) for r in hashing.n_masks(df).collect())
    assert got == [(1, 0, 1), (1, 4, 4), (1, 6, 6)]


def test_streaming_counts_equal_batch(spark, tmp_path):
    from strandloom.runtime import table
    from strandloom.streaming import running

    src = table(spark, "/root/testdata/sf0.001", "read_set")
    stream = spark.readStream.schema(src.schema).parquet("/root/testdata/sf0.001/read_set*.parquet")
    q = running.kmer_counts(stream, 21).writeStream.outputMode("complete").format("memory").queryName("kc").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    a = spark.sql("select sum(n), count(*) from kc").first()
    b = running.kmer_counts(src, 21).agg(F.sum("n"), F.count("*")).first()
    assert tuple(a) == tuple(b)


def test_packed_kmers_equal_the_texts(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ACGTNacgt") for _ in range(r.choice([0, 5, 20, 21, 22, 300]))), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, None, None), (None, "ACGT" * 20, None)], "read_id bigint, seq string, second_in_pair boolean")
    for k in (1, 5, 21, 31):
        for stranded in (False, True):
            a = hashing.kmer_rows(df.filter("read_id is not null"), k, stranded).withColumn("kmer", dna.pack(F.col("kmer")))
            b = hashing.kmer_rows(df, k, stranded, packed=True)
            key = lambda x: sorted((y.read_id, y.pos, y.kmer, y.fwd) for y in x.select("read_id", "pos", "kmer", "fwd").collect())
            assert key(a) == key(b)


def test_hot_kmers_are_spread(spark):
    rows = [(i, 0, "A" * 40 + bases(30, i)) for i in range(1, 30)]
    reads = spark.createDataFrame(rows, "read_id bigint, category int, seq string")
    kmers = hashing.kmer_rows(reads, 15, packed=True)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(hashing.hits(kmers, hot=20)) == key(hashing.hits(kmers))


def test_joins_of_kmers_and_pre_nodes_are_never_broadcast(spark):
    """Their sizes are taken for far too small, so a broadcast would bring a large table to the driver; first occurrences are counted once."""
    r = random.Random(8)
    genome = "".join(r.choice("ACGT") for _ in range(300))
    df = spark.createDataFrame([(i + 1, genome[i * 20 : i * 20 + 80]) for i in range(12)], "read_id bigint, seq string")
    kmers = hashing.kmer_rows(df, 11, packed=True)
    first, _ = materialize(hashing.first_occurrences(kmers, counted=True), "first")
    roads, _ = materialize(hashing.roadmaps(kmers, first), "roads")
    assert sorted(roads.collect()) == sorted(hashing.roadmaps(kmers).collect())
    novel = first.groupBy(F.col("owner").alias("seq_id")).agg(F.count(F.lit(1)).alias("own"))
    nodes, _ = materialize(pregraph.prenodes(novel, roads), "prenodes")
    walk = pregraph.walks(roads, nodes)
    assert walk.agg(F.sum("length")).first()[0] == 12 * 70
    for df in (hashing.hits(kmers, first=first), pregraph.translated(roads, nodes), walk):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
