import gzip
import math

import pytest
from pyspark.sql import functions as F

from motifloom.functions import dna
from motifloom.functions.text import parse_slice_name
from motifloom.operators import sites as S
from motifloom.operators import stats
from motifloom.sinks import gff, warehouse
from motifloom.sources import gff as G
from motifloom.sources import motifs as PM
from motifloom.sources import sequences as SQ
from motifloom.streaming.scan import scanned_stream, write_stream


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nNNac\n\n>s2\nTT GG\n>s3 none\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">s1 again\nCC\n")
    got = {r["seq_id"]: (r["description"], r["seq"]) for r in SQ.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": ("first one", "ACGTNNac"), "s2": ("", "TTGG"), "s3": ("none", "")}
    both = {r["seq_id"]: r["seq"] for r in SQ.read_fasta(spark, str(tmp_path / "*.fa*")).collect()}
    assert both == {"s1": "CC", "s2": "TTGG", "s3": ""}
    assert {r["seq_id"]: r["length"] for r in SQ.describe(SQ.read_fasta(spark, str(tmp_path / "a.fa"))).collect()}["s1"] == 8


EMBL = "ID   X; SV 1\nXX\nAC   ACC1; ACC2;\nXX\nDE   a text\nXX\nSQ   Sequence 12 BP;\n     acgtac gtacgt        12\n     aa                   14\n//\n"


def test_embl_and_sniffing(spark, tmp_path):
    (tmp_path / "x.embl").write_text(EMBL + EMBL.replace("ACC1", "ACC9").replace("aa  ", "tt  "))
    (tmp_path / "y.fa").write_text(">f\nAC\n")
    got = {r["seq_id"]: r["seq"] for r in SQ.read_embl(spark, str(tmp_path / "x.embl")).collect()}
    assert got == {"ACC1": "ACGTACGTACGTAA", "ACC9": "ACGTACGTACGTTT"}
    assert {r["seq_id"] for r in SQ.read_sequences(spark, str(tmp_path / "*")).collect()} == {"ACC1", "ACC9", "f"}
    (tmp_path / "z.txt").write_text("hello\n")
    with pytest.raises(ValueError):
        SQ.read_sequences(spark, str(tmp_path / "*"))


def test_motif_files(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "m1.pfm").write_text("1 2 3\n\n4 5 6\n7 8 9\n0 1 0\n")
    (tmp_path / "m2.pfm").write_text("1\t2\n 3 4\n5 6\n7.5 8\n")
    rows = PM.read_motifs(spark, [str(tmp_path / "set" / "m1.pfm"), str(tmp_path / "m2.pfm")]).collect()
    assert {r["motif"] for r in rows} == {"set/m1.pfm", "m2.pfm"}
    assert {(r["base"], r["pos"]): r["count"] for r in rows if r["motif"] == "m2.pfm"}[("T", 0)] == 7.5
    (tmp_path / "bad.pfm").write_text("1 2\n3 4\n")
    with pytest.raises(Exception, match="not four rows"):
        PM.read_motifs(spark, str(tmp_path / "bad.pfm")).collect()


def test_sites_write_and_read(spark, tmp_path):
    rows = [("s", "m", 3, 8, 9.5, "+", 9.5, []), ("s", "m", 13, 18, 1.25, "-", 1.0, [("R", "A", 2, 0.5), ("Y", "N", 4, -1.25)])]
    sites = spark.createDataFrame(rows, "seq string, motif string, begin int, end int, score double, strand string, alt_score double, snps array<struct<ambig: string, allele: string, offset: int, score_diff: double>>")
    lines = sorted(r["value"] for r in gff.site_lines(sites, "scanner").collect())
    assert lines[1] == "s\tscanner\tm\t3\t8\t9.500000\t+\t.\t"
    assert lines[0].endswith("RA2 0.5\tYN4 -1.25")
    path = str(tmp_path / "out.gff.gz")
    gff.write_lines(gff.site_lines(sites), path)
    back = G.read_sites(spark, path).orderBy("begin").collect()
    assert [(r["begin"], r["end"], r["score"], r["strand"], r["annotation"]) for r in back] == [(3, 8, 9.5, "+", ""), (13, 18, 1.25, "-", "RA2 0.5 YN4 -1.25")]


def test_module_files(spark, tmp_path):
    tab = "### head\n#a\tx\na\tmalign\tCisModule\t1\t9\t30.50\t.\t.\tTarget \"b\";\tStart 3;\tCM 4\nb\tmalign\tCisModule\t3\t12\t30.50\t.\t.\tCM 4\na\tmalign\tm\t1\t5\t12.50\t+\t.\tCM 4\tMW 3.25\tCOL 0\t\nb\tmalign\tm\t3\t7\t12.50\t+\t.\tCM 4\tMW 3\tCOL 0\t\n"
    (tmp_path / "x.gff").write_text(tab)
    modules, sites = G.read_modules(spark, str(tmp_path / "x.gff"))
    assert [(r["module"], r["seq"], r["score"]) for r in modules.orderBy("seq").collect()] == [(4, "a", 30.5), (4, "b", 30.5)]
    assert [(r["module"], r["col"], r["motif"], r["delta"], r["weight"]) for r in sites.orderBy("seq").collect()] == [(4, 0, "m", 12.5, 3.25), (4, 0, "m", 12.5, 3.0)]
    old = "a|malign|CisModule|1|9|30|.|.|\nb|malign|CisModule|1|9|30|.|.|\na|malign|m|1|5|12|+|.|\na|malign|CisModule|11|19|20|.|.|\na|malign|n|11|15|12|-|.|\n"
    (tmp_path / "r_l.align.gff").write_text(old)
    got = G.read_pairwise(spark, str(tmp_path)).orderBy("begin").collect()
    assert [(r["right"], r["left"], r["module"], r["motif"], r["strand"]) for r in got] == [("r", "l", 1, "m", "+"), ("r", "l", 2, "n", "-")]


def test_bulk_read(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\t1\ny\t2\n")
    rows = G.read_bulk(spark, str(tmp_path / "*.tsv"), "name string, n int").collect()
    assert sorted((r["name"], r["n"]) for r in rows) == [("x", 1), ("y", 2)] and rows[0]["file"].endswith("a.tsv")


def test_edit_distances(spark):
    assert dna.edit_distance("kitten", "sitting") == 3
    assert dna.edit_distance("bc", "abcd", count_ends=False) == 0
    assert dna.align_strings("ACGT", "AGT") == (1, "ACGT", "A-GT")
    d, a, b = dna.align_strings("GATTACA", "GCATGCU")
    assert d == 4 and a.replace("-", "") == "GATTACA" and b.replace("-", "") == "GCATGCU" and len(a) == len(b)
    assert dna.align_strings("", "AC") == (2, "--", "AC")
    assert dna.align_strings("R", "A", ambiguous=True)[0] == 0 and dna.codes_match("A", "G") and not dna.codes_match("A", "Y")
    rows = spark.createDataFrame([("bc", "abcd"), (None, "a")], "a string, b string")
    got = rows.select(dna.free_end_distance("a", "b").alias("d"), dna.aligned("a", "b").alias("x")).collect()
    assert got[0]["d"] == 0 and got[1]["d"] is None and got[0]["x"]["distance"] == 2


def test_site_operators(spark):
    rows = [("a", "m", b, b + 4, float(b), "+") for b in (5, 1, 9, 9)] + [("b", "n", 2, 6, 7.0, "-")]
    sites = spark.createDataFrame(rows, "seq string, motif string, begin int, end int, score double, strand string")
    assert S.head(sites, 2).where("seq = 'a'").count() == 2
    assert S.head(sites, 3).where("seq = 'a'").count() == 4  # a tie
    assert S.without_sequences(sites, "a").count() == 1 and S.without_sequences(sites, "x").count() == 5
    mixed = S.randomised(sites, 3)
    assert sorted(r["begin"] for r in mixed.where("seq = 'a'").collect()) == [1, 5, 9, 9] and mixed.count() == 5
    assert all(r["end"] - r["begin"] == 4 for r in mixed.collect())
    old = spark.createDataFrame([(1, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, S.inserted(old, new, ["k"]).collect())) == [(1, "x"), (2, "z")]
    flipped = S.on_forward_strand(sites, F.col("seq") == "b", F.lit(100), F.lit(-50)).where("seq = 'b'").first()
    assert (flipped["begin"], flipped["end"], flipped["strand"]) == (45, 49, "+")
    seqs = S.random_sequences(spark, 2, 40, 1).collect()
    assert len(seqs) == 2 and all(sorted(r["seq"]) == sorted("ACGT" * 10) for r in seqs) and seqs[0]["seq"] != seqs[1]["seq"]


def test_slice_names(spark):
    rows = spark.createDataFrame([("HUMAN|12.100-250|ENSG01|Crick",), ("odd",), (None,)], "n string")
    got = rows.select(*(c.alias(k) for k, c in parse_slice_name(F.col("n")).items())).collect()
    assert got[0].asDict() == {"species": "HUMAN", "region": "12", "start": 100, "stop": 250, "gene": "ENSG01", "crick": True}
    assert got[1]["start"] is None and got[2]["species"] is None


def test_expectation_model_needs_enough_modules(spark):
    few = spark.range(30).selectExpr("id as module", "cast(id as double) as score")
    assert stats.expectation_model(few).count() == 0
    many = spark.range(60).selectExpr("id as module", "cast(100 - id as double) as score")
    fit = stats.expectation_model(many).first()
    xs, ys = [100.0 - r for r in range(10, 50)], [math.log(r + 1) for r in range(10, 50)]
    mx, my = sum(xs) / 40, sum(ys) / 40
    beta = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    assert math.isclose(fit["beta"], beta) and math.isclose(fit["alpha"], my - beta * mx)


def test_modules_of_one_score_have_no_expectation(spark, tmp_path):
    from motifloom.plans import site_queries as Q

    orders = [(i, "1-URGENT", 500.0 if i < 50 else 100.0 + i) for i in range(80)] + [(100 + i, "5-LOW", 500.0 - i) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["module"]: r["expected"] for r in Q.expected_modules(spark, str(tmp_path)).collect()}
    assert len(got) == 120 and all((got[m] is None) == (m < 80) for m in got)
    fit = {r["o_orderpriority"]: r for r in Q.expectation_model(spark, str(tmp_path)).collect()}
    flat = fit["1-URGENT"]
    assert len(fit) == 2 and flat["alpha"] is None and flat["r_squared"] is None and math.isnan(flat["rmse"]) and math.isnan(flat["beta_millionth"])


def test_part_of_sites_alike_goes_by_event(spark, tmp_path):
    import datetime as dt

    from motifloom.plans import site_queries as Q

    at = dt.datetime(2024, 1, 1)
    rows = [(1000 - 2 * i, at + dt.timedelta(seconds=i), user, "view", float(i), "{}") for user in range(5) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = Q.site_part(spark, str(tmp_path)).collect()
    assert sorted((r["seq"], r["score"]) for r in got) == [(str(user), float(i)) for user in range(5) for i in range(5, 10)]
    assert got[0].__fields__ == ["seq", "motif", "begin", "end", "score", "strand"]


def test_star_is_consistent(spark, tmp_path):
    head = ("f1", "HUMAN", "ENSG1", "g", "Watson", "db", "1", 100, 900, "CisModule", 1, 50, 20.0, ".", 1, None)
    site = ("f1", "HUMAN", "ENSG1", "g", "Watson", "db", "1", 100, 900, "tf", 1, 6, 9.0, "+", 1, 3.0)
    mouse = [("f1", "MOUSE", "ENSMUS1", "h", "Crick", "db", "2", 100, 900, *r[9:]) for r in (head, site)]
    staging = spark.createDataFrame([head, site, *mouse], warehouse.STAGING)
    star = warehouse.star(staging)
    sites = star["site"].orderBy("id").collect()
    assert [(r["pos"], r["strand"], r["column_id"]) for r in sites] == [(101, "+", 1), (894, "-", 1)]
    assert star["module_slice"].count() == 2 and star["region"].count() == 2 and star["factor"].first()["width"] == 5
    warehouse.write_star({k: star[k] for k in ("sequence", "factor")}, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w" / "sequence")).count() == 2


def test_streamed_scan(spark, tmp_path):
    from motifloom.operators import scan, threshold
    from motifloom.plans.scan_queries import weights

    w = weights()
    cut = threshold.cutoffs(w, "absolute", 4.0)
    rows = spark.createDataFrame([(str(i), "", "ACGTAGCTACGATCGACAAGTC" * (i + 1)) for i in range(3)], "seq_id string, description string, seq string")
    rows.write.parquet(str(tmp_path / "in"))
    query = write_stream(scanned_stream(spark, str(tmp_path / "in"), w, cut), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scan.scan(rows, w, cut)
    assert got.count() == want.count() > 0


def test_registered_queries_have_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "scan_absolute" in entry.queries()
