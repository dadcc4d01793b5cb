import pytest

from motifloom.commands import CommandError, Workspace

PFM = "10 0 2 0\n0 9 1 1\n1 0 8 0\n0 2 0 10\n"
PFM2 = "0 8 7 1 0\n9 0 1 0 2\n0 1 1 9 0\n1 1 1 0 8\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "m1.pfm").write_text(PFM)
    (tmp_path / "m2.pfm").write_text(PFM2)
    core = "TTACGTCCGGACGTAACAAGTTT"
    (tmp_path / "s.fa").write_text(f">one first\n{core}{'GC' * 20}{core}\n>two second\nGGG{core}{'GC' * 21}{core}\n>three\nCC{core}\n")
    return tmp_path


def run(spark, *words):
    lines = []
    ws = Workspace(spark, lines.append)
    ws.run([str(w) for w in words])
    return ws, lines


def test_scan_align_and_save(spark, files):
    out = files / "out"
    ws, lines = run(
        spark, "-as", files / "s.fa", "-am", files / "m*.pfm", "-pm", "-pmw", "-ps", "-getTFBSabsolute", 5, "-savematch", out / "hits", "-rs", "three",
        "-align", ".", 2, "-suboptimals", 1, "-savealignGFF", out / "mods", "-savealign", out / "text", "-savealignAnchor", out / "anchors", "-showalign", "-computeKLdistances", out / "kl", "-__computeEscores", out / "es",
    )
    assert any(line.startswith("one\tfirst") for line in lines) and any(line.startswith("total\t") for line in lines)
    read = lambda name: [r["value"] for r in spark.read.text(str(out / name)).collect()]
    assert any("CisModule" in x for x in read("mods")) and any(x.startswith("one\ttwo\t") for x in read("anchors"))
    assert any("Alignment No 1" in x for x in read("text")) and len(read("hits")) > 5
    assert spark.read.csv(str(out / "kl"), sep="\t", header=True).count() == 2
    again, more = run(spark, "-align", out / "hits", 1, ".", ".", ".", ".", ".", "one", "two", "-more", 1, "-showalign", "-suboptimalsDownTo", 1)
    assert again.columns.agg({"module": "max"}).first()[0] >= 2 and more


def test_many_sequences_trees_and_merging(spark, files):
    out = files / "out"
    ws, _ = run(spark, "-as", files / "s.fa", "-am", files / "m*.pfm", "-getTFBSpvalue", 0.01, "-savematch", out / "hits", "-multipleAlign", ".", 1)
    assert ws.columns.select("seq").distinct().count() == 3
    (files / "t.new").write_text("((one,two),three);\n")
    ws, lines = run(spark, "-treeMultipleAlign", out / "hits", files / "t.new", 1, 5, 1, "-nodeAlignments", 2, 1, "-shortMultipleAlign", out / "hits", 1, 1)
    assert lines and ws.columns.count() > 0
    run(spark, "-as", files / "s.fa", "-align", out / "hits", 2, ".", ".", ".", ".", ".", "one", "two", "-savealignGFF", out / "pair")
    ws, lines = run(spark, "-__multipleAlignGreedy", out / "pair", "-__showMultiAlign", "-multiFromPairwise", out / "hits", out / "pair", "-showpwbase")
    assert any("score" in x for x in lines) and any(x.startswith("!") or x.startswith("\t") for x in lines)


def test_backgrounds(spark, files):
    out = files / "out"
    ws, _ = run(spark, "-as", files / "s.fa", "-am", files / "m1.pfm", "-setBGfreq", "one", "-setpseudocount", 0, "-setMarkovBG", "one", 1, "-saveMarkovBackground", out / "bg", "-getTFBSabsolute", 3, "-__head", 2, "-__randomize_full")
    assert ws.pseudocount == 1.0 and len(ws.markov) == 16
    other, _ = run(spark, "-setMarkovBG", out / "bg")
    assert (other.markov == ws.markov).all()
    ws.execute("setBGfreq", ["1", "1", "1", "1"])
    assert ws.markov is None and ws.sites is None
    ws.execute("reset", [])
    assert ws.sequences is None and ws.motifs is None


@pytest.mark.parametrize("words", [["-nonsense"], ["-addMatrix"], ["-align"], ["-more"], ["-getTFBS"], ["-showalign"], ["stray"], ["-showpwbase"], ["-saveMarkovBackground", "x"]])
def test_errors(spark, words):
    with pytest.raises(CommandError):
        run(spark, *words)


def test_help(spark):
    _, lines = run(spark, "-help", "-h", "align", "-about")
    assert any(x.startswith("align\t") for x in lines)
