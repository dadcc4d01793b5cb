import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from motifloom.llm import quality
from motifloom.llm import words as W

GOOD = " ".join(f"word{i} and some other{i} prose that differs{i * i}" for i in range(12))


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j + k for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é#|<\n\t 日", max_size=40), min_size=1, max_size=5))
def test_counts_equal_brute_force(texts):
    got = [row for b in W.blocks(pa.array(texts), block_bytes=30) for row in zip(*(x.tolist() for x in quality._block_counts(b)))]
    assert [list(r) for r in got] == [brute(t) for t in texts]


def table(spark):
    rows = [(i, GOOD + f" tail{i} " + "x" * (i % 5), "en", "s1") for i in range(150)]
    rows += [(200 + i, GOOD.replace(" ", " ### ") + str(i), "en", "s1") for i in range(40)]
    rows += [(300, "too short", "en", "s1"), (301, "one two three " * 40, "en", "s1"), (302, None, "en", "s1"), (303, "", None, None), (304, GOOD, None, None), (305, GOOD, "en", "rare")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_verdicts(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in quality.op3_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == docs.count()
    assert all(got[i]["kept"] for i in range(150))
    assert all(not got[i]["kept"] and "symbols" in got[i]["failed_rules"] for i in range(200, 240))
    assert [got[i]["base_failed"] for i in range(300, 306)] == [True, True, True, True, False, False]
    assert got[304]["kept"] and got[305]["kept"]


def test_thresholds_follow_the_groups(spark):
    rows = [(i, GOOD.replace(" and ", " & ") + str(i), "en", "marked") for i in range(150)] + [(1000 + i, GOOD + str(i), "en", "plain") for i in range(150)]
    rows += [(5000, GOOD.replace(" and ", " & "), "en", "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert set(range(150)) <= kept and 5000 not in kept


def test_filter_keeps_columns_and_stands_empty_tables(spark):
    docs = table(spark).selectExpr("*", "1 as quality_counts", "2 as g_0", "3 as n_words", "4 as limits")
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == 152
    assert quality.filter_quality(docs.where("false")).count() == 0


def _limits(values, low=False, width=6.0, tail=3.0, floor=0.02):
    """The two steps on sorted values themselves."""
    at = lambda xs, q: xs[max(math.ceil(q * len(xs)) - 1, 0)]
    far = lambda a, b, times: times * (abs(a - b) or floor)
    x = sorted(values)
    mid, q3, q7 = (at(x, q) for q in (0.5, 0.3, 0.7))
    bulk = [v for v in x if q3 - far(q3, mid, width) <= v <= q7 + far(q7, mid, width)]
    q1, q99 = at(bulk, 0.01), at(bulk, 0.99)
    return q1 - far(q1, mid, tail), q99 + far(q99, mid, tail)


def test_limits_equal_those_of_the_values_within_accuracy(spark):
    rest = " ".join(f"k{j}" for j in range(60))
    rows = [(i, "a" * (i % 90 + 3) + f" {rest} {i}", "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality.with_counts(docs, "text", "c").select("lang", "source", "c.*")
    good = [r for r in counted.where(~quality.base_failed()).collect()]
    limits = quality.thresholds(counted, ("lang", "source")).first()
    assert len(good) == 400
    low, high = _limits([r["word_chars"] / r["n_words"] for r in good], floor=0.4)
    assert abs(limits["high_word_length"] - high) < 0.3 and abs(limits["low_word_length"] - low) < 0.3


def test_sketches_decide_where_the_median_is_zero_and_three_tenths_are_noise(spark):
    """Two sources, in both half the texts have no symbols; a fifth has few in one and many in the other; the rest is noise."""
    words = [f"word{j}" for j in range(100)]
    rows, values = [], {}
    for source, most in (("plain", 4), ("tables", 30)):
        for i in range(300):
            n = 0 if i < 155 else 1 + i % most if i < 212 else 300 + i % 50
            rows.append((len(rows), " ".join(words) + f" x{i} " + "#" * n, "en", source))
            values.setdefault(source, []).append(n / (102 if n else 101))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality.with_counts(docs, "text", "c").select("lang", "source", "c.*")
    got = {r["g_1"]: r["high_symbols"] for r in quality.thresholds(counted, ("lang", "source")).collect()}
    for source, high in got.items():
        assert abs(high - _limits(values[source])[1]) < 0.03 * high
    assert got["tables"] > 4 * got["plain"] > 0.2
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == {i for i, (_, _, _, source) in enumerate(rows) if values[source][i % 300] < 1}


def test_repeated_rows_dots_in_names_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, GOOD, "en", "s")] * 3 + [(2, long, "en", "s"), (None, "x", None, None)], "doc_id long, `text.of` string, `lang.of` string, `source.of` string")
    kept = quality.filter_quality(docs, text="text.of", by=("lang.of", "source.of"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 1, 2]
