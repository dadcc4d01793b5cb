import numpy as np
from pyspark.sql import functions as F

from motifloom.llm import mixing


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = {"clean": [f"good{i}" for i in range(80)], "low": [f"spam{i}!!" for i in range(80)], "toxic": [f"nasty{i}" for i in range(10)]}
    rows = []
    for i in range(n):
        kind = str(rng.choice(["clean", "low", "toxic"], p=[0.7, 0.2, 0.1]))
        words = list(rng.choice(vocabulary["low" if kind == "low" else "clean"], int(rng.integers(20, 200))))
        if kind == "toxic":
            words = [str(rng.choice(vocabulary["toxic"])) if rng.random() < 0.1 else w for w in words]
        rows.append((i, " ".join(words), kind))
    return rows


def tables(spark, n=600):
    rows = texts(n, 1)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows] + [(None, None, 1, 2), (10_000, "", 1, 2)], "doc_id long, text string, n_ int, copy int")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 3], "doc_id long, domain string")
    return rows, docs, labels


def test_targets_are_met_and_domains_found(spark):
    rows, docs, labels = tables(spark)
    target = {"clean": 0.6, "low": 0.3, "toxic": 0.02}
    out, domains = mixing.mixed(docs, labels, target)
    got = out.toPandas()
    q = np.stack(got["q"])
    kind = {i: k for i, _, k in rows}
    known = got[got.doc_id.isin(kind)]
    right = [domains[int(np.argmax(x))] == kind[int(i)] for i, x in zip(known.doc_id, known.q)]
    assert np.mean(right) > 0.97
    total = got.tokens.sum()
    share = (got.tokens.to_numpy()[:, None] * q * got.rate.to_numpy()[:, None]).sum(axis=0) / total
    assert np.allclose(share, [target[d] for d in domains], atol=0.01)
    assert (got.rate >= 0).all() and len(got) == docs.count()
    assert np.allclose(q.sum(axis=1), 1)


def test_rates_solve_the_least_squares_problem():
    """Against plain projected gradient descent, run long."""
    rng = np.random.default_rng(2)
    q = rng.dirichlet([0.3] * 3, 200)
    t = rng.integers(1, 100, 200).astype(float)
    w, target, s = t / t.sum(), np.array([0.1, 0.9, 0.4]), mixing.Settings(ridge=0.01)
    history = np.zeros((0, 3))
    for _ in range(400):
        ahead = mixing.rates_of(q, history, s)[1]
        history = np.vstack([history, (w * ahead) @ q - target])
    r = np.ones(200)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (q @ ((w * r) @ q - target) + s.ridge * (r - 1)))
    got = mixing.rates_of(q, history, s)[0]
    value = lambda r: 0.5 * np.sum(((w * r) @ q - target) ** 2) + s.ridge / 2 * np.sum(w * (r - 1) ** 2)
    assert value(got) < value(r) + 1e-6


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(20_000).select(mixing.copies(F.lit(1.37), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1.37) < 0.02 and (got[1], got[2]) == (1, 2)
    kept = spark.range(2000).select(mixing.copies(F.lit(0.7), F.col("id"), whole_from=0.5).alias("n")).agg(F.min("n")).first()[0]
    assert kept == 1


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows, docs, labels = tables(spark)
    out = mixing.mix(docs, labels, {"clean": 1.2, "low": 0.0, "toxic": 0.0})
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    kind = {i: k for i, _, k in rows}
    clean = [i for i, k in kind.items() if k == "clean"]
    assert all(n.get(i, 0) >= 1 for i in clean) and any(n[i] > 1 for i in clean)
    assert np.mean([i in n for i, k in kind.items() if k != "clean"]) < 0.05


def test_no_labels_and_empty_tables(spark):
    _, docs, labels = tables(spark, 30)
    out, domains = mixing.mixed(docs, labels.where("false"))
    assert domains == ("clean", "low", "toxic") and out.count() == docs.count()
    assert mixing.mixed(docs.where("false"), labels)[0].count() == 0
    assert mixing.mix(docs.where("false"), labels).count() == 0
    nothing = docs.where("text is null or text = ''")
    assert mixing.mix(nothing, labels).count() == nothing.count()


def test_repeated_ids_and_the_bytes_of_the_sample(spark):
    _, docs, labels = tables(spark, 200)
    twice, both = docs.unionByName(docs), labels.unionByName(labels)
    pairs = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "domain")
    one, two = (mixing.learn(x) for x in (pairs, pairs.unionByName(pairs)))
    assert one.domains == two.domains and np.allclose(one.weights, two.weights) and np.allclose(one.bias, two.bias)
    first = mixing.learn(pairs, mixing.Settings(sample_bytes=1))
    assert len(first.domains) == 1  # a single document
    out, domains = mixing.mixed(twice, both)
    assert domains == ("clean", "low", "toxic") and out.count() == twice.count()
    assert out.groupBy("doc_id").agg(F.countDistinct("rate").alias("n")).where("n > 1").isEmpty()


def test_names_with_a_dot_and_long_texts(spark):
    _, docs, labels = tables(spark, 60)
    long = spark.createDataFrame([(20_000, "good1 good2 " * 100_000, 1, 2)], docs.schema)
    odd = docs.unionByName(long).withColumnsRenamed({"doc_id": "doc.id", "text": "the.text"})
    out, _ = mixing.mixed(odd, labels, doc_id="doc.id", text="the.text")
    assert out.where("`doc.id` = 20000").first()["tokens"] == 200_000
    assert mixing.mix(odd, labels, doc_id="doc.id", text="the.text").columns == odd.columns


def test_domains_of_labels(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0), (0, 1), (1, 1), (None, 0), (1, None)], "quality int, toxic int")
    assert [r[0] for r in rows.select(mixing.domain()).collect()] == ["clean", "low", "toxic", "toxic", None, None]
