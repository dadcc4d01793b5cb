import numpy as np

from motifloom.llm import codes


def brute(rows, k):
    known = [(i, np.array([(v[j] if j < len(v) else 0) > 0 for j in range(64)])) for i, v in rows if v is not None]
    out = {}
    for i, a in known:
        if i % 50 == 0:
            d = sorted((int((a != b).sum()), j) for j, b in known)
            out[i] = d[:k]
    return out


def run(spark, rows, k=10):
    table = spark.createDataFrame(rows, "id long, embedding array<float>")
    own = table.select("id", codes.sign_code("embedding").alias("code"))
    got = {}
    for r in codes.top_k(own, own.where("id % 50 = 0").withColumnRenamed("id", "query_id"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    return got


def test_equals_brute_force_with_ties_nulls_and_many_equal_codes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=64) * (0.2 + i % 3)]) for i in range(400)]
    rows += [(400 + i, [1.0] * 64) for i in range(120)] + [(600, None), (601, [1.0, -1.0]), (650, [])]
    assert run(spark, rows) == brute(rows, 10)


def test_fewer_rows_than_asked_for(spark):
    rows = [(i, [float((i >> j) & 1) for j in range(64)]) for i in (0, 1, 50, 51)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, [], 10) == {} and run(spark, [(1, [1.0] * 64)], 10) == {}


def test_far_codes_need_wide_radii(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(60)]
    assert run(spark, rows, 25) == brute(rows, 25)


def test_every_way_to_flip_bits_once(spark):
    for width, radius in ((5, 0), (5, 2), (5, 5), (8, 3)):
        got = [r["value"] for r in codes._flipped(spark.createDataFrame([(9,)], "value long"), width, radius).collect()]
        assert sorted(got) == sorted(9 ^ m for m in range(1 << width) if m.bit_count() == radius)


def test_probes_in_many_tasks_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(codes, "_PROBES_A_TASK", 100)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(120)]
    assert run(spark, rows, 5) == brute(rows, 5)
    table = spark.createDataFrame([(50, 1), (50, 3), (51, 3), (51, 3)], "id long, code long")
    got = codes.top_k(table, table.where("id = 50").withColumnRenamed("id", "query_id"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got) == [(50, 1, 50, 0), (50, 1, 50, 0), (50, 2, 50, 1), (50, 2, 51, 0)]
