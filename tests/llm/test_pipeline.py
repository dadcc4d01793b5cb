import random

import public_tokenizers

import corpus_pipeline
from motifloom.llm import pieces


def documents(spark, path):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ta", "ro", "mi", "se", "lu") for b in ("ne", "ka", "vo", "di", "pa", "su", "gre")]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1] + " extra"), (102, None), (103, "too short"), (104, " ".join(w + " ###" for w in clean[2].split()))]
    rows += [(105, " ".join(rng.choice(vocabulary) for _ in range(120)) + " password=abcdefghijklmnop")]
    rows += [(200 + i, " ".join(rng.choice([*vocabulary, "idiot", "scum", "moron"]) for _ in range(120))) for i in range(20)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(20)] + [(104, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return dict(rows)


def test_stages_do_their_work(spark, tmp_path):
    texts = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(40)) | {105}
    assert clean <= seen["quality_rules"].keys() and not {102, 103, 104} & seen["quality_rules"].keys()
    assert clean <= seen["near_dedup"].keys() and not {100, 101} & seen["near_dedup"].keys()
    assert "[SECRET]" in seen["secret_scan"][105] and seen["secret_scan"].keys() == seen["near_dedup"].keys()
    assert clean <= seen["mixture"].keys()
    assert len([i for i in seen["mixture"] if i >= 200]) < 5
    last = out.collect()
    assert all(r["round_trip"] for r in last)
    decoded = pieces.decode(out, str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert all(r["text"] == seen["mixture"][r["doc_id"]] for r in decoded)
    assert texts[0] == seen["mixture"][0]


def test_run_and_empty_documents(spark, tmp_path):
    documents(spark, tmp_path)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "ids", "n_pieces", "round_trip"] and whole.count() > 40
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
