"""The pipeline over the smallest tables, stage by stage."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {"start": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    assert rows["toxicity"] <= rows["start"] and rows["near duplicates"] < rows["toxicity"]
    assert rows["personal data"] == rows["near duplicates"] and rows["pieces"] == rows["source mix"]
    assert docs.where("NOT round_trip").count() == 0


def test_near_duplicates_by_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[30], near[70] = "x", "y"  # 86 of 106 five-word shingles are shared, 92 of 104 three-word ones
    far[20], far[50], far[80] = "x", "y", "z"  # 81 of 111, and 80 of 112 to the other
    short = "one two three four"
    texts = {1: " ".join(words), 2: " ".join(near), 3: " ".join(far), 4: short, 5: short, 6: short + " five"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece_ids", "n_pieces"} <= set(out.columns) and out.count() > 0
