import corpus_pipeline
from llm_rows import docs  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = frame.columns, [frame.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, FOLDER).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(frame.count())
        if name != "tokens":
            assert frame.columns == columns
    assert counts[0] >= counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, frame.collect()))


def test_stages_on_odd_documents(spark, docs):
    for rows in ([], [(1, None), (None, ""), (3, "some words here"), (3, "some words here"), (4, "x" * 40_000)]):
        frame = docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, FOLDER).count() <= 3 * len(rows)
