"""The labelled sample of the toxicity chain is bounded by rows, also where rows repeat a doc_id."""

from test_contracts import frame

from hushline.llm import toxicity


def test_repeated_ids_count_once(spark):
    docs = frame(spark, [(1, f"word{i}") for i in range(50)] + [(2, "other"), (3, "third")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    texts, targets, folds = toxicity.sample(docs, labels, {"toxic": "toxic = 1"}, toxicity.Training(max_rows=3))
    assert len(texts) == len(targets) == len(folds) == 3 and targets[:, 0].tolist() == [1, 0, 0]
