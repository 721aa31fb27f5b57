"""Rows with null or repeated doc_ids: each is kept or dropped for its own text."""

import random

import corpus_pipeline
from test_contracts import SF, frame

from hushline.llm import decontamination, simhash

RND = random.Random(9)


def prose(n=80):
    return " ".join(f"w{RND.randint(0, 10**6)}" for _ in range(n))


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_clean_rows_stay(spark):
    own = [prose() for _ in range(6)]
    docs = frame(spark, [(None, own[0]), (None, own[1]), (5, own[2]), (5, own[3]), (9, own[4]), (5, own[4]), (None, own[5]), (None, own[5])])
    once = sorted(own)
    assert texts(corpus_pipeline.near_duplicates(spark, docs, SF)) == once
    assert texts(simhash.drop_near_duplicates(docs)) == once
    left = corpus_pipeline.near_duplicates(spark, docs, SF).where("doc_id = 9").count()
    assert left == 0  # of the two copies, that of the smaller doc_id stays


def test_quality_judges_rows(spark):
    good, other = prose(), prose()
    docs = frame(spark, [(None, "too short"), (None, good), (4, "too short"), (4, other)])
    assert texts(corpus_pipeline.quality(spark, docs, SF)) == sorted([good, other])


def test_decontamination_judges_rows(spark):
    passage, clean, other = prose(), prose(), prose()
    docs = frame(spark, [(None, passage), (None, clean), (4, passage), (4, other)])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert texts(decontamination.remove_contaminated(docs, bench)) == sorted([clean, other])
