"""Repeated three-line blocks of few characters."""

import corpus_pipeline
from test_contracts import SF, frame

from hushline.llm import line_dedup


def test_stage_removes_short_blocks(spark):
    menu, han, blank = "Home\nAbout\nContact", "漢字漢字漢字漢字漢\n仮名仮名仮名仮名仮\n文章文章文章文章文", "\n" * 5
    docs = [(1, f"{menu}\nfirst\n{han}\none{blank}uno"), (2, f"{menu}\nsecond\n{han}\ntwo{blank}due")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, frame(spark, docs), SF).collect()}
    assert got == {1: docs[0][1], 2: f"second\ntwo{blank}due"}  # wholly blank windows are not compared


def test_equal_rows_count_as_documents(spark):
    block = "a\nb\nc\nd"
    docs = frame(spark, [(None, block), (None, block), (None, block), (3, block)])
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in line_dedup.deduplicate(docs).collect())
    assert got == [(False, 0), (True, 4), (True, 4), (True, 4)]
