"""Suffix-array deduplication against a set of windows."""

import random

import brute
import numpy as np
import pytest
from test_contracts import SF, frame, hostile

from hushline.llm import queries, suffix_dedup


def test_op3(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = [tuple(r) for r in queries.op3_suffix_dedup(spark, SF).orderBy("doc_id").collect()]
    assert got == brute.suffix_dedup(docs) and sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("large", [20_000, 3])
@pytest.mark.parametrize("spread", [64, 2])
def test_hostile(spark, monkeypatch, large, spread):
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    docs = hostile(9) + [(100 + i, "x" * k + "y" * (300 - k)) for i, k in enumerate(range(0, 300, 37))]
    docs += [(200 + i, f"{i} " * (i + 1) + "a passage that is shared by a great many documents, each with another text to its left and right " * 2 + str(i * 7919)) for i in range(80)]
    got = suffix_dedup.deduplicate(frame(spark, docs), large=large).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in got] == brute.suffix_dedup(docs)
    for r, (_, text) in zip(got, docs):
        data = (text or "").encode()
        edges = [0, *[e for s in r["spans"] for e in (s["start"], s["end"])], len(data)]
        assert bytes(r["kept"]) == b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def test_repeated_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = [(5, text), (5, text), (None, text), (5, "other " + text), (4, None)]
    got = suffix_dedup.deduplicate(frame(spark, docs)).collect()
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(brute.suffix_dedup(ordered), key=repr)
    assert suffix_dedup.deduplicate(frame(spark, docs).limit(0)).count() == 0


def test_interval_expansion_is_the_truncated_common_prefix():
    rnd = random.Random(2)
    for _ in range(30):
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(6, 40))) for _ in range(rnd.randint(1, 12))]
        length = rnd.randint(1, 6)
        doc = np.arange(len(pieces))
        at = np.zeros(len(pieces), np.int64)
        got = set(zip(*(v.tolist() for v in suffix_dedup.repeats_in(pieces, doc, at, length))))
        seen, want = set(), set()
        for d, p in enumerate(pieces):
            for i in range(len(p) - length + 1):
                if p[i : i + length] in seen:
                    want.add((d, i))
                seen.add(p[i : i + length])
        assert got == want
