"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushline.llm import hard_negatives, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<float>, anchor string, row long"


def plain(rows, n_pos=5, n_neg=3, low=50, high=95):
    """rows: (vec_id, label, embedding); anchors are the ids divisible by 50."""
    usable = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, label, [math.floor(256 * x) for x in v]))
    usable.sort()
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (a_id, a_label, a) in enumerate(usable):
        if a_id % 50:
            continue
        order = sorted((-score(a, v), j) for j, (_, _, v) in enumerate(usable) if j != i)
        pos = [(-s, j) for s, j in order if usable[j][1] == a_label][:n_pos]
        for ps, p in pos:
            neg = [(-s, j) for s, j in order if usable[j][1] != a_label and low * ps <= -100 * s <= high * ps][:n_neg]
            out += [(a_id, usable[p][0], k + 1, usable[j][0], ps, s) for k, (s, j) in enumerate(neg)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    flipped = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in rows]
    got = queries.op12_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(flipped)
    assert rows_of(got) == want and len(want) > 50


def family(seed):
    """A hot vector, copies, ties, short and broken vectors, repeated ids, labels of one row."""
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=12)
    rows = []
    for i in range(260):
        v = hot + rng.normal(size=12) * rng.choice([0.0, 0.01, 0.2]) if i % 3 == 0 else rng.normal(size=12) * rng.choice([0.1, 1.0, 3.0])
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v.astype(np.float32)]))
    rows += [(50, 1, rows[50][2]), (50, 1, rows[50][2]), (100, 99, rows[3][2]), (7, None, rows[1][2]), (None, 1, rows[1][2])]
    rows += [(400, 2, None), (450, 2, [float("nan")] * 12), (500, 2, [None] * 12), (550, 2, [float("inf")] * 12), (600, 2, []), (650, 2, rows[3][2][:5]), (700, 3, [0.0] * 12)]
    return rows


@pytest.mark.parametrize("blocks", [hard_negatives.Blocks(), hard_negatives.Blocks(rows=40, anchors=3)])
def test_hostile(spark, blocks):
    rows = family(1)
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, blocks=blocks)
    assert rows_of(got) == plain(rows)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0, blocks=blocks).count() == 0


def test_large_scores_raise(spark):
    df = spark.createDataFrame([(0, 1, [1e9], "", 0)], SCHEMA)
    with pytest.raises(ValueError, match="exceed"):
        hard_negatives.mine(df, F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("share", [-1.0, 0.0, 0.3, 0.8])
def test_index_finds_every_pair(share):
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(size=(300, 21)) * rng.choice([1, 30, 200], size=(300, 1)))
    anchors = np.floor(rng.normal(size=(70, 21)) * 100)
    norms = np.sqrt((anchors**2).sum(axis=1))
    reach = share * np.sqrt((rows**2).sum(axis=1)).max()
    skip = rng.random((70, 300)) < 0.1
    index = hard_negatives.Index(rows, reach)
    one, two, score = index.join(anchors, reach * norms, skip)
    exact = anchors @ rows.T
    want = {(i, j): exact[i, j] for i, j in zip(*np.nonzero((exact >= (reach * norms)[:, None]) & ~skip))}
    assert dict(zip(zip(one.tolist(), two.tolist()), score.tolist())) == want
    if share > 0:
        assert (index.depth < len(index.starts)).any() and (index.omitted != 0).any()
