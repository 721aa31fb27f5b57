"""The n-gram join against exact similarities of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from test_contracts import SF, clashing, frame, hostile

from hushline.llm import ngram_join, queries
from hushline.llm.common import utf8


def shingles(text, size=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(docs, rule=ngram_join.Rule()):
    """doc_id, set size and smallest doc_id reachable; docs in the order of their ids."""
    sets = [shingles(t, rule.size) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [(d, len(sets[i]), docs[root(i)][0]) for i, (d, _) in enumerate(docs)]


def families(seed, most, copies=60):
    """Texts with up to ``most`` edits per hundred words, chains of edits, and a passage that all share."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(4):
        text = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([30, 60, 150, 400]))]
        at = list(text)
        for _ in range(copies):
            near = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) * most // 100))):
                near[rnd.randrange(len(near))] = f"x{rnd.randint(0, 10**6)}"
            texts.append(" ".join(near))
            at[rnd.randrange(len(at))] = f"y{rnd.randint(0, 10**6)}"
            texts.append(" ".join(at))
    line = " ".join(f"c{i}" for i in range(20))
    texts += [line + "\n" + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(30)) for _ in range(60)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op13_ngram_join(spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = plain(docs)
    assert sorted(tuple(r) for r in got.collect()) == want and any(d != c for d, _, c in want)


@pytest.mark.parametrize("group", [ngram_join.GROUP, 8])
@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(5, 8, 10)])
def test_families(spark, rule, group):
    docs = families(5, 6) + [(1000 + d, t) for d, t in hostile(6)]
    got = ngram_join.similar_documents(clashing(spark, docs), rule, group)
    want = plain(docs, rule)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert 20 < len({c for _, _, c in want}) < len(docs) - 100


def test_null_and_repeated_ids(spark):
    docs = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "x y z"), (5, None), (6, ""), (7, "one"), (8, "ONE"), (None, "lone words here")]
    got = sorted(tuple(r) for r in ngram_join.similar_documents(frame(spark, docs)).collect() if r["doc_id"] is not None)
    assert got == [(4, 1, 4), (4, 2, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7)]
    nulls = [tuple(r)[1:] for r in ngram_join.similar_documents(frame(spark, docs)).collect() if r["doc_id"] is None]
    assert sorted(nulls, key=str) == [(1, None), (2, 4), (2, 4)]
    assert ngram_join.similar_documents(frame(spark, docs).limit(0)).count() == 0


def test_refused_pairs_stay_in_their_tasks(spark, monkeypatch):
    """A family whose pairs nearly all fail: rows in proportion to sets and shingles, not to pairs."""
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        near = list(words)
        for at in rnd.sample(range(200), 5):
            near[at] = f"x{rnd.randint(0, 10**6)}"
        docs.append((i, " ".join(near)))
    rows = {}
    kept = ngram_join.stored

    def counting(df, purpose="stage"):
        out = kept(df, purpose)
        rows[purpose] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    got = ngram_join.similar_documents(frame(spark, docs))
    want = plain(docs)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({c for _, _, c in want}) > 30  # most pairs fail
    assert rows["pairs"] <= len(docs) and rows["proposed"] <= rows["posts"] and rows["asked"] <= rows["posts"]
    assert rows["further"] <= rows["asked"]


def test_bitmaps_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, int(rng.integers(1, 900)))) for _ in range(60)]
    bits = ngram_join.Bitmaps([ngram_join.parity(s) for s in sets])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(60), np.arange(60)))
    exact = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    far = bits.distance(x, y)
    assert (far <= exact).all()
    n = np.array([len(s) for s in sets])
    alike = (x != y) & (10 * np.minimum(n[x], n[y]) >= 9 * np.maximum(n[x], n[y]))
    rule = ngram_join.Rule()
    assert alike.sum() > 50 and (far[alike] > rule.apart(n[x][alike], n[y][alike])).mean() > 0.95  # unrelated sets are refused


def test_rank_table_counts_every_text(spark):
    docs = frame(spark, [(i, f"common words here and own{i} text{i}") for i in range(50)])
    texts = docs.select("doc_id", utf8("text").alias("_text")).toDF("key", "_text")
    ranks = ngram_join.rank_table(texts.mapInArrow(ngram_join._sets(ngram_join.Rule()), ngram_join.SET))
    shingle = ngram_join.Shingler(3)(b"common words here")
    assert ranks[ngram_join.cells_of(shingle)[0]] == 50 and ranks.astype(int).sum() == 50 * 4
