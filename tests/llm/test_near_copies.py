"""Near copies against exact Jaccard similarities of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_contracts import SF, frame, hostile

from hushline.llm import common, near_copies, ngram_join


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(docs):
    """Positions of the rows that stay: the first of each component."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * every:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [i for i in range(len(docs)) if root(i) == i]


def edited(seed=5, copies=40):
    """Texts with copies at similarities around the threshold, chains of edits, and one line that all share."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(4):
        text = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([60, 120, 400]))]
        at = list(text)
        for _ in range(copies):
            near = list(text)
            for _ in range(rnd.randint(0, len(text) // 30)):
                near[rnd.randrange(len(near))] = f"x{rnd.randint(0, 10**6)}"
            texts.append(" ".join(near))
            at[rnd.randrange(len(at))] = f"y{rnd.randint(0, 10**6)}"
            texts.append(" ".join(at))
    line = " ".join(f"c{i}" for i in range(20))
    texts += [line + "\n" + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(30)) for _ in range(60)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot_rows", [near_copies.HOT_ROWS, 8])
def test_near_copies(spark, hot_rows):
    docs = edited() + [(1000 + d, t) for d, t in hostile(6)]
    got = near_copies.drop_near_copies(frame(spark, docs), hot_rows)
    want = {docs[i][0] for i in kept(docs)}
    assert {r["doc_id"] for r in got.collect()} == want and 100 < len(want) < len(docs)
    assert near_copies.drop_near_copies(frame(spark, docs).limit(0)).count() == 0


def test_stage_links_edited_copies(spark):
    """A copy with one word in fifty changed is over 0.8, though its three-word fingerprint is further off than three bits."""
    words = [f"w{i}" for i in range(100)]
    edit = [w if i not in (30, 70) else "other" for i, w in enumerate(words)]
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(edit)), (3, " ".join(reversed(words)))])
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_fingerprints_link_close_copies(spark):
    """The stage's links come from fingerprints first: equal ones and those a few bits apart."""
    import numpy as np

    from hushline.llm import simhash

    texts = [" ".join(f"w{i}" if i != at else "other" for i in range(300)) for at in (-1, 1, 298)] + [" ".join(f"z{i}" for i in range(300))]
    prints = simhash.majorities([near_copies.shingle_set(t.encode()) for t in texts])
    assert max(int(np.bitwise_count(prints[0] ^ p)) for p in prints[1:3]) <= near_copies.NEAR_BITS
    rows = [(i, p) for i, p in enumerate(prints.view(np.int64).tolist())] + [(4, int(prints.view(np.int64)[3]))]
    pairs = near_copies.fingerprint_links(spark.createDataFrame(rows, "key long, fp long")).collect()
    found = {(r["a"], r["b"]) for r in pairs}
    close = {p for p in found if max(p) < 3}
    assert len(close) >= 2 and len({k for p in close for k in p}) == 3 and found - close == {(3, 4)}


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "near_fingerprints", lambda *a, f=near_copies.near_fingerprints: asked.append(a[2]) or f(*a))
    docs = frame(spark, edited(copies=3))
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert asked == [near_copies.NEAR_BITS] and got.count() == len(kept(edited(copies=3)))


def test_hand_overs_stay_linear(spark, monkeypatch):
    """A family just under the threshold hands on no quadratic number of pairs; a shared passage posts nothing."""
    from hushline.llm import ngram_join

    rows = {}

    def counted(df, purpose="stage", f=near_copies.stored):
        out = f(df, purpose)
        rows.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    monkeypatch.setattr(ngram_join, "stored", counted)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    family = []
    for _ in range(60):
        near = list(base)
        for at in rnd.sample(range(80), 10):  # changes 5 words apart: two of them differ in about a fifth of the shingles
            near[5 * at] = f"x{rnd.randint(0, 10**9)}"
        family.append(" ".join(near))
    docs = list(enumerate(family))
    got = near_copies.drop_near_copies(frame(spark, docs))
    assert got.count() == len(kept(docs)) and max(rows["pairs"]) <= 2 * len(docs)
    rows.clear()
    passage = " ".join(f"p{i}" for i in range(60))
    apart = [(d, passage + " " + " ".join(f"u{rnd.randint(0, 10**9)}" for _ in range(200))) for d in range(60)]
    assert near_copies.drop_near_copies(frame(spark, apart)).count() == 60 and max(rows["posts"]) == 0


def test_texts_become_shingles_in_small_slices():
    """A task holds the shingles of half a megabyte of text at a time, and hands on what it freed when it ends."""
    texts = [f"w{i} " * 500 for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["key", "_text"])
    for step in (ngram_join._sets(near_copies.RULE, True), ngram_join._prefixes(near_copies.RULE, np.zeros(1 << 22, np.uint16))):
        out = list(common.tidy(step)(iter([batch])))
        keys = [[k for k in b.column("key").to_pylist() if k is not None] for b in out]
        assert sum(keys, []) == list(range(1500))
        assert max(sum(len(texts[k]) for k in ks) for ks in keys) <= 1 << 19
