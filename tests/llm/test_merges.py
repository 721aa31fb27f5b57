"""Whether two pieces stay apart, read off the merge tables and by merging their characters."""

import numpy as np
import public_tokenizers
import pytest

from hushline.llm import sentencepiece_codec as codec


@pytest.fixture(scope="module")
def merges():
    model = codec.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return model, codec.Merges(model)


def test_tables_agree_with_merging(merges):
    model, tables = merges
    rng = np.random.default_rng(1)
    plain = np.array([i for i in model.normal if tables.whole[i] and not tables.odd[i]])
    short = np.array([i for i in plain if len(model.pieces[i]) <= 3])
    a = np.concatenate([rng.choice(plain, 4000), rng.choice(short, 8000), short])
    b = np.concatenate([rng.choice(plain, 4000), rng.choice(short, 8000), short])  # every short piece beside itself, too
    got = tables.stay_apart(a, b)
    text = lambda i: model.pieces[i]
    want = [codec.merge(text(x) + text(y), tables.score) == [text(x), text(y)] for x, y in zip(a, b)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_only_runs_of_marks_are_odd(merges):
    model, tables = merges
    assert all(set(model.pieces[i]) == {codec.MARK} for i in np.flatnonzero(tables.odd))
