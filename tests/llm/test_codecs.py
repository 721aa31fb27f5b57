"""Token files and SentencePiece against the libraries themselves, and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_contracts import SF, frame, hostile
from tokenizers import Tokenizer

from hushline.llm import queries, sentencepiece_codec, token_codec
from hushline.session import new_folder

STRANGE = [
    "", " ", "   ", "a", " a  b", "\n\n\n", "漢字かな交じり文 🎉🎉 x\u0000y", "<s> <0x0A> </s> <|endoftext|>", "ab" * 500, "é" * 300,
    "\t\t\t    if x:\n        y", "العربية हिन्दी", "x" + " " * 50 + "y", "a" * 40, "=====-----____", "1234567890" * 10,
    "don't we'll İstanbul ΣΑΣ ﬁ", "e\u0301 a\u0308 \u0301x", "a\u00a0b\u2003c\u0085d", "ÀÉ’s",
]


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def token_rows(docs):
    start = 0
    for doc, text in docs:
        ids = [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op2(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op2_token_codec(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(token_rows(docs))


@pytest.mark.parametrize("block_ids", [1, 700])
def test_token_files_hostile(spark, monkeypatch, block_ids):
    monkeypatch.setattr(token_codec, "BLOCK_IDS", block_ids)
    docs = hostile(6) + list(enumerate(STRANGE, 1000))
    path = new_folder(spark, "test")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        token_codec.write(frame(spark, docs), path, file.read(), 2)
    got = token_codec.read(spark, path).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == list(token_rows(docs))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)


def test_token_files_empty_and_single(spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    for docs in ([], [(1, None)], [(None, None), (1, ""), (1, "")]):
        path = new_folder(spark, "test")
        token_codec.write(frame(spark, docs), path, model, 2)
        got = token_codec.read(spark, path).collect()
        assert len(got) == len(docs) and all(r["n_tokens"] == 1 for r in got)


def test_code_lengths_are_optimal_and_limited():
    rnd = random.Random(1)
    for n in (2, 3, 17, 300):
        counts = np.array([int(rnd.expovariate(1) ** 6 * 1000) + 1 for _ in range(n)])
        free = token_codec.code_lengths(counts, 20)
        heap = sorted(counts.tolist())
        cost = 0
        while len(heap) > 1:
            heap.sort()
            a = heap.pop(0) + heap.pop(0)
            cost += a
            heap.append(a)
        assert int((free * counts).sum()) == cost or free.max() == 20
        tight = token_codec.code_lengths(counts, int(np.ceil(np.log2(n))) + 1)
        assert (0.5**tight).sum() <= 1 and tight.max() <= np.ceil(np.log2(n)) + 1
    # against all length vectors of a small case
    from itertools import product
    counts = np.array([1, 1, 2, 3, 5, 40])
    best = min(sum(a * b for a, b in zip(v, counts)) for v in product(range(1, 5), repeat=6) if sum(0.5**x for x in v) <= 1 and max(v) <= 3)
    assert int((token_codec.code_lengths(counts, 3) * counts).sum()) == best


def test_sentencepiece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + d, t) for d, t in hostile(7)] + list(enumerate(STRANGE, 20_000))
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(frame(spark, docs), path).collect()}
    for doc, text in docs:
        assert got[doc]["ids"] == library.encode(text or "") and got[doc]["decoded"] == (text or "")
        assert got[doc]["n_ids"] == len(got[doc]["ids"]) and got[doc]["text"] == text
    assert sentencepiece_codec.encode(frame(spark, docs).limit(0), path).count() == 0


def test_op5(spark):
    rows = queries.op5_sentencepiece(spark, SF).collect()
    assert len(rows) == 200 and all(r["round_trip"] for r in rows)


def test_unigram_relaxing_is_best():
    model = sentencepiece_codec.Model.load(public_tokenizers.path("piece_bpe_32k.model"), unigram=True)
    encoder = sentencepiece_codec.Encoder(model)
    score = encoder.score
    flat, at = encoder.encode(["the other thing"])
    total = sum(model.scores[i] for i in flat.tolist())
    text = "▁the▁other▁thing"
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = max((best[a] + score[text[a:end]] for a in range(max(0, end - 48), end) if text[a:end] in score), default=float("-inf"))
    assert total == pytest.approx(best[-1])


def test_units_met_early_stay_known(monkeypatch):
    """A full table keeps its first units and looks later ones up; texts of another kind start a new one."""
    monkeypatch.setattr(sentencepiece_codec, "UNITS", 60)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Model.load(path))
    rnd = random.Random(7)
    common = [f"word{i}" for i in range(50)]
    for part in range(6):
        texts = [" ".join(rnd.choices(common, k=40) + [f"rare{part}x{i}y{k}" for k in range(3)]) for i in range(8)]
        ids, at = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in texts]
        assert {"\u2581" + w for t in texts for w in t.split() if w in common} <= set(encoder.known) and len(encoder.known) <= 100
    texts = [f"other{i} thing{i}" for i in range(80)]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in texts]
    assert "\u2581word1" not in encoder.known
    assert sentencepiece_codec.encoder_of("x", encoder.model, encoder.merges) is sentencepiece_codec.encoder_of("x", encoder.model, encoder.merges)
