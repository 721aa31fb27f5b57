"""Cross-tokenizer alignment against a plain walk over both libraries' tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers as library
from test_contracts import SF, clashing, frame, hostile

from hushline.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = ["<|endoftext|> <s></s> <0x41>", "a▁b", "  two  spaces ", "naïve 漢字 🎉👍🏽", "ﬁne Å   x", "tab\tand\nline\r\n", "\u0000nul"]


def plain(docs):
    a_lib, b_lib = library.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letters = alignment.byte_letters()
    found, links = [], []
    for doc, text in docs:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        a_end, b_end = ends(a_bytes), ends(b_bytes)
        cuts = sorted(set(a_end) & set(b_end))
        groups, pairs, low = [], [], 0
        for cut in cuts:
            one = [i for i, e in zip(a, a_end) if low < e <= cut], [i for i, e in zip(b, b_end) if low < e <= cut]
            groups.append("|".join(",".join(map(str, side)) for side in one))
            pairs.append((one[0][-1], one[1][-1]))
            low = cut
        found.append((doc, len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        links.append(pairs)
    counts = Counter(p for pairs in links for p in pairs)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(*f[:5], sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), f[5]) for f, pairs in zip(found, links)]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op11_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == plain(docs)


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 5, 0])
def test_hostile(spark, heavy, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 3000)
    docs = [d for d in hostile(3) if len(d[1] or "") < 9000]
    docs += [(500 + i, t) for i, t in enumerate(STRANGE)]
    both = alignment.Tokenizers.load(A, B)
    got = alignment.align(clashing(spark, docs), both, heavy)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == plain(docs)
    assert alignment.align(frame(spark, docs).limit(0), both, heavy).count() == 0
    repeated = alignment.align(frame(spark, [(None, "one two"), (None, "one two"), (3, "one two"), (3, None)]), both, heavy)
    assert sorted(r["count_sum"] for r in repeated.collect()) == [0, 6, 6, 6]


def test_groups_spell_the_text(spark):
    docs = [(i, t) for i, t in enumerate(STRANGE[2:4] + ["Plain words, 1234 and ünïcödé."])]
    both = alignment.Tokenizers.load(A, B)
    for row, (_, text) in zip(alignment.groups(frame(spark, docs), both).orderBy("doc_id").collect(), docs):
        a_low = b_low = 0
        spelled = b""
        for a_cut, b_cut in zip(row["a_cuts"], row["b_cuts"]):
            a = b"".join(both.a_spelling.spelled[i] for i in row["a_ids"][a_low:a_cut])
            assert a == b"".join(both.b_spelling.spelled[i] for i in row["b_ids"][b_low:b_cut])
            a_low, b_low, spelled = a_cut, b_cut, spelled + a
        assert spelled == (" " + text).encode()


def test_lockstep_links_equal_ends():
    rng = np.random.default_rng(3)
    a_ends, b_ends, a_at, b_at = [], [], [0], [0]
    want = []
    for _ in range(200):
        size = int(rng.integers(0, 40))
        a, b = (sorted({*rng.integers(1, size + 1, int(rng.integers(0, size + 1))).tolist(), size}) if size else [] for _ in range(2))
        want += [len(b_ends) + b.index(e) if e in b else -1 for e in a]
        a_ends += a
        b_ends += b
        a_at.append(len(a_ends))
        b_at.append(len(b_ends))
    assert alignment.lockstep(*(np.array(v) for v in (a_ends, a_at, b_ends, b_at))).tolist() == want
