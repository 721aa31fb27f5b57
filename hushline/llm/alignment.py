"""Alignment of two tokenizers' tokens by lockstep merging of their byte offsets.

Every text is encoded by a byte-level tokenizer (A, given one space and the text) and by a SentencePiece model (B, which
adds the space itself).  Tokens become byte ranges; where an A token and a B token end at the same byte, the text is cut,
and the two tokens are linked.  Between two cuts lies a group: the fewest A and B tokens that spell the same bytes.

Merging.  The documents of a slice advance together: one state vector holds a pointer into the A ends and one into the B
ends of each document.  A step compares the two ends of all documents, writes a link and a cut where they are equal, and
moves the pointer whose end is smaller (both, if equal); finished documents leave the state.

Encoding.  Between two characters that are not white space, a single space begins a new word for both tokenizers (checked
on their files when they are loaded; otherwise the whole text is one word).  So the libraries see each distinct word of a
task once, and a text's tokens are put together from its words'.

Scores.  The count of an id pair is the number of links of the whole corpus that hold it.  Tasks count their own pairs
before anything is shuffled.  The ``HEAVY`` most frequent pairs (a bound on what is sent to tasks) are looked up in place;
the links of all other pairs, none of which can be hot, meet their counts in a join.  Both ways are exact.

Defined cases: null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens:
counts of zero and an empty digest.  Rows keep their doc_id, null or repeated, and are aligned each on their own; other
columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import slices, utf8
from hushline.session import stored

HEAVY = 1 << 17
PAIRS = 1 << 20  # distinct pairs that a task counts before it hands them on
SLICE = 4 << 20
WORDS = 500_000  # words whose tokens a task remembers
MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Spelling:
    """The bytes of each id, and its number as text with each separator of the group notation behind it."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.sizes = np.array([len(s) for s in spelled], np.int64)

    def numbers(self, close: str) -> np.ndarray:
        """At 2 i the number i and a comma, at 2 i + 1 the number and ``close``."""
        return np.array([f"{i}{c}".encode() for i in range(len(self.spelled)) for c in (",", close)], object)


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers, as the text of A's file and the serialised model of B."""

    a_json: str
    b_model: bytes

    @staticmethod
    def load(a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return Tokenizers(a.read(), b.read())

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.a_json)
        found.encode_special_tokens = True
        return found

    @cached_property
    def b(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.b_model)

    @cached_property
    def a_spelling(self) -> Spelling:
        letters = byte_letters()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        return Spelling([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens])

    @cached_property
    def b_spelling(self) -> Spelling:
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        spell = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
        return Spelling([spell(i, p) for i, p in enumerate(pieces)])

    @cached_property
    def notes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a_spelling.numbers("|"), self.b_spelling.numbers(";")

    @cached_property
    def cuts_words(self) -> bool:
        """Whether a space between two characters that are not white space starts a word for both."""
        settings = json.loads(self.a_json)
        before = settings.get("pre_tokenizer") or {}
        a = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not settings.get("normalizer")
        pieces = (self.b.id_to_piece(i) for i in range(self.b.vocab_size()))
        return bool(a) and not any(MARK in p.lstrip(MARK) for p in pieces)

    def __getstate__(self):
        return self.a_json, self.b_model  # the loaded tokenizers stay where they are

    def __setstate__(self, state) -> None:
        object.__setattr__(self, "a_json", state[0])
        object.__setattr__(self, "b_model", state[1])


def lockstep(a_ends: np.ndarray, a_at: np.ndarray, b_ends: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends at the same byte, or -1; ``at`` are the documents' offsets into the ends."""
    link = np.full(len(a_ends), -1, np.int64)
    open_ = np.flatnonzero((a_at[1:] > a_at[:-1]) & (b_at[1:] > b_at[:-1]))
    a, b = a_at[open_], b_at[open_]
    a_stop, b_stop = a_at[open_ + 1], b_at[open_ + 1]
    while len(a):
        x, y = a_ends[a], b_ends[b]
        equal = x == y
        link[a[equal]] = b[equal]
        a = a + (x <= y)
        b = b + (y <= x)
        more = (a < a_stop) & (b < b_stop)
        if not more.all():
            a, b, a_stop, b_stop = a[more], b[more], a_stop[more], b_stop[more]
    return link


@dataclass
class Aligned:
    """A slice of documents: flat ids, the documents' offsets, and the linked positions in reading order."""

    a_ids: np.ndarray
    a_at: np.ndarray
    b_ids: np.ndarray
    b_at: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.a_cut, self.a_at))


def words_of(text: str) -> list[str]:
    """The words of a text: cut at single spaces between characters that are not white space."""
    words = text.split(" ")
    if all(map(str.strip, words)) and all(w == w.strip() for w in words):
        return words
    out = [words[0]]
    for w in words[1:]:
        if out[-1] and w and not out[-1][-1].isspace() and not w[0].isspace():
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}"
    return out


class Words(dict):
    """The tokens of each word that a task has met: a number per word, and the words' ids one after the other."""

    def __init__(self, tokenizers: Tokenizers):
        super().__init__()
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.good = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        t = self.tokenizers
        found = [e.ids for e in t.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)], t.b.encode(words, num_threads=1)
        wholes = [b" " + w.encode() for w in words]
        good = np.ones(len(words), bool)
        for ids, spelling in zip(found, (t.a_spelling, t.b_spelling)):
            good &= self._same(ids, spelling.spelled.__getitem__, wholes)
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.good = np.concatenate([self.good, good])
        for side, ids in enumerate(found):
            self.ids[side] = np.concatenate([self.ids[side], np.fromiter(chain.from_iterable(ids), np.int64)])
            self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + np.cumsum([len(i) for i in ids])])

    @staticmethod
    def _same(ids: list[list[int]], spelled, wholes: list[bytes]) -> np.ndarray:
        """Whether the ids of each word spell it: in one comparison if all do, else word by word."""
        lengths = [len(i) for i in ids]
        flat = list(map(spelled, chain.from_iterable(ids)))
        ends = np.concatenate([[0], np.cumsum([len(p) for p in flat])])[np.cumsum(lengths)]
        if b"".join(flat) == b"".join(wholes) and (ends == np.cumsum([len(w) for w in wholes])).all():
            return np.ones(len(ids), bool)
        return np.array([b"".join(map(spelled, i)) == w for i, w in zip(ids, wholes)])

    def tokens(self, side: int, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, and the offsets of the texts, of which ``at`` holds the offsets in words."""
        n = self.at[side][words + 1] - self.at[side][words]
        until = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(self.at[side][words] - until[:-1], n) + np.arange(until[-1])
        return self.ids[side][place], until[at]


def ends(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte at which each token ends in its own document."""
    running = np.concatenate([[0], np.cumsum(sizes[ids])])
    return running[1:] - np.repeat(running[at[:-1]], np.diff(at))


def align_texts(known: Words, texts: list[bytes]) -> Aligned:
    tokenizers = known.tokenizers
    if len(known) > WORDS:
        known.forget()
    words: list[list[str]] = []
    for text in texts:
        try:
            whole = text.decode()
        except UnicodeDecodeError:  # no tokenizer gives these bytes back
            whole = ""
        words.append((words_of(whole) if tokenizers.cuts_words else [whole]) if whole else [])
    fresh = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in known]
    if fresh:
        known.learn(fresh)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(at[-1]))
    running = np.concatenate([[0], np.cumsum(~known.good[numbers])])
    good = np.repeat(running[at[1:]] == running[at[:-1]], np.diff(at))  # words of texts that both give back
    at, numbers = np.concatenate([[0], np.cumsum(good)])[at], numbers[good]
    (a, a_at), (b, b_at) = (known.tokens(side, numbers, at) for side in (0, 1))
    link = lockstep(ends(a, a_at, tokenizers.a_spelling.sizes), a_at, ends(b, b_at, tokenizers.b_spelling.sizes), b_at)
    a_cut = np.flatnonzero(link >= 0)
    return Aligned(a, a_at, b, b_at, a_cut, link[a_cut])


def notation(tokenizers: Tokenizers, found: Aligned) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = len(found.a_ids), len(found.b_ids)
    a_ends, b_ends = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    a_ends[found.a_cut], b_ends[found.b_cut] = 1, 1
    # Groups before each token; a B token also stands behind the A tokens of its own group.
    a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
    b_before = np.concatenate([[0], found.b_cut + 1])
    a_until = np.concatenate([found.a_cut + 1, [n_a]])
    text = np.empty(n_a + n_b, object)
    a_notes, b_notes = tokenizers.notes
    text[np.arange(n_a) + b_before[a_group]] = a_notes[2 * found.a_ids + a_ends]
    text[np.arange(n_b) + a_until[b_group]] = b_notes[2 * found.b_ids + b_ends]
    at = found.a_at + found.b_at
    return [b"".join(text[x:y].tolist())[:-1] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def _schema(docs: DataFrame) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    return T.StructType([docs.schema["doc_id"], *longs, T.StructField("groups_sha256", T.StringType()), T.StructField("_links", T.BinaryType())])


def groups(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id, the ids of both tokenizers, and after how many A and B tokens each group ends."""
    names = ("a_ids", "b_ids", "a_cuts", "b_cuts")
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(tokenizers)
        for part in slices(batches, "_text", SLICE):
            f = align_texts(known, part.column("_text").to_pylist())
            cut_at = np.concatenate([[0], np.cumsum(f.n_links)])
            lists = [
                (f.a_at, f.a_ids), (f.b_at, f.b_ids),
                (cut_at, f.a_cut + 1 - np.repeat(f.a_at[:-1], f.n_links)), (cut_at, f.b_cut + 1 - np.repeat(f.b_at[:-1], f.n_links)),
            ]
            arrays = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for at, v in lists]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *names])

    return docs.select("doc_id", utf8("text").alias("_text")).mapInArrow(run, schema)


def linked(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id, token, group and link counts, the digest of the groups, and ``_links``: the id pairs (a * B ids + b) as bytes."""
    schema = _schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(tokenizers)
        for part in slices(batches, "_text", SLICE):
            f = align_texts(known, part.column("_text").to_pylist())
            n_links = f.n_links
            codes = f.a_ids[f.a_cut] * len(tokenizers.b_spelling.sizes) + f.b_ids[f.b_cut]
            raw = codes.astype("<u4" if len(tokenizers.a_spelling.sizes) * len(tokenizers.b_spelling.sizes) <= 1 << 32 else "<u8")
            at = np.concatenate([[0], np.cumsum(n_links)])
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in notation(tokenizers, f)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(f.a_at)), pa.array(np.diff(f.b_at)), pa.array(n_links), pa.array(n_links),
                    pa.array(digests, pa.string()), pa.array([raw[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary()),
                ],
                schema.names,
            )

    return docs.select("doc_id", utf8("text").alias("_text")).mapInArrow(run, schema)


PAIR = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of a task, counted as far as ``PAIRS`` different ones fit."""
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in slices(batches, "_links", SLICE):
            fresh, times = np.unique(np.frombuffer(b"".join(part.column("_links").to_pylist()), kind), return_counts=True)
            pairs, where = np.unique(np.concatenate([pairs, fresh.astype(np.int64)]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, times]), len(pairs)).astype(np.int64)
            if len(pairs) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], PAIR.names)
                pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], PAIR.names)

    return run


def _scored(kind: str, heavy: np.ndarray, n: np.ndarray, best: np.ndarray, names: list[str]):
    """Sums over the links of heavy pairs; the others' pairs go on as ``_rare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_links", SLICE):
            raw = part.column("_links").to_pylist()
            codes = np.frombuffer(b"".join(raw), kind).astype(np.int64)
            at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]) // np.dtype(kind).itemsize
            place = np.minimum(np.searchsorted(heavy, codes), max(0, len(heavy) - 1))
            hit = heavy[place] == codes if len(heavy) else np.zeros(len(codes), bool)
            sums = []
            for value in (np.where(hit, n[place], 0), np.where(hit, best[place], 0)) if len(heavy) else (hit, hit):
                running = np.concatenate([[0], np.cumsum(value.astype(np.int64))])
                sums.append(pa.array(running[at[1:]] - running[at[:-1]]))
            rare_at = np.concatenate([[0], np.cumsum(~hit)])[at]
            rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(codes[~hit]))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *sums, rare], [*names, "_sum", "_best", "_rare"])

    return run


def align(docs: DataFrame, tokenizers: Tokenizers, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    n_b_ids = len(tokenizers.b_spelling.sizes)
    kind = "<u4" if len(tokenizers.a_spelling.sizes) * n_b_ids <= 1 << 32 else "<u8"
    rows = stored(linked(docs, tokenizers).withColumn("_key", F.monotonically_increasing_id()), "aligned")
    pairs = stored(rows.select("_links").mapInArrow(_counted(kind), PAIR).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.pmod("pair", F.lit(n_b_ids))
    highest = pairs.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_most"))  # at most one row per id of B
    judged = stored(pairs.join(highest, b_id == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).cast("long").alias("best")), "judged")
    top = judged.orderBy(F.desc("n")).limit(heavy).toArrow()  # at most ``heavy`` rows
    order = np.argsort(top.column("pair").to_numpy())
    known = [top.column(c).to_numpy()[order] for c in ("pair", "n", "best")]
    names = ["_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    longs = [T.StructField("_sum", T.LongType()), T.StructField("_best", T.LongType()), T.StructField("_rare", T.ArrayType(T.LongType(), False))]
    schema = T.StructType([*[rows.schema[c] for c in names], *longs])
    scored = stored(rows.select(*names, "_links").mapInArrow(_scored(kind, *known, names), schema), "scored")
    rest = scored.select("_key", F.explode("_rare").alias("pair")).join(judged, "pair")
    rest = rest.groupBy(F.col("_key").alias("_k")).agg(F.sum("n").alias("_n"), F.sum("best").alias("_b"))
    return scored.join(rest, F.col("_key") == F.col("_k"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("_best") + F.coalesce("_b", F.lit(0))).alias("n_best"),
        (F.col("_sum") + F.coalesce("_n", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
