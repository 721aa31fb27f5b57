"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is normalised (spaces become the mark U+2581, one mark is put in front) and cut into units, a run of marks
and the characters after it: no piece of the vocabulary goes on from a character to a mark, so units are encoded on
their own.  The distinct units of a batch form one byte text.  Its suffixes are sorted (by prefix doubling, as far as the
longest piece reaches), every piece is binary-searched in the suffix array for its range of occurrences, the occurrences
become edges from start to end, and the edges, sorted by end, are relaxed for all units side by side.

Relaxing.  A BPE model's encoding of a prefix ends in exactly one piece: the one whose start is itself the end of an encoded
prefix and whose neighbour there is stable, meaning that the merges of the two pieces' characters give the same two pieces
back.  So an edge is relaxed if the last piece at its start and its own piece are a stable pair; stability is read
off tables of the model's merges, for all edges of a step at once.  A unigram model relaxes to the highest sum of scores instead.  A character without a piece is an edge
of its own and is written as its UTF-8 bytes (byte fallback).

Defined cases: null and empty texts have no ids and decode to the empty text; the mark itself in a text decodes to a space,
as in the model's own library; rows that repeat are encoded on their own; other columns pass through, but
ids, n_ids and decoded are replaced (and the helper's name _utf8 is not kept).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import slices, tidy, utf8

MARK = "▁"
UNITS = 200_000  # units whose ids a worker remembers
NONE = float("-inf")  # the score of neighbours that do not merge
PAIRS = 300_000  # pairs whose stability a task remembers


@dataclass
class Model:
    """The vocabulary: piece texts, scores, the pieces that text may match, and the ids of single bytes."""

    pieces: list[str]
    scores: list[float]
    normal: list[int]
    byte_ids: dict[int, int]
    unigram: bool = False

    @staticmethod
    def load(path: str, unigram: bool = False) -> Model:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        byte_ids = {int(pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(byte_ids) != 256:
            raise ValueError("The model has no byte fallback")
        return Model(pieces, [sp.get_score(i) for i in ids], normal, byte_ids, unigram)


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Positions of ``text`` sorted by their first ``reach`` bytes or more."""
    words = packed(text)
    order = np.argsort(words)  # which of equal prefixes comes first does not matter
    length = 8
    while True:
        ranked = words[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if length >= reach or rank[order[-1]] == len(text) - 1:
            return order
        after = np.zeros(len(text), np.int64)
        after[: max(0, len(text) - length)] = rank[length:] + 1
        words = rank * (len(text) + 1) + after
        order = np.argsort(words)
        length *= 2


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zero beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


class Pieces:
    """The vocabulary as padded words for binary search."""

    def __init__(self, model: Model):
        texts = [model.pieces[i].encode() for i in model.normal]
        self.ids = np.array(model.normal, np.int64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.reach = int(self.lengths.max())
        n_words = -(-self.reach // 8)
        pack = lambda fill: np.array([np.frombuffer(t.ljust(8 * n_words, fill), ">u8") for t in texts]).astype(np.uint64)
        self.low, self.high = pack(b"\0"), pack(b"\xff")

    def ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last place of each piece's occurrences in the suffix array."""
        words = np.concatenate([packed(text), np.zeros(8 * self.low.shape[1], np.uint64)])
        # A piece of eight bytes or more is searched only if its first eight bytes occur at all.
        ranked = words[order]
        at = np.minimum(np.searchsorted(ranked, self.low[:, 0]), len(ranked) - 1)
        some = np.flatnonzero((self.lengths < 8) | (ranked[at] == self.low[:, 0]))
        low, high = np.zeros((2, len(self.low)), np.int64)
        low[some] = self._bound(words, order, self.low[some], False)
        high[some] = self._bound(words, order, self.high[some], True)
        return low, high

    def _bound(self, words: np.ndarray, order: np.ndarray, wanted: np.ndarray, equal: bool) -> np.ndarray:
        """Number of suffixes below each wanted key (``equal``: or equal to it)."""
        low = np.zeros(len(wanted), np.int64)
        high = np.full(len(wanted), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            place = order[mid]
            below = np.full(len(open_), equal)
            decided = np.zeros(len(open_), bool)
            for k in range(wanted.shape[1]):
                have, want = words[place + 8 * k], wanted[open_, k]
                below = np.where(~decided & (have != want), have < want, below)
                decided |= have != want
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]


def merge(text: str, scores: dict[str, float], last: list | None = None) -> list[str]:
    """The merges of a short text: the best-scored neighbours first, the leftmost of equals; ``last`` takes the last pair."""
    parts, score = list(text), scores.get
    joined = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while joined:
        best = max(joined)
        if best == NONE:
            break
        at = joined.index(best)
        if last is not None:
            last[:] = parts[at : at + 2]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del joined[at]
        if at:
            joined[at - 1] = score(parts[at - 1] + parts[at], NONE)
        if at < len(joined):
            joined[at] = score(parts[at] + parts[at + 1], NONE)
    return parts


class Merges:
    """Tables of a BPE model's merges: the last merge of each piece, and the score of each pair that is a piece.

    ``whole``: the merges of the piece's characters give the piece.  Where every piece scores below its two parts, merges
    happen in the order of their scores, and whether two neighbours stay apart can be told from the parts that lie at
    their border at each time.  ``odd`` are the pieces (runs of marks, say) with tied scores or parts out of order.
    """

    def __init__(self, model: Model):
        n = len(model.pieces)
        self.score = {model.pieces[i]: model.scores[i] for i in model.normal}
        number = {model.pieces[i]: i for i in model.normal}
        self.whole = np.zeros(n + 1, bool)
        self.made = np.full(n + 1, np.inf)  # score of the merge that made the piece; characters are there from the start
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs: dict[int, float] = {}
        for i in model.normal:
            text, last = model.pieces[i], []
            self.whole[i] = merge(text, self.score, last) == [text]
            if self.whole[i] and last:
                self.made[i], self.left[i], self.right[i] = model.scores[i], number.get(last[0], i), number.get(last[1], i)
            for k in range(1, len(text)):
                a, b = number.get(text[:k]), number.get(text[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = model.scores[i]
        self.size = n + 1
        self.codes = np.array(sorted(pairs), np.int64)
        self.scores = np.array([pairs[c] for c in self.codes.tolist()])
        made = self.made
        split = np.flatnonzero(np.isfinite(made))
        values, times = np.unique(made[split], return_counts=True)
        tied = np.isin(made, values[times > 1])
        self.odd = (tied | (made >= made[self.left]) | (made >= made[self.right])) & np.isfinite(made)
        while True:
            spread = self.odd | (np.isfinite(made) & (self.odd[self.left] | self.odd[self.right]))
            if (spread == self.odd).all():
                break
            self.odd = spread

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether whole pieces a and b, side by side, stay as they are.

        Going back in time, the parts at the border are undone, the one that was made last first.  A merge across the
        border happens if it scores above the merges that used its two parts up (of equals, the leftmost comes first).
        """
        out = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_used, y_used = np.full(len(a), NONE), np.full(len(a), NONE)
        while len(open_):
            code = x * self.size + y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            score = np.where(self.codes[at] == code, self.scores[at], NONE) if len(self.codes) else np.full(len(code), NONE)
            across = (score > x_used) & (score >= y_used) & (score > NONE)  # of equal scores the left one is merged first
            out[open_[across]] = False
            go = ~across & (np.isfinite(self.made[x]) | np.isfinite(self.made[y]))
            open_, x, y, x_used, y_used = open_[go], x[go], y[go], x_used[go], y_used[go]
            back = self.made[x] < self.made[y]
            x_used, y_used = np.where(back, self.made[x], x_used), np.where(back, y_used, self.made[y])
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return out


@dataclass
class Encoder:
    model: Model
    known: dict[str, int] = field(default_factory=dict)
    stable: dict[tuple[int, int], bool] = field(default_factory=dict)
    merges: Merges | None = None

    def __post_init__(self) -> None:
        self.pieces = Pieces(self.model)
        self.score = {self.model.pieces[i]: self.model.scores[i] for i in self.model.normal}
        if self.merges is None and not self.model.unigram:
            self.merges = Merges(self.model)
        self.scores = np.array([*self.model.scores, min(self.model.scores[i] for i in self.model.normal) - 10.0])
        self.unknown = len(self.model.pieces)  # stands for a character without a piece
        self.singles = {self.model.pieces[i] for i in self.model.normal if len(self.model.pieces[i]) == 1}
        crosses = any(MARK in self.model.pieces[i].lstrip(MARK) for i in self.model.normal)
        self.cut = re.compile(r"(?s).+") if crosses else re.compile(f"(?s){MARK}*[^{MARK}]+|{MARK}+")
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def is_stable(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each pair stays as it is; ``before`` -2 stands for the start of a unit."""
        merges = self.merges
        alone = (piece == self.unknown) | merges.whole[piece]
        paired = np.flatnonzero((before >= 0) & (before != self.unknown) & (piece != self.unknown) & alone)
        odd = merges.odd[before[paired]] | merges.odd[piece[paired]]
        plain, odd = paired[~odd], paired[odd]
        alone[plain] = merges.stay_apart(before[plain], piece[plain])
        alone[odd] = [self._pair_stays(a, b) for a, b in zip(before[odd].tolist(), piece[odd].tolist())]
        return alone

    def _pair_stays(self, a: int, b: int) -> bool:
        """By merging the pair's characters, once per pair."""
        if len(self.stable) > PAIRS:
            self.stable.clear()
        if (a, b) not in self.stable:
            want = [self.model.pieces[a], self.model.pieces[b]]
            self.stable[a, b] = merge("".join(want), self.merges.score) == want
        return self.stable[a, b]

    def edges(self, text: np.ndarray, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of a piece and of every character without one."""
        order = suffix_array(text, self.pieces.reach)
        low, high = self.pieces.ranges(text, order)
        n = high - low
        start = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        end = start + np.repeat(self.pieces.lengths, n)
        piece = np.repeat(self.pieces.ids, n)
        lone = []
        strange = set("".join(units)) - self.singles
        if strange:
            whole = text.tobytes()
            for c in strange:
                code = c.encode()
                lone += [(m.start(), m.start() + len(code), self.unknown) for m in re.finditer(re.escape(code), whole)]
            more = np.array(lone, np.int64)
            start, end, piece = (np.concatenate([v, more[:, k]]) for k, v in enumerate((start, end, piece)))
        return start, end, piece

    def learn(self, units: list[str]) -> None:
        """Encode units that the task has not met and append their ids."""
        coded = [u.encode() for u in units]
        text = np.frombuffer(b"\xff".join(coded) + b"\xff", np.uint8)
        size = np.array([len(c) for c in coded], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        start, end, piece = self.edges(text, units)
        own = np.repeat(np.arange(len(units)), size + 1)[start]
        depth = end - first[own]
        # Numbers of two bytes are sorted by radix.
        by_end = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        start, end, piece, depth = start[by_end], end[by_end], piece[by_end], depth[by_end]
        last = np.full(len(text) + 1, -1, np.int64)  # piece that ends here
        came = np.zeros(len(text) + 1, np.int64)  # and where it starts
        last[first] = -2
        best = np.full(len(text) + 1, -np.inf)
        best[first] = 0.0
        cuts = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(depth) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            ok = last[s] != -1
            s, e, p = s[ok], e[ok], p[ok]
            if self.model.unigram:
                value = best[s] + self.scores[p]
                rank = np.lexsort((value, e))
                s, e, p, value = s[rank], e[rank], p[rank], value[rank]
                final = np.flatnonzero(np.concatenate([e[1:] != e[:-1], [True]])) if len(e) else []
                s, e, p = s[final], e[final], p[final]
                best[e] = value[final]
            else:
                ok = self.is_stable(last[s], p)
                s, e, p = s[ok], e[ok], p[ok]
            last[e], came[e] = p, s
        self._append(units, text, first, first + size, last, came)

    def _append(self, units, text, first, at, last, came) -> None:
        """Walk back from the end of each unit and store its ids in reading order."""
        if (last[at] == -1).any():
            raise ValueError("A unit has no path; the vocabulary does not cover its characters")
        at = at.copy()
        lanes, steps, pieces, begins, stops = [], [], [], [], []
        open_ = np.flatnonzero(at > first)
        step = 0
        while len(open_):
            here = at[open_]
            lanes.append(open_)
            steps.append(np.full(len(open_), step))
            pieces.append(last[here])
            begins.append(came[here])
            stops.append(here)
            at[open_] = came[here]
            open_ = open_[at[open_] > first[open_]]
            step += 1
        lane, back, ids, begin, stop = (np.concatenate(v) for v in (lanes, steps, pieces, begins, stops))
        order = np.lexsort((-back, lane))
        lane, ids, begin, stop = lane[order], ids[order], begin[order], stop[order]
        if (ids == self.unknown).any():
            spread = np.where(ids == self.unknown, stop - begin, 1)
            of = np.repeat(np.arange(len(ids)), spread)
            byte = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(spread) - spread, spread)
            table = np.array([self.model.byte_ids[b] for b in range(256)])
            fallback = ids[of] == self.unknown
            ids, lane = np.where(fallback, table[text[np.where(fallback, byte, 0)]], ids[of]), lane[of]
        count = np.bincount(lane, minlength=len(units))
        base = len(self.known)
        self.known.update(zip(units, range(base, base + len(units))))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts."""
        found = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(found))
        fresh = [u for u in distinct if u not in self.known]
        if self.known and len(self.known) + len(fresh) > UNITS and 4 * len(fresh) > 3 * len(distinct):
            self.forget()  # texts of another kind
            fresh = list(distinct)
        kept = len(self.known)
        if fresh:
            self.learn(fresh)
        units = np.concatenate([[0], np.cumsum([len(us) for us in found])]).astype(np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(units[-1]))
        count = self.at[codes + 1] - self.at[codes]
        flat = self.ids[np.repeat(self.at[codes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        if len(self.known) > UNITS and kept:  # the frequent units come early; later ones are looked up slice by slice
            for unit in fresh:
                del self.known[unit]
            self.at, self.ids = self.at[: kept + 1], self.ids[: self.at[kept]]
        return flat, np.concatenate([[0], np.cumsum(count)])[units]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(call: str, model: Model, merges: Merges | None) -> Encoder:
    """One encoder, with the units it knows, for all tasks of a worker that belong to one call of :func:`encode`."""
    if call not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[call] = Encoder(model, merges=merges)
    return _ENCODERS[call]


def decoder(model: Model):
    """Ids to text: pieces joined, marks back to spaces, the leading one dropped; bytes are put together."""
    table = [p.encode() for p in model.pieces]
    for byte, i in model.byte_ids.items():
        table[i] = bytes([byte])
    mark = MARK.encode()

    def decode(ids) -> str:
        joined = b"".join(map(table.__getitem__, ids)).replace(mark, b" ")
        return (joined[1:] if joined.startswith(b" ") else joined).decode("utf-8", "replace")

    return decode


def encode(docs: DataFrame, model_path: str, unigram: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``n_ids`` and ``decoded`` (the text that the ids give back)."""
    model = Model.load(model_path, unigram)
    merges = None if unigram else Merges(model)  # a few MB, whatever the input
    call = uuid.uuid4().hex
    names = [c for c in docs.columns if c not in ("ids", "n_ids", "decoded", "_utf8")]
    source = docs.select(*names, utf8("text").alias("_utf8"))
    schema = T.StructType(
        [*docs.select(*names).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_ids", T.LongType()), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decode = encoder_of(call, model, merges), decoder(model)
        for part in slices(batches, "_utf8", 1 << 20):
            texts = [t.decode("utf-8", "replace") for t in part.column("_utf8").to_pylist()]
            flat, at = encoder.encode(texts)
            decoded = [decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], ids, pa.array(np.diff(at), pa.int64()), pa.array(decoded, pa.string())],
                [*names, "ids", "n_ids", "decoded"],
            )

    return source.mapInArrow(tidy(run), schema)
