"""Suffix-array deduplication of byte strings of ``length`` bytes or more, across all documents.

A string of ``length`` bytes (a window) is a repeat if it also starts earlier: in a document before (in the order of
doc_id), or earlier in the same one.  Every byte that a repeat covers is removed; repeats are judged on the input.

1. *Pieces.*  A window's anchor is the least hash of its ``ANCHOR``-byte strings.  Equal windows have equal anchors, so only
   windows with the same anchor need to meet.  Neighbouring windows with one anchor form a piece, a short stretch of text;
   the pieces are a tenth of what single windows would be, and each window is in exactly one piece.
2. *Equal pieces.*  Pieces are gathered by anchor.  Of pieces that are equal as a whole only the earliest stays (first
   within a task's slice, then over all); the later ones are marked as repeats from end to end.  An anchor with a
   single distinct piece, in which it occurs once, is done.  An anchor that one slice meets in many distinct pieces is spread over many tasks.
3. *Interval expansion.*  The remaining pieces, those at the borders of repeats, get their bytes from the documents and are
   brought together by anchor.  A task lays many anchors' pieces into one text and forms its Burrows-Wheeler transform.
   Breadth-first backward extension finds the intervals of all strings by increasing length, and with them the places
   where neighbouring suffixes share exactly 0, 1, 2, ... bytes; it stops at ``length``.  Neighbours that are not parted by then
   share a window; all but the earliest in each such interval are marked.
4. *Large groups.*  Anchors with more than ``LARGE`` distinct pieces are compared window by window, as pieces of one window
   each, keyed by 128 hash bits; this way is exact, too, and no task gathers such a group.
5. *Removal.*  Marks are merged per document and the bytes outside them kept.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` have no windows and stay; repeated rows and
repeated or null doc_ids (nulls first) are ordered by their bytes and numbered before the work; equal rows follow each
other, so the later ones are repeats; empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hushline.llm.common import data, offsets, slices, utf8
from hushline.session import stored

LENGTH = 100
ANCHOR = 28
RUN = 512  # most windows of a piece
SPREAD = 64  # distinct pieces of one anchor in one slice from which it is spread
LARGE = 20_000
TEXT = 1 << 20  # bytes of one transform, unless one anchor has more

_PLAIN, _SPREAD, _MARKER, _MARK, _INNER = range(5)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], _U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Rolling:
    """Hashes of any stretch of a byte text by differences of prefix sums, modulo 2**64."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.inverse = np.ones(n + 1, _U)
        power = np.ones(n + 1, _U)
        power[1:] = _U(_BASE)
        np.cumprod(power, out=power)
        self.inverse[1:] = _U(pow(_BASE, -1, 1 << 64))
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[text] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def pieces_of(text: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor, hash, document number, start in the document and window count of every piece of a slice.

    The last array tells which pieces hold their anchor more than once, and so may repeat a window within themselves.
    """
    none = tuple(np.zeros(0, k) for k in (_U, _U, np.int64, np.int64, np.int64, bool))
    if len(text) < length:
        return none
    anchor = min(ANCHOR, length)
    rolling = Rolling(text)
    n_grams = len(text) - anchor + 1
    grams = _mixed(rolling.of(slice(0, n_grams), slice(anchor, len(text) + 1)))
    least = _least(grams, length - anchor + 1)  # one value per window
    valid = np.zeros(len(least) + 1, np.int8)  # windows that lie in one document
    long = np.diff(at) >= length
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    fresh[at[:-1][long]] = True
    cut = np.flatnonzero((fresh & valid) | np.concatenate([[False], valid[:-1] & ~valid[1:]]))
    stop = np.append(cut[1:], len(least))
    keep = valid[cut]
    start, stop = cut[keep], stop[keep]
    if not len(start):
        return none
    n_parts = -(-(stop - start) // RUN)
    if n_parts.max() > 1:
        part = np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        start, stop = np.repeat(start, n_parts) + part * RUN, np.repeat(stop, n_parts)
        stop = np.minimum(stop, start + RUN)
    n = stop - start
    own = np.searchsorted(at, start, side="right") - 1
    whole = _mixed(_mixed(rolling.of(start, stop + length - 1)) + n.astype(_U))
    reach = n + length - anchor  # anchor-length strings of a piece
    first = np.cumsum(reach) - reach
    within = np.repeat(start - first, reach) + np.arange(reach.sum())
    inner = np.add.reduceat(grams[within] == np.repeat(least[start], reach), first, dtype=np.int64) > 1
    return least[start], whole, own, start - at[own], n, inner


def _packed(start: np.ndarray, n: np.ndarray, flag: np.ndarray | int) -> np.ndarray:
    return (start << 16) | (n << 4) | flag


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "hash", "doc", "at")])
FOUND = T.StructType([T.StructField("need", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("anchor", "doc", "at")]])


def _slice_rows(text: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int) -> list[np.ndarray]:
    """Piece rows of a slice: distinct pieces, marks of later equal ones, markers of spread anchors."""
    anchor, whole, own, start, n, inner = pieces_of(text, at, length)
    doc = docs[own]
    order = np.lexsort((start, doc, whole, anchor))
    anchor, whole, doc, start, n, inner = (v[order] for v in (anchor, whole, doc, start, n, inner))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
    first = new_anchor.copy()
    first[1:] |= whole[1:] != whole[:-1]
    group = np.cumsum(new_anchor) - 1
    many = np.bincount(group, weights=first) >= SPREAD if len(group) else np.zeros(0, bool)
    flag = np.where(first, np.where(many[group], _SPREAD, np.where(inner, _INNER, _PLAIN)), _MARK)
    marked = anchor[new_anchor][many]
    lead = np.full(len(marked), np.iinfo(np.int64).min)  # markers sort before the pieces of their anchor
    return [
        np.concatenate([anchor.view(np.int64), marked.view(np.int64)]), np.concatenate([whole.view(np.int64), lead]),
        np.concatenate([doc, np.zeros(len(marked), np.int64)]), np.concatenate([_packed(start, n, flag), np.full(len(marked), _MARKER)]),
    ]


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            texts = part.column("_text")
            at = offsets(texts)
            rows = _slice_rows(data(texts), at - at[0], part.column("doc").to_numpy(), length)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], PIECE.names)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, hash, document and place to marks and to the pieces whose bytes are needed.

    Only the row before, and the one distinct piece an anchor has had so far, are carried from batch to batch.
    """
    last = (None, None)  # anchor and hash of the row before
    open_anchor, open_many, pending = None, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, whole, doc, at = (batch.column(n).to_numpy() for n in PIECE.names)
        flag = at & 15
        out = [(np.zeros(int((flag == _MARK).sum()), bool), *(v[flag == _MARK] for v in (anchor, doc, at)))]
        rest = flag != _MARK
        anchor, whole, doc, at, flag = (v[rest] for v in (anchor, whole, doc, at, flag))
        if len(anchor):
            same = np.concatenate([[(anchor[0], whole[0]) == last], (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])])
            last = (anchor[-1], whole[-1])
            later = same & (flag != _MARKER)
            out.append((np.zeros(int(later.sum()), bool), anchor[later], doc[later], at[later]))
            first = ~same & (flag != _MARKER)
            new = np.concatenate([[anchor[0] != open_anchor], anchor[1:] != anchor[:-1]])
            group = np.cumsum(new)  # 0 goes on from the batch before
            many = np.bincount(group, weights=first | (flag != _PLAIN) * 2) >= 2
            if open_anchor is not None:
                had = int(np.bincount(group, weights=first)[0]) if group[0] == 0 else 0
                many[0] = open_many or (many[0] if len(many) else False) or (pending is not None and had >= 1)
                if pending is not None and many[0] and group[0] == 0:
                    out.append((np.ones(1, bool), *(np.array([v]) for v in pending)))
                    pending = None
            wanted = first & many[group]
            out.append((np.ones(int(wanted.sum()), bool), anchor[wanted], doc[wanted], at[wanted]))
            if group[-1] != 0 or pending is None:
                tail = np.flatnonzero(first & (group == group[-1]))
                pending = None
                if not many[-1] and len(tail):
                    pending = (anchor[tail[0]], doc[tail[0]], at[tail[0]])
            open_anchor, open_many = anchor[-1], bool(many[-1])
        columns = [np.concatenate(v) for v in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], FOUND.names)


def resolve(pieces: DataFrame) -> DataFrame:
    flag = F.col("at").bitwiseAND(F.lit(15).cast("long"))
    key = F.when(flag == _SPREAD, F.xxhash64("anchor", F.pmod("hash", F.lit(SPREAD)))).when(flag == _MARK, F.xxhash64("doc")).otherwise(F.col("anchor"))
    placed = pieces.repartition(key).sortWithinPartitions("anchor", "hash", "doc", "at")
    return placed.mapInArrow(_resolve, FOUND)


CUT = T.StructType([*PIECE.fields, T.StructField("bytes", T.BinaryType())])


def _fetch(length: int):
    """Bytes of the wanted pieces of each document; pieces of large groups become single windows without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            wanted = part.column("wanted")
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets_of_list(wanted)))
            flat = wanted.flatten()
            anchor, at, large = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "at", "large"))
            base = offsets(part.column("_text"))
            text = data(part.column("_text"))
            doc = part.column("doc").to_numpy()[row]
            start, n = at >> 16, (at >> 4) & 0xFFF
            begin = base[row] - base[0] + start
            plain = ~large
            whole = text.tobytes()
            cuts = [whole[a : a + k + length - 1] for a, k in zip(begin[plain].tolist(), n[plain].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[plain]), pa.array(np.zeros(len(cuts), np.int64)), pa.array(doc[plain]), pa.array(at[plain]), pa.array(cuts, pa.binary())],
                CUT.names,
            )
            if large.any():
                k = n[large]
                inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                begin = np.repeat(begin[large], k) + inside
                rolling = Rolling(text)
                plainly = rolling.of(begin, begin + length)
                again = Rolling(text ^ 0xA5).of(begin, begin + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_mixed(plainly).view(np.int64)), pa.array(_mixed(again).view(np.int64)),
                        pa.array(np.repeat(doc[large], k)), pa.array(_packed(np.repeat(start[large], k) + inside, np.ones(len(inside), np.int64), _PLAIN)),
                        pa.nulls(len(inside), pa.binary()),
                    ],
                    CUT.names,
                )

    return run


def offsets_of_list(values: pa.ListArray) -> np.ndarray:
    at = values.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def parted(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in the order shares fewer than ``length`` bytes with the one before it.

    ``text`` ends each piece with byte 0 and has no other; ``order`` sorts the suffixes by ``length`` bytes at least.
    Intervals of the strings of each length are extended to the left by one byte, starting from the empty string.  An
    extended interval is kept only if it ends at a place that no shorter string has parted.  A string may end with
    the end mark of a piece but never go on to its left.
    """
    size = len(text)
    before = text[order - 1]  # the Burrows-Wheeler transform; order 0 wraps to the last end mark
    by_byte = np.argsort(before, kind="stable")  # place of the k-th occurrence of each byte, byte by byte
    leads_to = np.empty(size, np.int64)
    leads_to[by_byte] = np.arange(size)
    counts = np.bincount(before, minlength=256)
    begins = np.cumsum(counts) - counts
    used = np.flatnonzero(counts)
    out = np.zeros(size + 1, bool)
    out[[0, size]] = True
    low, high = np.zeros(1, np.int64), np.full(1, size, np.int64)
    for shared in range(length):
        if not len(low):
            break
        width = high - low
        found_low, found_high = [], []
        one = width == 1
        at = low[one]
        at = at[(before[at] != 0) | (shared == 0)]
        found_low.append(leads_to[at])
        found_high.append(leads_to[at] + 1)
        few = (width > 1) & (width <= 64)
        if few.any():
            w = width[few]
            owner = np.repeat(np.arange(len(w)), w)
            place = np.repeat(low[few] - np.cumsum(w) + w, w) + np.arange(w.sum())
            byte = before[place].astype(np.int64)
            to = leads_to[place]
            rank = np.argsort(owner * 256 + byte, kind="stable")
            pair, to = (owner * 256 + byte)[rank], to[rank]
            head = np.concatenate([[True], pair[1:] != pair[:-1]])
            tail = np.append(head[1:], True)
            ok = (pair[head] % 256 != 0) | (shared == 0)
            found_low.append(to[head][ok])
            found_high.append(to[tail][ok] + 1)
        many = width > 64
        if many.any():
            a, b = low[many], high[many]
            for byte in used:
                if byte == 0 and shared:
                    continue
                places = by_byte[begins[byte] : begins[byte] + counts[byte]]
                x, y = np.searchsorted(places, a), np.searchsorted(places, b)
                ok = x < y
                found_low.append(begins[byte] + x[ok])
                found_high.append(begins[byte] + y[ok])
        low, high = np.concatenate(found_low), np.concatenate(found_high)
        open_ = ~out[high]
        low, high = low[open_], high[open_]
        out[high] = True
    return out[:size]


def suffix_order(text: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes sorted by their first ``reach`` bytes at least, by prefix doubling."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    words = np.zeros(len(text), _U)
    for k in range(8):
        words = (words << _U(8)) | padded[k : k + len(text)]
    order = np.argsort(words, kind="stable")
    done = 8
    while True:
        ranked = words[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if done >= reach or rank[order[-1]] == len(text) - 1:
            return order
        after = np.zeros(len(text), np.int64)
        after[: max(0, len(text) - done)] = rank[done:] + 1
        words = rank * (len(text) + 1) + after
        order = np.argsort(words, kind="stable")
        done *= 2


def repeats_in(cuts: list[bytes], doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window of the pieces that also starts earlier among them."""
    joined = np.frombuffer(b"".join(cuts), np.uint8)
    size = np.array([len(c) for c in cuts], np.int64)
    values = np.unique(joined)
    if len(values) == 256:
        raise ValueError("Text that uses all 256 byte values is not UTF-8")
    recode = np.zeros(256, np.uint8)  # order-keeping, so that 0 is free for the end marks
    recode[values] = np.arange(1, len(values) + 1)
    first = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(cuts), np.uint8)
    owner = np.repeat(np.arange(len(cuts)), size)
    text[np.arange(len(joined)) + owner] = recode[joined]
    order = suffix_order(text, length)
    group = np.cumsum(parted(text, order, length))
    piece = np.searchsorted(first, order, side="right") - 1
    window = order - first[piece] <= size[piece] - length
    piece, group, inside = piece[window], group[window], (order - first[np.searchsorted(first, order, side="right") - 1])[window]
    start = (at[piece] >> 16) + inside
    rank = np.lexsort((start, doc[piece], group))
    later = np.concatenate([[False], group[rank][1:] == group[rank][:-1]])
    return doc[piece][rank][later], start[rank][later]


def _expand(length: int):
    def made(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept)
        doc, start = repeats_in(rows["bytes"].to_pylist(), rows["doc"].to_numpy(), rows["at"].to_numpy(), length)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
        run = np.diff(np.append(np.flatnonzero(head), len(doc)))
        n_parts = -(-run // RUN)
        part = np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        begin = np.repeat(start[head], n_parts) + part * RUN
        n = np.minimum(RUN, np.repeat(start[head] + run, n_parts) - begin)
        owner = np.repeat(doc[head], n_parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(owner), bool)), pa.array(np.zeros(len(owner), np.int64)), pa.array(owner), pa.array(_packed(begin, n, _MARK))],
            FOUND.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces arrive sorted by anchor; whole anchors are put together up to about ``TEXT`` bytes."""
        kept: list[pa.RecordBatch] = []
        size = 0
        for part in slices(batches, "bytes", TEXT // 4):
            kept.append(part)
            size += int(np.diff(offsets(part.column("bytes"))).sum())
            if size < TEXT:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            anchors = table["anchor"].to_numpy()
            edge = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if anchors[0] != anchors[-1] else 0
            if edge:
                yield made(table.slice(0, edge).to_batches())
                kept = table.slice(edge).to_batches()
                size = sum(int(np.diff(offsets(b.column("bytes"))).sum()) for b in kept)
        if kept:
            yield made(kept)

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, ``doc`` (a unique number in the order of the documents) and ``_text``."""
    rows = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_text"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not twice:
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "_text")
    ranged = rows.repartitionByRange("doc_id", "_text").sortWithinPartitions("doc_id", "_text")
    ranged = stored(ranged.select("doc_id", "_text", F.monotonically_increasing_id().alias("doc")), "numbered")
    return ranged.select("doc_id", "doc", "_text")


def marks(texts: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """Runs of windows that also start earlier: ``doc``, ``start`` and ``n`` (windows)."""
    found = stored(resolve(texts.select("doc", "_text").mapInArrow(_pieces(length), PIECE)), "pieces")
    needs = found.where("need").select("anchor", "doc", "at")
    crowded = needs.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > large).select(F.col("anchor").alias("_crowded"))
    crowded = stored(crowded, "crowded")  # few rows; the join then broadcasts them or splits hot anchors
    asked = needs.join(crowded, F.col("anchor") == F.col("_crowded"), "left").withColumn("large", F.col("_crowded").isNotNull())
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "large")).alias("wanted"))
    fetched = texts.select("doc", "_text").join(wanted.hint("shuffle_hash"), "doc").mapInArrow(_fetch(length), CUT)
    fetched = stored(fetched, "borders")
    plain = fetched.where(F.col("bytes").isNotNull()).repartition("anchor").sortWithinPartitions("anchor")
    single = resolve(fetched.where(F.col("bytes").isNull()).select(*PIECE.names)).where("not need")
    every = found.where("not need").unionByName(plain.mapInArrow(_expand(length), FOUND)).unionByName(single)
    return every.select("doc", F.shiftright("at", 16).alias("start"), F.shiftright("at", 4).bitwiseAND(F.lit(0xFFF).cast("long")).alias("n"))


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def merged_spans(start: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the windows cover."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate((start + n + length - 1)[order])
    head = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(begin) - 1)
    return list(zip(begin[head].tolist(), end[last].tolist()))


def deduplicate(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed ``spans`` and the ``kept`` bytes of each row."""
    texts = numbered(docs)
    runs = marks(texts, length, large).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = texts.join(runs.hint("shuffle_hash"), "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            out = []
            for doc_id, text, found in zip(*(part.column(n) for n in ("doc_id", "_text", "runs"))):
                text = text.as_py()
                spans: list[tuple[int, int]] = []
                if found.is_valid:
                    start, n = (found.values.field(k).to_numpy() for k in ("start", "n"))
                    spans = merged_spans(start, n, length)
                edges = [0, *[e for s in spans for e in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id.as_py(), len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            [{"start": a, "end": b} for a, b in spans], kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], OUT.names)

    return joined.select("doc_id", "_text", "runs").mapInArrow(run, OUT)
