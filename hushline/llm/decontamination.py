"""Benchmark decontamination with a distributed positional inverted index.

Index.  Documents are tokenised in blocks; each block becomes one stored segment: its terms, and for each term the sorted
token positions (a posting list).  Documents of a segment lie on one position axis with gaps between them, so that a
match never crosses documents.  A segment is bounded by bytes of text, and one document makes one segment at most, so a hot
source or term is only more segments.

Search.  The benchmark is a stated query set.  It is cut into parts of at most ``part_bytes`` and each part goes to every
segment.  Inside a segment a query phrase starts from the posting list of its rarest term (by that segment's own counts);
its positions, shifted by the term's offset, are intersected with the shifted lists of the next rarer terms until all terms
are used.  Phrases with an absent term end at once.  Phrase matches are exact.  Proximity matches need every term of
the phrase inside ``span`` consecutive positions, in any order.

Words are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased.  A window is ``window``
consecutive words of an item; a shorter, not empty item is one window.

Defined cases: null and empty texts have no words and are never contaminated; null item texts have no windows; items that
repeat an item_id count once; items without an item_id are searched like any other and count as one item together, a
null at the end of ``items`` that digests of the ids leave out; rows that repeat a doc_id are searched and returned on their own; an empty benchmark or
document table gives no matches; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import keyed, slices, tidy, utf8
from hushline.session import LARGE_ROWS, stored

WINDOW = 13
PART_BYTES = 32 << 20
SEGMENT_BYTES = 2 << 20
GAP = 64  # free positions between documents; longer than any window or span in use

#: Upper case to lower case, separators to spaces, everything else as it is.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


SEGMENT = T.StructType(
    [
        T.StructField("segment", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType(), False)),
        T.StructField("terms", T.ArrayType(T.BinaryType(), False)),
        T.StructField("counts", T.ArrayType(T.IntegerType(), False)),
        T.StructField("positions", T.BinaryType()),
    ]
)
ARROW_SEGMENT = pa.schema(
    [("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
     ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())]
)


def build_segment(doc_ids: list, texts: list[bytes]) -> dict:
    """Postings of one block: positions (int32, little-endian) by term and then by place."""
    found = [words(t) for t in texts]
    lengths = np.array([len(w) for w in found], np.int64)
    flat = [w for ws in found for w in ws]
    place = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(texts)) * GAP, lengths)
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    return {
        "doc_ids": doc_ids,
        "lengths": lengths.astype(np.int32),
        "terms": coded.dictionary,
        "counts": np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32),
        "positions": place[np.argsort(codes, kind="stable")].astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the index of ``docs`` to the shared folder: one row per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, part in enumerate(slices(batches, "_text", segment_bytes)):
            made = build_segment(part.column("doc_id").to_pylist(), part.column("_text").to_pylist())
            made["segment"] = task + n
            yield pa.RecordBatch.from_arrays([_one(made[f.name], f.type) for f in ARROW_SEGMENT], schema=ARROW_SEGMENT)

    source = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_text"))
    return stored(source.mapInArrow(tidy(run), SEGMENT), "index", LARGE_ROWS)


def _one(value: object, kind: pa.DataType) -> pa.Array:
    """An array that holds the one value."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    inner = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


@dataclass
class Phrases:
    """Query phrases of one part of the benchmark, as term numbers; ``owner`` is the number of the phrase's item."""

    items: list[str | None]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple[str | None, bytes]], window: int) -> Phrases:
        made = Phrases([name for name, _ in items])
        grouped: dict[int, dict[tuple, list[int]]] = {}
        for owner, text in enumerate(text for _, text in items):
            terms = [made.vocabulary.setdefault(w, len(made.vocabulary)) for w in words(text)]
            n = min(window, len(terms))
            for at in range(len(terms) - n + 1 if n else 0):
                grouped.setdefault(n, {}).setdefault(tuple(terms[at : at + n]), []).append(owner)
        for n, phrases in grouped.items():
            pairs = [(i, o) for i, owners in enumerate(phrases.values()) for o in set(owners)]
            made.by_length[n] = (np.array(list(phrases), np.int64), np.array(pairs, np.int64))
        return made


class Segment:
    """A segment read back, its posting lists seen through the term numbers of a query part."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, terms: list[bytes], counts: np.ndarray, positions: bytes, vocabulary: dict[bytes, int]):
        self.doc_ids = doc_ids
        self.lengths = lengths.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) + np.arange(len(lengths)) * GAP
        places = np.frombuffer(positions, "<i4").astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        numbers = np.fromiter((vocabulary.get(t, -1) for t in terms), np.int64, len(terms))
        known = np.flatnonzero(numbers >= 0)
        known = known[np.argsort(numbers[known])]
        self.axis = int(self.first[-1] + self.lengths[-1] + GAP) if len(lengths) else 1
        self.df = np.zeros(len(vocabulary), np.int64)
        self.df[numbers[known]] = counts[known]
        self.at = np.concatenate([[0], np.cumsum(self.df)])
        take = [places[starts[k] : starts[k + 1]] for k in known]
        self.lists = np.concatenate(take) if take else np.zeros(0, np.int64)
        self.keys = self.lists + np.repeat(np.arange(len(vocabulary)), self.df) * self.axis

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in the posting list of its term."""
        key = term * self.axis + place
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (place >= 0) & (place < self.axis) & (self.keys[at] == key)

    def seeds(self, phrases: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrase number, place of its rarest term, terms from rare to frequent; phrases with an absent term are left out."""
        df = self.df[phrases]
        alive = np.flatnonzero(df.min(axis=1) > 0)
        order = np.argsort(df[alive], axis=1, kind="stable")
        sizes = df[alive, order[:, 0]] if len(alive) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(alive):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + chunk, side="right")))
            part = np.repeat(np.arange(at, stop), sizes[at:stop])
            inside = np.arange(len(part)) - np.repeat(ends[at:stop] - sizes[at:stop] - before, sizes[at:stop])
            phrase = alive[part]
            rarest = phrases[phrase, order[part, 0]]
            yield phrase, self.lists[self.at[rarest] + inside], order[part]
            at = stop

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and first place of every exact match."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for phrase, place, order in self.seeds(phrases):
            start = place - order[:, 0]
            for k in range(1, phrases.shape[1]):
                ok = self.holds(phrases[phrase, order[:, k]], start + order[:, k])
                phrase, start, order = phrase[ok], start[ok], order[ok]
                if not len(phrase):
                    break
            out.append((phrase, start))
        return _joined(out)

    def near(self, phrases: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and first place of each stretch of ``span`` places with all terms of the phrase.

        Terms that a phrase repeats are needed once.  Stretches that begin with a place of a needed term are tried.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for phrase, place, order in self.seeds(phrases):
            starts, owners = [], []
            for k in range(phrases.shape[1]):  # the stretch begins at some needed term at or before the rarest one
                term = phrases[phrase, order[:, k]]
                low = np.searchsorted(self.keys, term * self.axis + np.maximum(place - span + 1, 0))
                high = np.searchsorted(self.keys, term * self.axis + place, side="right")
                n = high - low
                starts.append(self.keys[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] % self.axis)
                owners.append(np.repeat(phrase, n))
            pair = np.unique(np.stack([np.concatenate(owners), np.concatenate(starts)]), axis=1)
            phrase, start = pair[0], pair[1]
            for k in range(phrases.shape[1]):
                term = phrases[phrase, k]
                at = np.searchsorted(self.keys, term * self.axis + start)
                ok = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] < term * self.axis + start + span)
                phrase, start = phrase[ok], start[ok]
            out.append((phrase, start))
        return _joined(out)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


MATCH = T.StructType(
    [
        T.StructField("segment", T.LongType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _search(part: Phrases, span: int | None):
    """Task body: one row per document of each segment, with merged matched word ranges and the matched items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row]
                segment = Segment(
                    value("doc_ids").as_py(), value("lengths").values.to_numpy(), value("terms").as_py(),
                    value("counts").values.to_numpy(), value("positions").as_py(), part.vocabulary,
                )
                n_docs = len(segment.lengths)
                spans: list[list] = [[] for _ in range(n_docs)]
                items: list[set] = [set() for _ in range(n_docs)]
                for n, (phrases, owners) in part.by_length.items():
                    if span is None:
                        phrase, start = segment.exact(phrases)
                        length = n
                    else:
                        phrase, start = segment.near(phrases, max(n, span))
                        length = max(n, span)
                    doc = segment.document(start)
                    by_phrase = owners[np.argsort(owners[:, 0], kind="stable")] if len(owners) else owners
                    low = np.searchsorted(by_phrase[:, 0], phrase)
                    high = np.searchsorted(by_phrase[:, 0], phrase, side="right")
                    for d, s, a, b in zip(doc.tolist(), (start - segment.first[doc]).tolist(), low.tolist(), high.tolist()):
                        spans[d].append((s, min(s + length, int(segment.lengths[d]))))
                        items[d].update(by_phrase[a:b, 1].tolist())
                merged = [_merge(s) for s in spans]
                named = [sorted({part.items[i] for i in found}, key=lambda x: (x is None, x or "")) for found in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([value("segment").as_py()] * n_docs, pa.int64()),
                        pa.array(range(n_docs), pa.int32()),
                        pa.array(segment.doc_ids, pa.int64()),
                        pa.array(segment.lengths, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(named, pa.list_(pa.string())),
                    ],
                    names=MATCH.names,
                )

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def parts_of(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in parts of at most ``part_bytes`` of text (or one item), brought to the driver one by one."""
    items = benchmark.where(F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    part: list[tuple[str | None, bytes]] = []
    size = 0
    for row in items.toLocalIterator():
        if part and size + len(row["text"]) > part_bytes:
            yield part
            part, size = [], 0
        part.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
    yield part


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, matched word ranges ``spans`` and matched ``items``.

    ``span`` None asks for exact phrases, a number for proximity within so many words (at most the gap between documents).
    """
    if window > GAP or (span is not None and span > GAP):
        raise ValueError(f"Windows and spans may have {GAP} words at most")
    results = []
    for items in parts_of(benchmark, part_bytes):
        results.append(index.mapInArrow(tidy(_search(Phrases.of(items, window), span)), MATCH))
    if len(results) == 1:
        return results[0].drop("segment", "place")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    merged = found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "_spans", F.array().cast(MATCH["spans"].dataType),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans and ``contaminated`` (a twentieth of the words or more are hit)."""
    found = search(build_index(docs), benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = found.withColumn("n_hit", hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows.  Each row is judged on its own, whether or not it has a doc_id of its own."""
    rows = keyed(docs)
    found = contamination(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), benchmark, window)
    bad = found.where("contaminated").select(F.col("doc_id").alias("_key"))
    return rows.join(bad, "_key", "left_anti").select("_row.*")
