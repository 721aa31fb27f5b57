"""N-gram Jaccard join: rare-first prefix filtering, with length, positional and suffix filters, verified once per pair.

Sets.  A-Z is lower-cased, words are runs of bytes that are not ASCII white space; a text is the set of its n-word shingles,
each known by a 64-bit hash (a text of fewer words is one shingle, a text without words the empty set).  Two sets are
linked if their Jaccard similarity reaches ``num / den``, compared in whole numbers.  Equal sets are one class (same size
and 128 hash bits) before anything is joined.

Order.  Shingles are ordered rare first.  Their frequencies are counted over all texts in a table of 2**22 cells (a cell holds
the shingles whose hash starts with its number): tasks count, chunks of the table are added up, and the result, in
two bytes a cell, is the same for every task and bounded by 8 MB at any size of the input.  Any common order makes the
prefix filter exact; the counts only decide how few sets share a shingle.

Candidates.  Sets that reach the similarity share one of the first ``n - ceil(t n) + 1`` shingles of each (n being the size, t the
similarity).  Prefix shingles are joined; of the sets that share one, a pair is a candidate if its sizes allow the
similarity (length), if enough shingles are left behind the shared one (positions), and if parity bitmaps of the sets do
not prove that they differ too much (suffix: a place where the parities differ is a shingle that one set alone has).

Known links.  Pairs that the caller names beforehand (by SimHash, for instance) are verified first.  Shingles whose sets these links
connect already are left out of all that follows, and the others compare sets of different components only.

Links.  No task hands on all pairs of a group.  First, inside each shared shingle, the sets are compared with the group's
smallest key, then the rest with the smallest of the rest and so on; a set proposes at most one partner, which is
verified on the whole sets.  Groups whose sets still lie in several components after that bring the whole sets of those
members that have a candidate in another component, and compare them in the task: a pair is verified only at the first
shingle that the two prefixes share, unless it was verified before, and only links that connect something leave the
task.  So a family of copies costs rows in proportion to its sets, whether its pairs pass or fail.

Hot shingles.  A shingle that more than ``GROUP`` sets share is cut into shares: for the proposals each set belongs to one, differently
for each shingle; for the comparison of what is left, blocks of sets meet pairwise.

Defined cases: null and empty texts have the empty set and are linked with nothing (with ``empty_alike`` they are one class);
rows are told apart by a row key, so null and repeated doc_ids lose nothing, and a component of null ids has a null
component_id; empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import keyed, slices, tidy, utf8
from hushline.llm.simhash import LINK, components, majorities
from hushline.session import stored

CELL_BITS = 22
CHUNK = 1 << 14  # cells that are added up together
WORDS = 100_000  # words whose hashes a task remembers
TEXT_BYTES = 1 << 19  # bytes of text that a task turns into shingles at a time, unless one text has more
GROUP = 1_024
SMALL = 500_000  # keys that may be broadcast

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; linked from a similarity of ``num / den`` on."""

    size: int = 3
    num: int = 9
    den: int = 10

    def prefix(self, n: int) -> int:
        """How many of n shingles are posted."""
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def overlap(self, n, m):
        """The least number of common shingles of linked sets of n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def apart(self, n, m):
        """The greatest number of shingles that only one of two linked sets has."""
        return n + m - 2 * self.overlap(n, m)


class Hashes(dict):
    """Word hashes, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int):
        self.size, self.hashes = size, Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > WORDS:
            self.hashes.clear()
        found = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = mixed(out + found[k : k + len(out)])
        return np.unique(out)


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


SET = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "n", "s1", "s2", "fp", "chunk")] + [T.StructField("cells", T.BinaryType())])


def _sets(rule: Rule, prints: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text (key, size, signature, SimHash if wanted) and, at the end, the task's counts in chunks of cells."""
        shingler, counts = Shingler(rule.size), np.zeros(1 << CELL_BITS, np.uint32)
        for part in slices(batches, "_text", TEXT_BYTES):
            found = [shingler(t) for t in part.column("_text").to_pylist()]
            cells, times = np.unique(cells_of(np.concatenate(found)), return_counts=True)
            counts[cells] += times.astype(np.uint32)
            raw = [s.tobytes() for s in found]
            sign = lambda seed: pa.array(np.array([xxhash.xxh64_intdigest(r, seed) for r in raw], np.uint64).view(np.int64))
            blank = [pa.nulls(len(raw), pa.int64()), pa.nulls(len(raw), pa.binary())]
            fp = pa.array(majorities(found).view(np.int64)) if prints else pa.nulls(len(raw), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in found], pa.int64()), sign(1), sign(2), fp, *blank], SET.names)
        for chunk in np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1)).tolist():
            cells = counts[chunk * CHUNK : (chunk + 1) * CHUNK].astype("<u4").tobytes()
            none = [pa.nulls(1, pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*none, pa.array([chunk], pa.int64()), pa.array([cells], pa.binary())], SET.names)

    return run


TOTAL = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ranks", T.BinaryType())])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal chunks, which arrive one after the other, added up and written as two-byte ranks."""
    at, total = None, np.zeros(CHUNK, np.int64)

    def done() -> pa.RecordBatch:
        # Exact up to 2**12, then in steps of a 2048th: rare shingles keep their order, whatever the input's size.
        ranks = np.where(total < 4096, total, np.minimum(65535, 4096 + 2048 * np.log2(np.maximum(total, 4096) / 4096))).astype("<u2")
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([ranks.tobytes()], pa.binary())], TOTAL.names)

    for batch in batches:
        for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist()):
            if chunk != at:
                if at is not None:
                    yield done()
                at, total = chunk, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(cells, "<u4")
    if at is not None:
        yield done()


def rank_table(sets: DataFrame) -> np.ndarray:
    """The rank of each cell's frequency: 2**22 numbers of two bytes."""
    counted = sets.where("chunk is not null").select("chunk", "cells").repartition("chunk").sortWithinPartitions("chunk")
    found = counted.mapInArrow(tidy(_added), TOTAL).toArrow()  # at most 2**22 / 2**14 rows of 32 KB
    ranks = np.zeros(1 << CELL_BITS, np.uint16)
    for chunk, values in zip(found.column("chunk").to_pylist(), found.column("ranks").to_pylist()):
        ranks[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(values, "<u2")
    return ranks


def parity(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits, in a power of two of at least one place a shingle."""
    width = 1 << max(6, (len(shingles) - 1).bit_length())
    places = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((places & 1).astype(np.uint8), bitorder="little").tobytes()


PREFIX = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType(), False)), T.StructField("bits", T.BinaryType())]
)
WHOLE = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _prefixes(rule: Rule, ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule.size)
        for part in slices(batches, "_text", TEXT_BYTES):
            found = [shingler(t) for t in part.column("_text").to_pylist()]
            first = [s[np.lexsort((s, ranks[cells_of(s)]))[: rule.prefix(len(s))]].view(np.int64) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"), pa.array([len(s) for s in found], pa.int64()), pa.array(first, pa.list_(pa.int64())),
                    pa.array([parity(s) for s in found], pa.binary()),
                ],
                PREFIX.names,
            )

    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for part in slices(batches, "_text", TEXT_BYTES):
            found = [shingler(t).tobytes() for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.binary())], WHOLE.names)

    return run


class Bitmaps:
    """Parity bitmaps of several sets, by width; a wider one is folded to half its width for a narrower partner."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([8 * len(r) for r in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == width)
            self.place[rows] = np.arange(len(rows))
            self.of[width] = np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), width // 64)

    def rows(self, which: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(which), width // 64), np.uint64)
        have = self.width[which]
        for own in np.unique(have).tolist():
            mine = have == own
            found = self.of[own][self.place[which[mine]]]
            while found.shape[1] * 64 > width:
                half = found.shape[1] // 2
                found = found[:, :half] ^ found[:, half:]
            out[mine] = found
        return out

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A lower bound of the number of shingles that only one of the two sets has."""
        out = np.zeros(len(x), np.int64)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            for part in np.array_split(mine, 1 + len(mine) * w // (1 << 26)):
                out[part] = np.bitwise_count(self.rows(x[part], w) ^ self.rows(y[part], w)).sum(axis=1, dtype=np.int64)
        return out


@dataclass
class Members:
    """Posted sets of some groups, sorted by group: keys, sizes, positions of the shared shingle, components and bitmaps."""

    group: np.ndarray
    key: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    side: np.ndarray
    label: np.ndarray
    bits: Bitmaps

    def may_link(self, rule: Rule, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """False only for pairs that cannot be linked, or that meet elsewhere first."""
        n, m = self.n[x], self.n[y]
        ok = rule.den * np.minimum(n, m) >= rule.num * np.maximum(n, m)
        ok &= 1 + np.minimum(n - self.pos[x], m - self.pos[y]) - 1 >= rule.overlap(n, m)
        ok &= (self.side[x] == 0) | (self.side[x] != self.side[y])
        at = np.flatnonzero(ok)
        ok[at] = self.bits.distance(x[at], y[at]) <= rule.apart(n[at], m[at])
        return ok


POSTED = ("group", "key", "n", "pos", "side", "label", "bits")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int = 16_384) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by group, several at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch.select(names))
        count += batch.num_rows
        if count < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = table.column("group").to_numpy()
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0  # the last group may go on
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def members(table: pa.Table) -> Members:
    columns = {c: table.column(c).to_numpy() for c in POSTED[:-1]}
    return Members(**columns, bits=Bitmaps(table.column("bits").to_pylist()))


def proposals(rows: Members, rule: Rule) -> np.ndarray:
    """For each set a candidate of its group and of another component with a smaller key, or -1."""
    partner = np.full(len(rows.key), -1, np.int64)
    _, code = np.unique(rows.group, return_inverse=True)
    left = np.lexsort((rows.key, code))
    while len(left):
        first = np.concatenate([[True], code[left][1:] != code[left][:-1]])
        hub = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        near = rows.may_link(rule, hub, left) & (rows.label[hub] != rows.label[left])
        partner[left[near]] = hub[near]
        left = left[~near & ~first]
    return partner


PROPOSED = T.StructType([T.StructField(n, T.LongType()) for n in ("h", "a", "b")])


def _propose(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, (*POSTED, "h")):
            rows = members(table)
            partner = proposals(rows, rule)
            b = np.flatnonzero(partner >= 0)
            columns = table.column("h").to_numpy()[b], rows.key[partner[b]], rows.key[b]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], PROPOSED.names)

    return run


ASKED = T.StructType([T.StructField(n, T.LongType()) for n in ("group", "key", "n", "pos", "side", "label")])


def _ask(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a group that have a candidate of another component in it."""
        for table in _groups(batches, POSTED):
            rows = members(table)
            asked = np.zeros(len(rows.key), bool)
            edges = np.flatnonzero(np.concatenate([[True], rows.group[1:] != rows.group[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for i in range(a, b - 1):
                    rest = np.arange(i + 1, b)
                    rest = rest[(rows.label[rest] != rows.label[i]) & ~(asked[i] & asked[rest])]
                    near = rest[rows.may_link(rule, np.full(len(rest), i), rest)] if len(rest) else rest
                    asked[near] = True
                    asked[i] |= len(near) > 0
            yield pa.RecordBatch.from_arrays([pa.array(getattr(rows, c)[asked]) for c in ASKED.names], ASKED.names)

    return run


def common(flat: np.ndarray, at: np.ndarray, own: np.ndarray, places: int) -> np.ndarray:
    """How many of the numbers ``own`` (each below ``places``) each stretch of ``flat`` has."""
    mark = np.zeros(places, np.int64)
    mark[own] = 1
    running = np.concatenate([[0], np.cumsum(mark[flat])])
    return running[at[1:]] - running[at[:-1]]


def numbered(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Arrays as one array of small numbers, equal ones for equal values, with offsets."""
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    values, flat = np.unique(np.concatenate(arrays) if len(arrays) else np.zeros(0, np.uint64), return_inverse=True)
    return flat.astype(np.int64), at, len(values)


def _verify(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between components, by the whole sets, that connect something new."""
        for table in _groups(batches, ("group", "key", "n", "pos", "side", "label", "tested", "prefix", "shingles"), 1_024):
            group = table.column("group").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            found: list[tuple[int, int]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a > 1:
                    found.extend(_verified(table.slice(a, b - a), rule))
            rows = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], LINK.names)

    return run


def _verified(rows: pa.Table, rule: Rule) -> Iterator[tuple[int, int]]:
    key, n, pos, side, label, tested = (rows.column(c).to_numpy() for c in ("key", "n", "pos", "side", "label", "tested"))
    flat, at, places = numbered([np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()])
    prefix = [np.array(p[:k], np.int64) for p, k in zip(rows.column("prefix").to_pylist(), pos.tolist())]
    early, early_at, early_places = numbered(prefix)
    tree = label.copy()  # components, joined as links are found
    for i in range(len(key) - 1):
        ok = (tree != tree[i]) & (np.arange(len(key)) > i) & ((side == 0) | (side != side[i]))
        ok &= rule.den * np.minimum(n, n[i]) >= rule.num * np.maximum(n, n[i])
        ok &= (tested != key[i]) & (key != tested[i])
        if not ok.any():
            continue
        # The pair belongs to the first shingle that both prefixes have.
        ok &= common(early, early_at, early[early_at[i] : early_at[i + 1]], early_places) == 0
        if not ok.any():
            continue
        ok &= common(flat, at, flat[at[i] : at[i + 1]], places) >= rule.overlap(n, n[i])
        for j in np.flatnonzero(ok).tolist():
            if tree[j] != tree[i]:
                yield min(key[i], key[j]), max(key[i], key[j])
                tree[tree == tree[j]] = tree[i]


def _confirm(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) >= rule.overlap(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def sized(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if it is small and shuffled otherwise."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def whole_sets(texts: DataFrame, keys: DataFrame, rule: Rule) -> DataFrame:
    wanted = texts.join(sized(stored(keys.distinct(), "asked")), "key", "left_semi")
    return stored(wanted.select("key", "_text").mapInArrow(tidy(_whole(rule.size)), WHOLE), "sets")


def _placed(posts: DataFrame, prefixes: DataFrame, group: Column, side: Column) -> DataFrame:
    """Posts with their bitmaps, dealt and sorted by group."""
    rows = posts.withColumn("group", group).withColumn("side", side.cast("long"))
    rows = rows.join(prefixes.select("key", "bits"), "key")
    return rows.repartition("group").sortWithinPartitions("group", "key")


def components_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return stored(components(nodes.select(F.col("key").alias("fp"), F.col("key").alias("label")), links), "components")


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""
    wanted = whole_sets(texts, pairs.select(F.col("a").alias("key")).union(pairs.select("b")), rule)
    x = wanted.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    y = wanted.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(tidy(_confirm(rule)), LINK), "links")


def labelled(posts: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``posts`` with the component of their set as ``label``."""
    labels = components_of(links, nodes).select(F.col("fp").alias("_k"), F.col("label").alias("_l"))
    found = posts.join(labels, F.col("key") == F.col("_k"), "left")
    return found.withColumn("label", F.coalesce("_l", "key")).drop("_k", "_l")


def split_groups(posts: DataFrame) -> DataFrame:
    """``posts`` (stored, with labels) of the shingles whose sets lie in several components."""
    split = posts.groupBy("h").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("h")
    return posts.join(stored(split, "split"), "h", "left_semi")


def classes(
    texts: DataFrame, rule: Rule = Rule(), group: int = GROUP, empty_alike: bool = False, near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """For each row of ``texts`` (key, ``_text``): n, the size of its set, and ``label``, the smallest key that links reach.

    ``near`` may name pairs (a, b) worth verifying first, given the different sets' keys and SimHashes (key, fp).
    """
    sets = stored(texts.select("key", "_text").mapInArrow(tidy(_sets(rule, near is not None)), SET), "sets")
    rows = sets.where("chunk is null").select("key", "n", "s1", "s2", "fp")
    grouped = rows if empty_alike else rows.where("n > 0")
    nodes = grouped.groupBy("s1", "s2", "n").agg(F.min("key").alias("key"), F.count("*").alias("_copies"), F.min("fp").alias("fp"))
    nodes = stored(nodes, "nodes")
    known = verified(stored(near(nodes.select("key", "fp")).distinct(), "pairs"), texts, rule) if near else None
    nodes = nodes.drop("fp")
    doubles = stored(grouped.join(nodes.select("key"), "key", "left_anti").select("key"), "doubles")
    prefixes = stored(texts.select("key", "_text").mapInArrow(tidy(_prefixes(rule, rank_table(sets))), PREFIX), "prefixes")
    prefixes = prefixes.where("n > 0").join(sized(doubles), "key", "left_anti")

    every = prefixes.select(F.posexplode("prefix").alias("pos", "h"), "key", "n")
    shared = stored(every.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1"), "shared")
    # Length filter: the set of the next smaller or next larger size in its share must be near enough; hot shingles go on whole.
    share = F.pmod(F.xxhash64("key", "h"), F.ceil(F.col("_n") / group).cast("int"))
    by_size = Window.partitionBy("h", "_share").orderBy("n")
    close = lambda small, large: F.coalesce(rule.den * small >= rule.num * large, F.lit(False))
    neighbours = every.join(shared, "h").withColumn("_share", share).select(
        "h", F.col("pos").cast("long").alias("pos"), "key", "n", "_n", F.lag("n").over(by_size).alias("_low"), F.lead("n").over(by_size).alias("_high")
    )
    posts = neighbours.where((F.col("_n") > group) | close(F.col("_low"), F.col("n")) | close(F.col("n"), F.col("_high")))
    posts = posts.drop("_low", "_high")
    posts = stored(labelled(posts, known, nodes) if near else posts.withColumn("label", F.col("key")), "posts")
    if near:
        posts = stored(split_groups(posts), "posts")
    posted = stored(prefixes.join(posts.select("key").distinct(), "key", "left_semi"), "posted")

    # One proposal per set, verified on the whole sets.
    dealt = _placed(posts, posted, F.xxhash64("h", share), F.lit(0))
    proposed = stored(dealt.select(*POSTED, "h").mapInArrow(tidy(_propose(rule)), PROPOSED), "proposed")
    pairs = stored(proposed.groupBy("b").agg(F.min("a").alias("a")), "pairs")
    links = verified(pairs, texts, rule)
    links = links.union(known) if near else links

    # What is left: shingles with a candidate, or with unmet shares, whose sets lie in several components.
    alive = proposed.select("h").union(shared.where(F.col("_n") > group).select("h")).distinct()
    left = posts.drop("label").join(stored(alive, "alive"), "h", "left_semi")
    left = split_groups(stored(labelled(left, links, nodes), "left"))
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("_n") / group).cast("int"))
    blocks = F.when(F.col("_n") <= group, 1).otherwise(blocks)
    met = left.withColumn("_mine", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    met = _placed(met, posted, F.xxhash64("h", F.least("_mine", "_other"), F.greatest("_mine", "_other")), side)
    asked = stored(met.select(*POSTED).mapInArrow(tidy(_ask(rule)), ASKED), "asked")
    more = whole_sets(texts, asked.select("key"), rule)
    tested = pairs.select(F.col("b").alias("key"), F.col("a").alias("tested"))
    full = asked.join(more, "key").join(posted.select("key", "prefix"), "key").join(tested, "key", "left")
    full = full.withColumn("tested", F.coalesce("tested", F.lit(-1))).repartition("group").sortWithinPartitions("group", "key")
    further = full.select("group", "key", "n", "pos", "side", "label", "tested", "prefix", "shingles").mapInArrow(tidy(_verify(rule)), LINK)
    found = components_of(links.union(stored(further, "further")), nodes)

    of_class = nodes.join(found, F.col("key") == F.col("fp"), "left").select("s1", "s2", "n", F.coalesce("label", "key").alias("label"))
    of_class = stored(of_class, "classes")  # a hot class's rows can then be split in the join
    return grouped.join(of_class, ["s1", "s2", "n"]).select("key", "n", "label").unionByName(
        rows.join(of_class, ["s1", "s2", "n"], "left_anti").select("key", "n", F.col("key").alias("label"))
    )


def similar_documents(docs: DataFrame, rule: Rule = Rule(), group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of ``docs``."""
    rows = keyed(docs.select("doc_id", "text"))
    ids = rows.select(F.col("_key").alias("key"), F.col("_row.doc_id").alias("doc_id"))
    found = classes(rows.select(F.col("_key").alias("key"), utf8("_row.text").alias("_text")), rule, group)
    labels = ids.select(F.col("key").alias("label"), F.col("doc_id").alias("component_id"))
    named = stored(found.select("label").distinct().join(labels, "label"), "named")
    return found.join(ids, "key").join(named, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
