"""SimHash near-duplicates by tiled exact comparison.

Fingerprints.  A-Z is lower-cased, words are runs of bytes that are not ASCII white space, a shingle is three words joined by
one space (a shorter text is one shingle).  Each shingle is hashed with XXH64 (seed 42); a bit of the fingerprint is set
if it is set in more than half of the shingle hashes, repeats included.  A text without words has fingerprint zero.

Links.  Fingerprints that differ in ``radius`` bits or fewer are linked.  Equal fingerprints are one row before anything
is compared.  The 64 bits are cut into ``radius + k`` parts: linked fingerprints agree on at least ``k`` parts, so comparing
within every choice of ``k`` agreeing parts finds every link.  ``k`` follows from the number of fingerprints, so that the
groups of the comparison stay small; it changes the work, never the result.  Within a task the rows are sorted by key and
population count and cut into tiles; tile pairs are compared by exclusive-or and bit counts, unless their keys do not meet
or their population counts differ beyond the radius.  A group that is larger than ``HOT_ROWS`` is cut into blocks
by population count and its block pairs become tasks of their own, again skipping those beyond the radius.

Only the links that connect a comparison's rows for the first time leave a task (a forest, at most one row per fingerprint
and group), and components are found by repeated minimum labels over these links, stored between the rounds.

Defined cases: null and empty texts have no words, hence fingerprint zero, and are linked like any other; rows that repeat
a doc_id are one node per fingerprint and share its component; null doc_ids are never the smallest, a component of
null ids has a null component_id; empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import keyed, slices, tidy, utf8
from hushline.session import stored

RADIUS = 3
SEED = 42
SHINGLE = 3
TILE = 256
HOT_ROWS = 16_384

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, seed)]
    ends, at = [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *[e + 1 for e in ends]]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    return majorities([shingle_hashes(t) for t in texts])


def majorities(hashes: list) -> np.ndarray:
    """A fingerprint of each list of hashes: the bits set in more than half of them."""
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.concatenate([np.asarray(hashes[i], np.uint64) for i in full])
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    majority = (2 * ones > counts[full, None]).astype(np.uint8)
    out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (64 bits as a signed long) of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            found = fingerprints(part.column("_text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", utf8("text").alias("_text")).mapInArrow(tidy(run), schema)


def choices(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each choice of agreeing parts: its (shift, width) pieces.

    One part more than the radius serves tens of millions of fingerprints; each further part lengthens the key.
    """
    parts = radius + 1
    while parts < radius + 4 and n > 2 ** (26 + 10 * (parts - radius - 1)):
        parts += 1
    edges = [64 * i // parts for i in range(parts + 1)]
    pieces = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(c) for c in combinations(pieces, parts - radius)]


def key_of(pieces: list[tuple[int, int]]):
    bits = F.lit(0).cast("long")
    for shift, width in pieces:
        piece = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        bits = F.shiftleft(bits, width).bitwiseOR(piece)
    return bits


class Forest:
    """Union by smallest index over the rows of one comparison."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def compare_tiles(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, radius: int, tile: int = TILE) -> list[tuple[int, int]]:
    """Links (row numbers) between rows of the same key; ``keys`` is sorted and, within a key, the population counts are.

    ``sides`` 0 compares a row with all of its key; rows of sides 1 and 2 meet the other side only.
    """
    pops = np.bitwise_count(fps).astype(np.int16)
    forest = Forest(len(fps))
    starts = range(0, len(fps), tile)
    for a in starts:
        last = min(a + tile, len(fps)) - 1
        for b in range(a, len(fps), tile):
            end = min(b + tile, len(fps)) - 1
            if keys[b] != keys[last] and b > a:
                break
            if b > a and keys[b] == keys[end] == keys[a] == keys[last] and pops[b] - pops[last] > radius:
                break  # population counts ascend within a key
            x, y = fps[a : last + 1], fps[b : end + 1]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            near &= keys[a : last + 1, None] == keys[None, b : end + 1]
            near &= (sides[a : last + 1, None] == 0) | (sides[a : last + 1, None] != sides[None, b : end + 1])
            if a == b:
                near = np.triu(near, 1)
            for i, j in zip(*(v.tolist() for v in np.nonzero(near))):
                forest.join(a + i, b + j)
    return forest.links


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; whole groups are compared as soon as the next one begins."""
        kept: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "fp", "side")]))
            size += batch.num_rows
            if size < 32_768:
                continue
            rows = np.concatenate(kept, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if cut:
                yield _links(rows[:, :cut], radius)
            kept, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield _links(np.concatenate(kept, axis=1), radius)

    return run


def _links(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    groups, fps = rows[0], rows[1].view(np.uint64)
    found = np.array(compare_tiles(groups, fps, rows[2], radius), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows[1][found[:, 0]]), pa.array(rows[1][found[:, 1]])], ["a", "b"])


def links(prints: DataFrame, n: int, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that connect all those within ``radius`` bits."""
    keyed = prints.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), key_of(p).alias("key")) for i, p in enumerate(choices(n, radius))
    ])).alias("_k")).select("fp", "pop", F.col("_k.c").alias("c"), F.col("_k.key").alias("key"))
    by_pop = keyed.groupBy("c", "key", "pop").agg(F.count("*").alias("_n"))
    totals = by_pop.groupBy("c", "key").agg(F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("pop", "_n"))).alias("_pops"))
    hot = totals.where(F.col("_n") > hot_rows)
    # A hot group becomes blocks of (population count, share of fingerprints); a block meets the blocks whose population
    # counts are within the radius, itself included.  The block number is numeric and starts with the population count.
    shares = lambda pop: F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_element_at("_pops", pop), F.lit(0)) / (hot_rows // 4))).cast("int")
    # Stored, so that adaptive execution broadcasts the few hot groups or splits their rows, by measured size.
    joined = keyed.join(stored(hot.drop("_n"), "hot"), ["c", "key"], "left")
    cold = joined.where(F.col("_pops").isNull()).select(
        F.xxhash64("c", "key").alias("group"), "pop", "fp", F.lit(0).cast("long").alias("side")
    )
    mine = joined.where(F.col("_pops").isNotNull()).withColumn(
        "_block", F.col("pop") * 1_000_000 + F.pmod(F.xxhash64("fp"), shares(F.col("pop"))).cast("int")
    )
    others = F.flatten(F.transform(
        F.filter(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda p: F.map_contains_key("_pops", p)),
        lambda p: F.transform(F.sequence(F.lit(0), shares(p) - 1), lambda s: p * 1_000_000 + s),
    ))
    blocks = mine.withColumn("_other", F.explode(others)).select(
        F.xxhash64("c", "key", F.least("_block", "_other"), F.greatest("_block", "_other")).alias("group"), "pop", "fp",
        F.when(F.col("_block") == F.col("_other"), 0).when(F.col("_block") < F.col("_other"), 1).otherwise(2).cast("long").alias("side"),
    )
    placed = cold.unionByName(blocks).repartition("group").sortWithinPartitions("group", "pop")
    return placed.select("group", "fp", "side").mapInArrow(tidy(_compare(radius)), LINK)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label each node (columns ``fp``, ``label``) with the smallest label of its connected component.

    Nodes without a link are left out.  Each round stores its labels; a round takes the least label of the neighbours and
    then that of the node the label came from, so a chain of n links takes about log n rounds.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "links")
    linked = both.select(F.col("a").alias("fp")).distinct()
    labels = stored(linked.join(nodes, "fp").select("fp", F.col("fp").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["fp"]).groupBy("a").agg(F.min("root").alias("_near"))
        least = labels.join(near, labels["fp"] == near["a"]).select("fp", F.least("root", "_near").alias("root"), F.col("root").alias("_old"))
        # Hook the old root, too, under the least label any of its members has seen, then jump to the label's own label.
        hooks = least.groupBy(F.col("_old").alias("_r")).agg(F.min("root").alias("_hook"))
        hooked = stored(
            least.join(hooks, F.col("_old") == F.col("_r")).select("fp", F.least("root", "_hook").alias("root"), "_old"), "labels"
        )
        up = hooked.select(F.col("fp").alias("_f"), F.col("root").alias("_up"))
        jumped = stored(
            hooked.join(up, F.col("root") == F.col("_f")).select("fp", F.least("root", "_up").alias("root"), "_old"), "labels"
        )
        changed = jumped.where("root <> _old").limit(1).count()
        labels = jumped.select("fp", "root")
        if not changed:
            break
    named = labels.join(nodes, "fp")
    best = named.groupBy("root").agg(F.min("label").alias("_least"))
    return named.join(best, "root").select("fp", F.col("_least").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, ``fp`` and component_id (the smallest doc_id that links reach) of each row of ``docs``."""
    prints = stored(with_fingerprints(docs), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("label")), "nodes")
    edges = links(nodes.select("fp"), nodes.count(), radius)
    found = components(nodes, edges).withColumnRenamed("label", "_component")
    resolved = nodes.join(found, "fp", "left").select("fp", F.coalesce("_component", "label").alias("component_id"))
    resolved = stored(resolved, "resolved")  # a hot fingerprint's rows can then be split in the join
    return prints.join(resolved, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of rows: that of the smallest doc_id, null ids being last."""
    rows = keyed(docs)
    found = near_duplicates(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), radius)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return rows.join(kept, "_key", "left_semi").select("_row.*")
