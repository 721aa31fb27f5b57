"""Token ids in files of canonical, length-limited Huffman codes.

Writing.  Texts are tokenised (ids stored once), ids are counted over all documents, the counts give code lengths by
package-merge with at most ``LIMIT`` bits, and the lengths alone give the canonical codes.  The ids are
range-partitioned and sorted by doc_id, each document is coded on its own, and runs of documents are laid into blocks.

Files.  A folder ``codes`` (Parquet: id, length) and a folder ``blocks`` (Parquet), one row per block: the part and number
that give its place in doc_id order, the ids of its part before it, its documents' ids and counts, the coded bytes, and
checkpoints: the bit offset of every ``STRIDE``-th id of each document.  A block is read without any other block.

Reading.  All checkpoints of a block are followed side by side: a table indexed by the next ``LIMIT`` bits gives the id
and its length.

Tokenising works on runs between ASCII white space: the tokenizer drops white space and looks at nothing beyond a run, so each
distinct run is encoded by the library once and its ids are reused.  A tokenizer for which that does not hold is
given whole texts (``whole=True``).

Defined cases: null and empty texts have the end id only; null doc_ids come first; rows that repeat a doc_id follow each
other in the order of their ids' bytes; an empty table gives no codes and no blocks; a vocabulary with one id in use gets a
one-bit code; other columns are left alone.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hushline.llm.common import data, offsets, slices, utf8
from hushline.session import new_folder

LIMIT = 20
STRIDE = 128
BLOCK_IDS = 1 << 19
RUNS = 400_000  # distinct runs whose ids a task remembers


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b if b not in set(others) else 256 + others.index(b)) for b in range(256)]


class Tokens:
    """Ids of texts by way of their runs between white space.

    A run of letters alone is one word for a pre-tokenizer that splits at letters, and plain punctuation after ASCII letters
    is a word of its own.  Where the tokenizer is known to be of that kind (``letters``), such words go straight to the
    library's merges, in normal form, lower case and byte letters, as its own steps would bring them there.
    """

    def __init__(self, tokenizer_json: str, end_id: int, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        bare = json.loads(tokenizer_json) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        suffix = bare["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        self.whole = whole
        self.byte_letters = _byte_letters()
        self.letters = not whole and self._splits_at_letters()
        # Runs met so far: number, and ids of run k at ids[at[k]:at[k + 1]].  Number 0 is the end of a text, 1 the empty run.
        self.known: dict[bytes, int] = {b" ": 0, b"": 1}
        self.at = np.array([0, 1, 1], np.int64)
        self.ids = np.array([end_id], np.uint32)

    def _splits_at_letters(self) -> bool:
        """Whether words get the same ids both ways, on words that tell the known kinds of tokenizers apart."""
        probe = ["Word", "straße", "ÉTÉ", "ñandú", "Größe", "слово", "漢字", "x", "thndonreor"]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        coded = [self._coded(w) for w in probe]
        if None in coded or not self.ends_word.any():
            return False
        return [e.ids for e in self.merges.encode_batch_fast(coded, add_special_tokens=False)] == whole

    def _coded(self, word: str) -> str | None:
        """A word of letters in normal form, lower case and byte letters; None if it is not of that kind."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        word = unicodedata.normalize("NFC", word)
        low = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        if not (low.isalpha() and unicodedata.is_normalized("NFC", low)):
            return None
        return "".join(map(self.byte_letters.__getitem__, low.encode()))

    def _merged(self, coded: list[str], at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of coded words one after the other, and how many each has."""
        groups = [" ".join(coded[k : k + at_once]) for k in range(0, len(coded), at_once)]
        found = self.merges.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
        counts = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        if len(counts) != len(coded):
            raise ValueError("The merges left a word without its end")
        return ids, counts

    def learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs not met before one after the other, and how many each has.

        A word is encoded once, whatever punctuation and case it comes with.
        """
        words: dict[str, int] = {}  # coded word to its number
        others: dict[bytes, int] = {b"": 0}  # punctuation and all other runs, by the tokenizer itself
        head = np.full(len(fresh), -1)
        tail = np.zeros(len(fresh), np.int64)
        for i, run in enumerate(fresh):
            if self.letters:
                front = run.rstrip(b".,!?;:")
                if front and (len(front) == len(run) or front[-1:].isalpha()):  # bytes: ASCII letters only
                    coded = self._coded(front.decode("utf-8", "replace"))
                    if coded is not None:
                        head[i] = words.setdefault(coded, len(words))
                        tail[i] = others.setdefault(run[len(front) :], len(others))
                        continue
            tail[i] = others.setdefault(run, len(others))
        ids, counts = self._merged(list(words))
        rest = [r.decode("utf-8", "replace") for r in others]
        found = [e.ids for k in range(0, len(rest), 2048) for e in self.tokenizer.encode_batch_fast(rest[k : k + 2048], add_special_tokens=False)]
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])
        at = np.concatenate([[0], np.cumsum(np.concatenate([counts, [len(f) for f in found]]))]).astype(np.int64)
        # Each run is a word (or the empty run) and what follows it.
        parts = np.stack([np.where(head < 0, len(words), head), tail + len(words)], axis=1).ravel()
        size = at[parts + 1] - at[parts]
        flat = ids[np.repeat(at[parts] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return flat, size.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and the offsets of the texts."""
        if self.whole:
            runs = texts.cast(pa.large_binary()).dictionary_encode()
            per_text = np.arange(len(texts) + 1)
        else:
            split = pc.ascii_split_whitespace(texts.cast(pa.string()))
            per_text = split.offsets.to_numpy().astype(np.int64)
            per_text = per_text - per_text[0]
            runs = split.flatten().cast(pa.binary()).dictionary_encode()
        words = runs.dictionary.to_pylist()
        known = self.known
        number = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(number < 0)
        at, ids = self.at, self.ids
        if len(fresh):
            names = [words[i] for i in fresh.tolist()]
            found, size = self.learn(names)
            number[fresh] = len(at) - 1 + np.arange(len(fresh))
            ids = np.concatenate([ids, found])
            at = np.concatenate([at, at[-1] + np.cumsum(size)])
            if len(at) <= RUNS:  # the frequent runs come early; later ones are looked up slice by slice
                known.update(zip(names, number[fresh].tolist()))
                self.at, self.ids = at, ids
        codes = np.insert(number[runs.indices.to_numpy()], per_text[1:], 0)  # number 0 ends each text
        first = at[codes]
        count = at[codes + 1] - first
        ends = np.cumsum(count)
        flat = ids[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends[per_text[1:] + np.arange(len(texts))]])


@functools.lru_cache(maxsize=1)
def tokens_of(tokenizer_json: str, end_id: int, whole: bool) -> Tokens:
    """One tokenizer, with the runs it knows, for all tasks of a worker."""
    return Tokens(tokenizer_json, end_id, whole)


def binaries(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of the items of ``flat`` between neighbouring offsets."""
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def tokenize(docs: DataFrame, tokenizer_json: str, end_id: int, vocabulary: int, whole: bool = False) -> DataFrame:
    """doc_id and ``ids``: little-endian 16- or 32-bit integers, by the size of the vocabulary, the end id included."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer_json, end_id, whole)
        for part in slices(batches, "_text", 2 << 20):
            flat, at = tokens.encode(part.column("_text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), binaries(flat.astype(kind), at)], schema.names)

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_text")).mapInArrow(run, schema)


def count_ids(tokens: DataFrame, kind: str) -> DataFrame:
    """Occurrences of each id; every task hands on one row per id it has met."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids", 1 << 20):
            found = np.bincount(data(batch.column(0)).view(kind).astype(np.int64))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema.names)

    return tokens.select("ids").mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    leaves = []  # per level: which items of the sorted list are coins
    items = coins
    for level in range(limit):
        leaf = np.ones(n, bool)
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            items = np.concatenate([coins, pairs])
            leaf = np.concatenate([leaf, np.zeros(len(pairs), bool)])
            place = np.argsort(items, kind="stable")
            items, leaf = items[place], leaf[place]
        leaves.append(leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(leaves):
        coins_taken = int(leaf[:take].sum())
        lengths[:coins_taken] += 1
        take = 2 * (take - coins_taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical codes: shorter first, equal lengths by id."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.lengths))
        self.ids, self.lengths = self.ids[order].astype(np.int64), self.lengths[order].astype(np.int64)
        steps = np.left_shift(1, LIMIT - self.lengths)
        self.words = np.right_shift(np.cumsum(steps) - steps, LIMIT - self.lengths)  # each id's code word

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        words, lengths = np.zeros(size, np.int64), np.zeros(size, np.int64)
        words[self.ids], lengths[self.ids] = self.words, self.lengths
        return words, lengths

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every value of the next ``LIMIT`` bits (length 0: no code)."""
        ids, lengths = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
        steps = np.left_shift(1, LIMIT - self.lengths)
        used = int(steps.sum())
        ids[:used], lengths[:used] = np.repeat(self.ids, steps), np.repeat(self.lengths, steps)
        return ids, lengths


def pack(words: np.ndarray, lengths: np.ndarray, first_bits: np.ndarray, size: int) -> np.ndarray:
    """Lay code words at their bit offsets into ``size`` bytes, highest bit first."""
    window = np.left_shift(words, 32 - lengths - (first_bits & 7))
    byte = first_bits >> 3
    out = np.zeros(size + 4, np.int64)
    for k in range(4):
        part = (window >> (24 - 8 * k)) & 0xFF
        out += np.bincount(byte + k, weights=part, minlength=size + 4).astype(np.int64)  # bits never overlap
    return out[:size].astype(np.uint8)


def unpack(payload: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Decode ``counts`` ids from each bit offset on; all lanes step together.  Ids come out lane by lane."""
    ids, lengths = table
    padded = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    order = np.argsort(-counts, kind="stable")  # long lanes first, so that the open lanes are a prefix
    at = starts[order].copy()
    left = counts[order]
    place = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))
        here = at[:n]
        bits = (window[here >> 3] >> (32 - LIMIT - (here & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
        out[place[:n] + step] = ids[bits]
        at[:n] += lengths[bits]
    return out


BLOCK = T.StructType(
    [
        T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("before", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_ids", T.ArrayType(T.LongType(), False)),
        T.StructField("payload", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType(), False)),
    ]
)


def coded(part: pa.RecordBatch, kind: str, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
    """doc_id, number of ids, bytes, and the bit offsets of every ``STRIDE``-th id of each document of a slice."""
    values = part.column("ids")
    at = (offsets(values) - offsets(values)[0]) // np.dtype(kind).itemsize
    ids = data(values).view(kind).astype(np.int64)
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    n_bytes = (ends[at[1:]] - ends[at[:-1]] + 7) // 8
    first_byte = np.concatenate([[0], np.cumsum(n_bytes)])
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    inside = ends[:-1] - ends[at[:-1]][doc]  # bits before an id in its document
    packed = pack(words[ids], size, 8 * first_byte[doc] + inside, int(first_byte[-1])).tobytes()
    marks = inside[(np.arange(len(ids)) - at[:-1][doc]) % STRIDE == 0]
    mark_at = np.concatenate([[0], np.cumsum(-(-n // STRIDE))])
    for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
        yield doc_id, int(n[i]), packed[first_byte[i] : first_byte[i + 1]], marks[mark_at[i] : mark_at[i + 1]]


def _blocks(code: Code, kind: str):
    def made(docs: list[tuple], part: int, block: int, before: int) -> pa.RecordBatch:
        starts = np.cumsum([0, *[len(d[2]) for d in docs]])
        marks = [d[3] + 8 * s for d, s in zip(docs, starts)]
        one = lambda v: pa.array([v], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part]), pa.array([block]), pa.array([before]), one([d[0] for d in docs]), one([d[1] for d in docs]),
                pa.array([b"".join(d[2] for d in docs)], pa.binary()), one(np.concatenate(marks)),
            ],
            BLOCK.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted documents to blocks."""
        words, lengths = code.encoder()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        size = 0
        for piece in slices(batches, "ids", 1 << 20):
            for doc in coded(piece, kind, words, lengths):
                docs.append(doc)
                size += doc[1]
                if size >= BLOCK_IDS:
                    yield made(docs, part, block, before)
                    docs, block, before, size = [], block + 1, before + size, 0
        if docs:
            yield made(docs, part, block, before)

    return run


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, whole: bool = False) -> None:
    """Tokenise ``docs`` and write the code and the blocks under ``path``."""
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    tokenize(docs, tokenizer_json, end_id, vocabulary, whole).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(folder)
    counts = count_ids(tokens, kind).orderBy("id").toArrow()  # at most one row per id of the vocabulary
    ids = counts.column("id").to_numpy()
    lengths = code_lengths(counts.column("n").to_numpy())
    codes = [(int(i), int(n)) for i, n in zip(ids, lengths)]
    spark.createDataFrame(codes, "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_blocks(Code(ids, lengths), kind), BLOCK).write.parquet(f"{path}/blocks")


READ = T.StructType(
    [
        T.StructField("part", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("before", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ]
)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 and (unless told otherwise) ``ids``, 32 bits little-endian each."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()  # at most one row per id of the vocabulary
    code = Code(codes.column("id").to_numpy(), codes.column("length").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = code.decoder()
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda n: batch.column(n)[row]
                n_ids = value("n_ids").values.to_numpy()
                n_marks = -(-n_ids // STRIDE)
                counts = np.full(int(n_marks.sum()), STRIDE)
                counts[np.cumsum(n_marks) - 1] = n_ids - (n_marks - 1) * STRIDE
                payload = np.frombuffer(value("payload").as_buffer(), np.uint8)
                flat = unpack(payload, value("marks").values.to_numpy(), counts, decoding).astype("<u4")
                at = np.concatenate([[0], np.cumsum(n_ids)])
                whole = memoryview(flat).cast("B")
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n_ids), value("part").as_py())), value("doc_ids").values,
                        pa.array(value("before").as_py() + at[:-1]),
                        binaries(flat, at) if with_ids else pa.nulls(len(n_ids), pa.binary()),
                        pa.array(crc, pa.int64()), pa.array(n_ids, pa.int64()),
                    ],
                    READ.names,
                )

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # One row per written part: the ids of all parts before it.
    parts = blocks.select("part", F.aggregate("n_ids", F.lit(0).cast("long"), lambda s, n: s + n).alias("_n"))
    parts = parts.groupBy("part").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    decoded = blocks.mapInArrow(run, READ).join(parts, "part")
    out = decoded.select("doc_id", (F.col("_earlier") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
