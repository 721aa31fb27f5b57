"""WAV directories as Spark tables: a manifest from file headers, whole stereo clips, and chunks read by byte range.

Headers and chunks are read by range: a manifest touches some hundred bytes of a file, and a long recording is decoded by
as many tasks as it has chunks.  Understood are RIFF and RF64 files with integer or float samples, plain or extensible,
whatever other chunks stand before the samples.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.functions import paths
from hushline.operators import chunks
from hushline.operators.spectra import BLOCK, Stft
from hushline.schemas import MANIFEST, ContractError

# Fixed values: (format tag, bytes a sample) -> subtype name; full-scale divisors of integer samples.
SUBTYPES = {
    (1, 1): "PCM_U8", (1, 2): "PCM_16", (1, 3): "PCM_24", (1, 4): "PCM_32",
    (3, 4): "FLOAT", (3, 8): "DOUBLE",
}
FULL_SCALE = {1: 128.0, 2: 32768.0, 3: 8388608.0, 4: 2147483648.0}
# Fixed values of the format: the tag whose real tag stands in the extension, and the size that RF64 keeps elsewhere.
EXTENSIBLE = 0xFFFE
ELSEWHERE = 0xFFFFFFFF

_LAYOUT = "sample_rate int, frames bigint, duration_seconds double, channels int, subtype string"
_HEADER = f"path string, {_LAYOUT}, offset bigint, tag int, width int"
_CLIP = "path string, sample_rate int, near array<double>, far array<double>"
_CHUNK = "path string, chunk bigint, start bigint, frames bigint, sample_rate int, near array<double>, far array<double>"


class Header(NamedTuple):
    rate: int
    channels: int
    tag: int
    width: int
    offset: int
    frames: int


def _files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.wav")
        .load(root)
    )


def located(path: str) -> tuple[str, str]:
    """(root of the file system, path below it) of a path as Spark lists it: unescaped, with any Hadoop scheme."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return "", path
    if scheme == "file":
        return "", "/" + rest.lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/")
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}", inner


@lru_cache(maxsize=16)
def _system(root: str):
    from pyarrow import fs

    if not root:
        return fs.LocalFileSystem(), ""
    system, base = fs.FileSystem.from_uri(f"{root}/")
    return system, base.rstrip("/") + "/"


def _open(path: str):
    """Random-access handle through the file system the path names (local, HDFS, object store)."""
    root, inner = located(path)
    system, base = _system(root)
    return system.open_input_file(base + inner)


def read_header(handle: BinaryIO, label: str) -> Header:
    """Layout of a WAV file, by walking its chunks; sample data is not read.

    A data size beyond the end of the file (a recording cut off, or a size never filled in) counts what is there.
    """
    handle.seek(0, 2)
    end = handle.tell()
    handle.seek(0)
    head = handle.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ContractError(f"Not a WAV file: {label}")
    at, form, long_size = 12, None, None
    while at + 8 <= end:
        handle.seek(at)
        name, size = struct.unpack("<4sI", handle.read(8))
        at += 8
        if name == b"ds64":
            long_size = struct.unpack("<QQ", handle.read(16))[1]
        elif name == b"fmt ":
            raw = handle.read(min(size, 40))
            if len(raw) < 16:
                raise ContractError(f"Cut-off format in {label}")
            tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", raw[:16])
            if tag == EXTENSIBLE and len(raw) >= 26:
                tag = struct.unpack("<H", raw[24:26])[0]
            if (tag, bits // 8) not in SUBTYPES or not channels or align != channels * (bits // 8):
                raise ContractError(f"Samples of an unknown kind in {label}: format {tag}, {bits} bits, {channels} channels")
            form = (rate, channels, tag, bits // 8)
        elif name == b"data":
            if form is None:
                raise ContractError(f"Samples before their format in {label}")
            if size == ELSEWHERE and long_size is not None:
                size = long_size
            return Header(*form, at, min(size, end - at) // (form[1] * form[3]))
        at += size + size % 2
    raise ContractError(f"No samples in {label}")


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in _HEADER.split(", ")]
    for batch in batches:
        rows = []
        for path in batch["path"]:
            with _open(path) as handle:
                h = read_header(handle, path)
            kind = SUBTYPES[h.tag, h.width]
            rows.append((path, h.rate, h.frames, h.frames / h.rate, h.channels, kind, h.offset, h.tag, h.width))
        yield pd.DataFrame(rows, columns=names)


def wav_manifest(spark: SparkSession, root: str, release: str = "dev") -> DataFrame:
    """Manifest of a recursive WAV directory.

    Only the listing and each file's header are read; sample data is never loaded for the manifest.
    """
    listed = _files(spark, root).select("path")
    if not listed.limit(1).count():
        raise ContractError(f"No WAV files found under {root}")
    headers = listed.mapInPandas(_read_headers, _HEADER)
    with_id = with_relative_path(headers, root)
    parsed = paths.with_clip_metadata(with_id.withColumn("file_id", F.col("relative_path")), "relative_path", release)
    return parsed.select(*MANIFEST.fieldNames()).orderBy("file_id")


def with_relative_path(df: DataFrame, root: str) -> DataFrame:
    """Path below ``root``, whatever scheme prefix the listing added."""
    inside = root.split(":", 1)[-1].rstrip("/")
    while inside.startswith("//"):
        inside = inside[1:]
    return df.withColumn("relative_path", F.substring_index(F.col("path"), f"{inside}/", -1))


def samples_of(raw: bytes, header: Header, label: str) -> np.ndarray:
    """frames x channels doubles, integers scaled to [-1, 1); values that are not finite are refused."""
    if header.tag == 3:
        values = np.frombuffer(raw, f"<f{header.width}").astype(np.float64)
        if not np.isfinite(values).all():
            raise ContractError(f"Samples that are not finite in {label}")
        return values.reshape(-1, header.channels)
    if header.width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = (parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8
    elif header.width == 1:
        values = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    else:
        values = np.frombuffer(raw, f"<i{header.width}")
    return values.reshape(-1, header.channels) / FULL_SCALE[header.width]


def _require_stereo(channels: int, frames: int, exact: bool, label: str) -> None:
    if channels < 2 or (exact and channels != 2):
        raise ContractError(f"Expected stereo audio in {label}, found {channels} channel(s)")
    if not frames:
        raise ContractError(f"Empty audio in {label}")


def decode(content: bytes, exact_stereo: bool, label: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(near, far, sample rate) from the bytes of a WAV file."""
    header = read_header(io.BytesIO(content), label)
    _require_stereo(header.channels, header.frames, exact_stereo, label)
    size = header.frames * header.channels * header.width
    samples = samples_of(content[header.offset : header.offset + size], header, label)
    return samples[:, 0], samples[:, 1], header.rate


def stereo_clips(spark: SparkSession, root: str, exact_stereo: bool = True) -> DataFrame:
    """(relative_path, sample_rate, near, far): one row per file.

    Keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` low for long recordings; one row is one whole file.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                near, far, rate = decode(content, exact_stereo, path)
                yield pd.DataFrame({"path": [path], "sample_rate": [rate], "near": [near], "far": [far]})

    decoded = _files(spark, root).select("path", "content").mapInPandas(read, _CLIP)
    return with_relative_path(decoded, root).drop("path")


def _ranges(plan: DataFrame, size: int, lead: int, halo: int, exact_stereo: bool, tasks: int | None) -> DataFrame:
    """The samples of every planned (path, chunk), read by byte range by whichever task the range falls to.

    ``own`` to ``own + size`` are the chunk's own frames; ``lead`` frames before and ``halo`` after them are read as well,
    as far as the file has them.
    """
    plan = plan.repartition(tasks or plan.sparkSession.sparkContext.defaultParallelism * 4, "path", "chunk")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                _require_stereo(row.channels, row.frames, exact_stereo, row.path)
                header = Header(row.sample_rate, row.channels, row.tag, row.width, row.offset, row.frames)
                step = row.channels * row.width
                start = min(max(0, row.own - lead), row.frames)
                count = max(min(row.own + size + halo, row.frames) - start, 0)
                with _open(row.path) as handle:
                    handle.seek(row.offset + start * step)
                    raw = handle.read(count * step)
                if len(raw) != count * step:
                    raise ContractError(f"{row.path} became shorter while it was read")
                both = samples_of(raw, header, row.path)
                yield pd.DataFrame(
                    {"path": [row.path], "chunk": [row.chunk], "start": [start], "frames": [row.frames],
                     "sample_rate": [row.sample_rate], "near": [both[:, 0]], "far": [both[:, 1]]}
                )

    return plan.mapInPandas(read, _CHUNK)


def stereo_chunks(
    spark: SparkSession, root: str, chunk: int = 1 << 16, halo: int = 0, exact_stereo: bool = True, tasks: int | None = None
) -> DataFrame:
    """(relative_path, chunk, start, frames, sample_rate, near, far): one row per ``chunk`` frames of a file.

    A row also holds the ``halo`` frames after its own, so frames that begin in a chunk can be cut without its neighbour.
    ``frames`` is the length of the whole file.  Only headers and the rows' byte ranges are read, each by whichever task
    the range falls to: a recording of any length is one row per chunk, never one row.
    """
    plan = _files(spark, root).select("path").mapInPandas(_read_headers, _HEADER)
    last = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("frames") - 1) / chunk))
    plan = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    plan = plan.withColumn("own", F.col("chunk") * chunk)
    return with_relative_path(_ranges(plan, chunk, 0, halo, exact_stereo, tasks), root).drop("path")


def stereo_blocks(
    spark: SparkSession, root: str, clips: DataFrame, convention: Stft, block: int = BLOCK, exact_stereo: bool = True, tasks: int | None = None
) -> DataFrame:
    """Block rows (clip_no, block, samples, at, near, far) of the files, ready for ``spectra.stft`` without moving a sample.

    ``clips`` maps relative_path to clip_no.  Each row is read by byte range together with the samples before and after
    that its frames need; files without a clip number, and numbers without a file, are left to the caller's join checks.
    """
    lead, reach = chunks.extent(convention, block)
    step = block * convention.hop
    plan = _files(spark, root).select("path").mapInPandas(_read_headers, _HEADER)
    final = F.floor((chunks.frame_count(F.col("frames"), convention) - 1) / block)
    plan = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), final))).withColumn("own", F.col("chunk") * step)
    read = with_relative_path(_ranges(plan, step, lead, reach - step, exact_stereo, tasks), root)
    rows = read.join(clips.select("relative_path", "clip_no"), "relative_path")
    return rows.select(
        "clip_no", F.col("chunk").alias("block"), F.col("frames").alias("samples"), F.array("start").alias("at"),
        F.array("near").alias("near"), F.array("far").alias("far"),
    )


def sample_rows(clips: DataFrame, manifest: DataFrame) -> DataFrame:
    """Long samples (clip_no, t, samples, near, far) of whole clips or of chunks without halo, keyed by the manifest's clip_no."""
    in_chunks = "start" in clips.columns
    start, length = (F.col("start"), F.col("frames")) if in_chunks else (F.lit(0).cast("bigint"), F.size("near").cast("bigint"))
    keyed = clips.select("relative_path", start.alias("_start"), length.alias("samples"), "near", "far").join(
        manifest.select("relative_path", "clip_no"), "relative_path"
    )
    rows = keyed.select("clip_no", "_start", "samples", F.posexplode(F.arrays_zip("near", "far")).alias("t", "_z"))
    return rows.select("clip_no", (F.col("_start") + F.col("t")).alias("t"), "samples", "_z.near", "_z.far")
