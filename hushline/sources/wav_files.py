"""WAV files written by the executors: one file per row of samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hushline.sources.audio import EXTENSIBLE, FULL_SCALE, _system, located

# Fixed value: the second part of a format identifier in the extension.
_GUID = bytes.fromhex("000000001000800000aa00389b71")


def wav_bytes(samples: np.ndarray, rate: int, tag: int = 1, width: int = 2, extensible: bool = False) -> bytes:
    """A WAV file of frames x channels samples: doubles in [-1, 1) for integers, any finite ones for float."""
    samples = np.asarray(samples, np.float64)
    if tag == 3:
        raw = samples.astype(f"<f{width}").tobytes()
    else:
        full = FULL_SCALE[width]
        values = np.clip(np.rint(samples * full), -full, full - 1).astype(np.int64)
        if width == 1:
            raw = (values + 128).astype(np.uint8).tobytes()
        else:
            raw = values.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    channels = samples.shape[1]
    step = channels * width
    form = struct.pack("<HHIIHH", EXTENSIBLE if extensible else tag, channels, rate, rate * step, step, 8 * width)
    if extensible:
        form += struct.pack("<HHIH", 22, 8 * width, 3, tag) + _GUID
    note = struct.pack("<4sI4s", b"LIST", 5, b"INFO") + b"x\0" if extensible else b""  # an odd chunk and its padding
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + note + struct.pack("<4sI", b"data", len(raw)) + raw
    return struct.pack("<4sI", b"RIFF", len(body) + len(raw) % 2) + body + b"\0" * (len(raw) % 2)


def write_wavs(clips: DataFrame, root: str) -> DataFrame:
    """Write (relative_path, sample_rate, tag, width, extensible, near, far) below ``root``; (relative_path, bytes) once read.

    A task that runs again writes the same file anew: a file is closed whole, and its bytes follow from its row.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for row in batch.itertuples(index=False):
                content = wav_bytes(np.stack([row.near, row.far], 1), row.sample_rate, row.tag, row.width, row.extensible)
                place, inner = located(f"{root.rstrip('/')}/{row.relative_path}")
                system, base = _system(place)
                system.create_dir((base + inner).rpartition("/")[0], recursive=True)
                with system.open_output_stream(base + inner) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pd.DataFrame({"relative_path": batch["relative_path"], "bytes": sizes})

    columns = ["relative_path", "sample_rate", "tag", "width", "extensible", "near", "far"]
    return clips.select(*columns).mapInPandas(write, "relative_path string, bytes bigint")
