"""Queries over WAV files that the executors write from the sample tables, in four kinds, and read back by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.scores import rounded
from hushline.catalog.spectra import FRAMES_SQL, SMALL
from hushline.catalog.views import Views
from hushline.functions.numeric import d
from hushline.operators import spectra
from hushline.session import new_folder
from hushline.sources import audio, wav_files

#: Frames of a file (a longer clip becomes several files) and of a chunk; small, so that files have several chunks.
FILE, CHUNK, HALO = 1 << 16, 100, 7

# Samples are multiples of 2 ** -15, which every kind of file holds exactly.
PARTS = f"""parts AS (SELECT c.clip_no, t // {FILE} AS part, t % {FILE} AS t, CAST(round(c.near * 100) AS BIGINT) AS near, CAST(round(c.far * 100) AS BIGINT) AS far,
      concat(machine_type, '/', CASE WHEN dataset_split = 'dev_test' THEN 'test' ELSE 'train' END, '/section_0', CAST(c.clip_no % 3 AS VARCHAR), '_', domain, '_', condition, '_',
        CAST(c.clip_no AS VARCHAR), ' ', CAST(t // {FILE} AS VARCHAR), '.wav') AS file_id, machine_type, dataset_split, domain, condition
      FROM clips c JOIN manifest m ON c.clip_no = m.clip_no)"""


def written(v: Views) -> str:
    """Folder of WAV files with the samples of the clips."""
    manifest = v.manifest.select("clip_no", "machine_type", "dataset_split", "domain", "condition")
    unit = lambda c: F.round(F.col(c) * d(100.0)) / d(32768.0)
    parts = v.clips.select("clip_no", F.floor(F.col("t") / FILE).alias("part"), (F.col("t") % FILE).alias("t"), unit("near").alias("near"), unit("far").alias("far"))
    files = parts.groupBy("clip_no", "part").agg(F.sort_array(F.collect_list(F.struct("t", "near", "far"))).alias("s"))
    kind = F.col("clip_no") % 4  # integers of 16 and 24 bits, float, and 16 bits with the extended header
    name = F.concat(
        "machine_type", F.lit("/"), F.when(F.col("dataset_split") == "dev_test", "test").otherwise("train"), F.lit("/section_0"),
        (F.col("clip_no") % 3).cast("string"), F.lit("_"), "domain", F.lit("_"), "condition", F.lit("_"),
        F.col("clip_no").cast("string"), F.lit(" "), F.col("part").cast("string"), F.lit(".wav"),
    )
    rows = files.join(manifest, "clip_no").select(
        name.alias("relative_path"), F.lit(16000).alias("sample_rate"), F.when(kind == 2, 3).otherwise(1).alias("tag"),
        F.when(kind == 1, 3).when(kind == 2, 4).otherwise(2).alias("width"), (kind == 3).alias("extensible"),
        F.col("s.near").alias("near"), F.col("s.far").alias("far"),
    )
    root = f"{new_folder(v.spark, 'wav')}/clips of one run"
    wav_files.write_wavs(rows, root).agg(F.sum("bytes")).first()
    return root


@query(
    "src2_wav_manifest",
    "manifest clips",
    f"""WITH {PARTS} SELECT file_id, machine_type, concat('section_0', CAST(any_value(clip_no) % 3 AS VARCHAR)) AS section, condition, dataset_split, domain, 16000 AS sample_rate, count(*) AS frames,
      round(count(*) / 16000e0, 6) + 0e0 AS duration_seconds, 2 AS channels,
      CASE any_value(clip_no) % 4 WHEN 1 THEN 'PCM_24' WHEN 2 THEN 'FLOAT' ELSE 'PCM_16' END AS subtype FROM parts GROUP BY file_id, machine_type, condition, dataset_split, domain""",
)
def src2(v: Views) -> DataFrame:
    manifest = audio.wav_manifest(v.spark, written(v))
    return rounded(manifest.select("file_id", "machine_type", "section", "condition", "dataset_split", "domain", "sample_rate", "frames", "duration_seconds", "channels", "subtype"))


@query(
    "src3_stereo_chunks",
    "manifest clips",
    f"""WITH {PARTS}, n AS (SELECT file_id, count(*) AS frames FROM parts GROUP BY file_id),
    held AS (SELECT file_id, k AS chunk, t - k * {CHUNK} AS place, near, far FROM parts, (VALUES (0), (1)) b(back), LATERAL (SELECT t // {CHUNK} - back AS k) WHERE k >= 0 AND t - k * {CHUNK} < {CHUNK} + {HALO})
    SELECT file_id AS relative_path, chunk, any_value(frames) AS frames, count(*) AS held, CAST(sum(near * (place + 1)) AS BIGINT) AS near_sum, CAST(sum(far * (place + 1)) AS BIGINT) AS far_sum
    FROM held JOIN n USING (file_id) GROUP BY file_id, chunk""",
)
def src3(v: Views) -> DataFrame:
    """Every chunk with its halo, by place-weighted sums of the samples, which are whole numbers again."""
    chunks = audio.stereo_chunks(v.spark, written(v), CHUNK, HALO)

    def weighted(name: str):
        terms = F.transform(name, lambda x, i: F.round(x * d(32768.0)).cast("bigint") * (i + 1))
        return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, x: s + x).alias(f"{name}_sum")

    return chunks.select("relative_path", "chunk", "frames", F.size("near").cast("bigint").alias("held"), weighted("near"), weighted("far"))


WAVS = f"""{PARTS}, wavs AS (SELECT clip_no * 1000000 + part AS clip_no, t, count(*) OVER (PARTITION BY clip_no, part) AS samples, near / 32768e0 AS near, far / 32768e0 AS far FROM parts)"""


@query(
    "t01_wav_stft",
    "manifest clips",
    f"""WITH {WAVS}, {FRAMES_SQL.replace('clips', 'wavs')} SELECT clip_no, frame, bin, round(nr, 6) + 0e0 AS near_re, round(ni, 6) + 0e0 AS near_im, round(fr, 6) + 0e0 AS far_re, round(fi, 6) + 0e0 AS far_im FROM sp""",
)
def t01_wav(v: Views) -> DataFrame:
    """Spectra straight from WAV files: byte ranges with a halo, framed and transformed where they are read."""
    root = written(v)
    named = audio.wav_manifest(v.spark, root).select("file_id")
    number = lambda at: F.regexp_extract("file_id", r"_(\d+) (\d+)\.wav$", at).cast("bigint")
    clips = named.select(F.col("file_id").alias("relative_path"), (number(1) * 1000000 + number(2)).alias("clip_no"))
    packed = spectra.stft(audio.stereo_blocks(v.spark, root, clips, SMALL, 4), SMALL, 4, placed=False)
    return rounded(spectra.explode_bins(packed).drop("block", "samples", "frames"))
