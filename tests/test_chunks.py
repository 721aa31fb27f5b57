import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_spectra import CONV, centred, clips, matrices, plain, signals

from hushline.operators import chunks, spectra, subtraction
from hushline.operators.spectra import Stft
from hushline.sources import audio, wav_files

SHAPES = [CONV, Stft.reference(16, 8), Stft.log_mel(16, 8), Stft(32, 16, 5), Stft(16, 15, 15, centred=True), Stft(16, 16, 16)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def in_chunks(spark, data, size):
    """Uneven, disjoint chunk rows."""
    rows = []
    for i, (near, far) in data.items():
        for at in range(0, len(near), size):
            rows.append((i, at // size, len(near), at, [float(x) for x in near[at : at + size]], [float(x) for x in far[at : at + size]]))
    return spark.createDataFrame(rows, "clip_no long, block long, samples long, start long, near array<double>, far array<double>")


@pytest.mark.parametrize("conv", SHAPES)
@pytest.mark.parametrize("block", [1, 3, 512])
def test_frame_counts_agree_between_columns_and_tasks(spark, conv, block):
    sizes = list(range(1, 90))
    counted = spark.createDataFrame([(n,) for n in sizes], "samples long").select("samples", chunks.frame_count(F.col("samples"), conv).alias("c"))
    for n, count in counted.collect():
        lead, reach = chunks.extent(conv, block)
        seen = []
        for number in range(-(-count // block)):
            frames, starts, total = chunks._frames_of(number, n, conv, block)
            assert total == count
            low = number * block * conv.hop - lead
            assert ((starts >= low) & (starts + conv.win <= low + lead + reach)).all()
            seen += list(frames)
        assert seen == list(range(count))


@pytest.mark.parametrize("conv", SHAPES[:4])
@pytest.mark.parametrize("size", [7, 64])
def test_chunk_rows_and_long_samples_give_the_same_spectra(spark, conv, size):
    data = signals((100, 61, 16, 9, 1))
    long = spectra.explode_bins(spectra.stft(in_chunks(spark, data, size), conv, 2)).toPandas()
    for i, (near, far) in data.items():
        expected = centred if conv.centred else plain
        np.testing.assert_allclose(matrices(long, "near_re", "near_im", i), expected(near, conv), atol=1e-10)
        np.testing.assert_allclose(matrices(long, "far_re", "far_im", i), expected(far, conv), atol=1e-10)


def test_samples_move_once_and_spectra_not_at_all(spark):
    table = clips(spark, signals((100,))).withColumn("samples", F.lit(100).cast("bigint"))
    plan = plan_of(spectra.stft(table, CONV, 4, placed=False))
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(clip_no" in plan


@pytest.mark.parametrize("conv", [CONV, Stft.reference(16, 8)])
@pytest.mark.parametrize("block", [1, 4])
def test_inverse_crosses_borders_as_arrays(spark, conv, block):
    data = signals((100, 61, 9))
    table = in_chunks(spark, data, 13)
    packed = spectra.stft(table, conv, block)
    out = chunks.inverse(packed, conv, block, "near_re", "near_im", fallback=table)
    assert out.groupBy("clip_no", "block").count().where("count > 1").count() == 0
    long = chunks.samples_of(out, ["value"]).toPandas()
    for i, (near, _) in data.items():
        part = long[long["clip_no"] == i].sort_values("t")
        assert list(part["t"]) == list(range(len(near)))
        np.testing.assert_allclose(part["value"].to_numpy(), near, atol=1e-9)


def test_samples_no_window_reaches_are_null_or_fall_back(spark):
    data = signals((40,))
    table = in_chunks(spark, data, 40)
    packed = spectra.stft(table, CONV, 4)  # a symmetric window is zero at the first and the last sample
    alone = spectra.overlap_add(packed, CONV, "near_re", "near_im", block=4).orderBy("t").toPandas()
    assert alone["value"].isna().tolist() == [True] + [False] * 38 + [True]
    filled = spectra.reconstruct(packed, CONV, "near_re", "near_im", table, channel="far", block=4).orderBy("t").toPandas()
    assert filled["value"][0] == data[0][1][0] and filled["value"][39] == data[0][1][39]


def test_a_clip_without_spectra_keeps_its_own_samples(spark):
    data = signals((40, 30))
    table = in_chunks(spark, data, 11)
    packed = spectra.stft(table, CONV, 4).where("clip_no = 0")
    out = spectra.reconstruct(packed, CONV, "near_re", "near_im", table, block=4).where("clip_no = 1").orderBy("t").toPandas()
    np.testing.assert_array_equal(out["value"].to_numpy(), data[1][0])


def test_empty_tables(spark):
    table = in_chunks(spark, {0: signals((20,))[0]}, 20).where("clip_no < 0")
    packed = spectra.stft(table, CONV, 4)
    assert packed.count() == 0
    assert chunks.inverse(packed, CONV, 4, "near_re", "near_im").count() == 0


def test_spectra_straight_from_wav_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = {i: np.round(rng.uniform(-0.9, 0.9, (2, n)) * 32768) / 32768 for i, n in enumerate((300, 50, 7))}
    rows = spark.createDataFrame(
        [(f"{i}.wav", 16000, 1, 2, False, [float(x) for x in d[0]], [float(x) for x in d[1]]) for i, d in data.items()],
        "relative_path string, sample_rate int, tag int, width int, extensible boolean, near array<double>, far array<double>",
    )
    wav_files.write_wavs(rows, str(tmp_path)).collect()
    numbers = spark.createDataFrame(pd.DataFrame({"relative_path": [f"{i}.wav" for i in data], "clip_no": list(data)}))
    for conv in SHAPES[:4]:
        blocks = audio.stereo_blocks(spark, str(tmp_path), numbers, conv, 4)
        long = spectra.explode_bins(spectra.stft(blocks, conv, 4, placed=False)).toPandas()
        for i, (near, far) in data.items():
            expected = centred if conv.centred else plain
            np.testing.assert_allclose(matrices(long, "near_re", "near_im", i), expected(near, conv), atol=1e-10)
            np.testing.assert_allclose(matrices(long, "far_re", "far_im", i), expected(far, conv), atol=1e-10)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("long", [True, False])
def test_samples_that_are_not_finite_fail_the_transform(spark, bad, long):
    rows = [(0, t, 40, bad if t == 33 else 0.5, 0.25) for t in range(40)]
    table = spark.createDataFrame(rows, "clip_no long, t long, samples long, near double, far double")
    if not long:
        whole = table.groupBy("clip_no").agg(F.sort_array(F.collect_list(F.struct("t", "near", "far"))).alias("s"))
        table = whole.select("clip_no", F.lit(40).alias("samples"), F.lit(0).alias("start"), F.col("s.near").alias("near"), F.col("s.far").alias("far"))
    with pytest.raises(Exception, match="not finite in near of clip 0"):
        spectra.stft(table, CONV, 4).collect()


def test_enhanced_and_plain_spectra_meet_in_their_blocks(spark):
    """The diagnostics' three spectra come from one transform; no spectrum is shuffled for them."""
    data = {0: signals((70,))[0], 1: signals((300,))[0]}
    conv = Stft.reference(16, 8)
    table = in_chunks(spark, data, 20)
    wave = table.select("clip_no", "samples", "start", (F.transform("near", lambda x: x * 0.5)).alias("value"))
    both = subtraction.compared_spectra(table, wave, conv, 4)
    assert "Exchange" not in plan_of(both).split("MapInArrow")[0]
    long = spectra.explode_bins(both, ["near_re", "near_im", "far_re", "far_im", "enh_re", "enh_im"]).toPandas()
    for i, (near, far) in data.items():
        for name, x in (("near", near), ("far", far), ("enh", 0.5 * near)):
            np.testing.assert_allclose(matrices(long, f"{name}_re", f"{name}_im", i), centred(x, conv), atol=1e-10)
