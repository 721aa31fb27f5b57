import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushline.operators import acoustic_path, frontends, log_mel, spectra
from hushline.operators.spectra import Stft

CONV = Stft(16, 16, 8)


def signals(lengths=(100, 61, 9), seed=0, far_gain=0.4):
    rng = np.random.default_rng(seed)
    return {i: (rng.normal(size=n), far_gain * rng.normal(size=n) + 0.3) for i, n in enumerate(lengths)}


def clips(spark, data):
    frames = [pd.DataFrame({"clip_no": i, "t": np.arange(len(a)), "near": a, "far": b}) for i, (a, b) in data.items()]
    return spark.createDataFrame(pd.concat(frames)).withColumn("clip_no", F.col("clip_no").cast("bigint"))


def plain(x, conv=CONV):
    starts = [0]
    if len(x) > conv.win:
        starts = list(range(0, len(x) - conv.win + 1, conv.hop))
        if starts[-1] != len(x) - conv.win:
            starts.append(len(x) - conv.win)
    rows = np.stack([np.pad(x[s : s + conv.win], (0, max(0, conv.win - len(x[s : s + conv.win])))) for s in starts])
    return np.fft.rfft(rows * np.hanning(conv.win), n=conv.n_fft)


def centred(x, conv):
    if conv.padded and len(x) < conv.win:
        x = np.pad(x, (0, conv.win - len(x)))
    y = np.pad(x, conv.win // 2)
    if conv.padded:
        y = np.pad(y, (0, -(len(y) - conv.win) % conv.hop))
    count = (len(y) - conv.win) // conv.hop + 1
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(conv.win) / conv.win)
    rows = np.stack([y[i * conv.hop : i * conv.hop + conv.win] for i in range(count)])
    return np.fft.rfft(rows * window) / (window.sum() if conv.scaled else 1.0)


def matrices(long, re, im, clip):
    part = long[long["clip_no"] == clip].sort_values(["frame", "bin"])
    shape = (part["frame"].nunique(), part["bin"].nunique())
    return part[re].to_numpy().reshape(shape) + 1j * part[im].to_numpy().reshape(shape)


@pytest.mark.parametrize("conv", [CONV, Stft.reference(16, 8), Stft.log_mel(16, 8), Stft(32, 16, 5)])
def test_three_conventions_match_numpy_and_differ(spark, conv):
    data = signals((100, 61, 16, 9))
    long = spectra.explode_bins(spectra.stft(clips(spark, data), conv, block=4)).toPandas()
    for i, (near, far) in data.items():
        expected = centred if conv.centred else plain
        np.testing.assert_allclose(matrices(long, "near_re", "near_im", i), expected(near, conv), atol=1e-10)
        np.testing.assert_allclose(matrices(long, "far_re", "far_im", i), expected(far, conv), atol=1e-10)


@pytest.mark.parametrize("conv", [CONV, Stft.reference(16, 8)])
def test_inverse_round_trip_and_fallback(spark, conv):
    data = signals((100, 61, 40))
    table = clips(spark, data)
    packed = spectra.stft(table, conv, block=4)
    out = spectra.reconstruct(packed, conv, "near_re", "near_im", table, block=4).toPandas()
    for i, (near, _) in data.items():
        got = out[out["clip_no"] == i].sort_values("t")["value"].to_numpy()
        np.testing.assert_allclose(got, near, atol=1e-9)


def loop(near, far, alpha=0.95, step=0.05, eps=1e-8):
    x, n, f = near[0] * np.conj(far[0]), abs(near[0]) ** 2, abs(far[0]) ** 2
    w = np.zeros(near.shape[1], complex)
    coherence, error, gain = [], [], []
    for i in range(len(near)):
        if i:
            x = alpha * x + (1 - alpha) * near[i] * np.conj(far[i])
            n = alpha * n + (1 - alpha) * abs(near[i]) ** 2
            f = alpha * f + (1 - alpha) * abs(far[i]) ** 2
        coherence.append(np.clip(abs(x) ** 2 / (n * f + eps), 0, 1))
        error.append(near[i] - w * far[i])
        w = w + step * np.conj(far[i]) * error[-1] / (abs(far[i]) ** 2 + eps)
        gain.append(abs(w) ** 2)
    return np.array(coherence), np.array(error), np.array(gain)


@pytest.mark.parametrize("block", [3, 512])
def test_recurrences_do_not_depend_on_the_block(spark, block):
    data = signals((200, 61))
    settings = frontends.Settings(block=block)
    packed = spectra.stft(clips(spark, data), CONV, block)
    long = frontends.prepared(packed, ["adaptive_filter"], settings, coherence=True)
    z = frontends.adaptive_residual(settings)
    rows = long.select("clip_no", "frame", "bin", "coherence", z.re.alias("re"), z.im.alias("im"),
                       (F.col("after_re") ** 2 + F.col("after_im") ** 2).alias("gain")).toPandas()
    for i, (near, far) in data.items():
        coherence, error, gain = loop(plain(near), plain(far))
        part = rows[rows["clip_no"] == i].sort_values(["frame", "bin"])
        np.testing.assert_allclose(part["coherence"].to_numpy().reshape(coherence.shape), coherence, atol=1e-9)
        np.testing.assert_allclose(matrices(rows, "re", "im", i), error, atol=1e-9)
        np.testing.assert_allclose(part["gain"].to_numpy().reshape(gain.shape), gain, atol=1e-9)


def test_blocks_share_a_call_and_may_be_cut_by_a_batch(spark):
    """The scan is one pass over sorted rows, not a call per block; Arrow batches end where they like."""
    packed = spectra.stft(clips(spark, signals((200, 61, 9, 16))), CONV, 4)
    path = acoustic_path.path_arrays(packed, acoustic_path.PathSettings(block=4))
    plan = path._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and "ArrowEvalPython" not in plan
    rows = lambda: {(r["clip_no"], r["frame"]): [*r["transfer_re"], *r["residual_im"]] for r in path.collect()}
    whole = rows()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        path = path.select("*")
        cut = rows()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(whole) == len(cut) == 24 + 7 + 1 + 1 and whole == cut


@pytest.mark.parametrize("alpha,step", [(0.0, 1.0), (0.05, 0.9), (0.2, 1.5)])
def test_recurrences_take_every_factor_at_every_length(spark, alpha, step):
    data = signals((4500,))
    settings = frontends.Settings(coherence_alpha=alpha, adaptive_step=step, block=512)
    packed = spectra.stft(clips(spark, data), CONV, 512)
    long = frontends.prepared(packed, ["adaptive_filter"], settings, coherence=True)
    z = frontends.adaptive_residual(settings)
    rows = long.select("clip_no", "frame", "bin", "coherence", z.re.alias("re"), z.im.alias("im")).toPandas()
    (i, (near, far)), = data.items()
    coherence, error, _ = loop(plain(near), plain(far), alpha, step)
    part = rows.sort_values(["frame", "bin"])
    np.testing.assert_allclose(part["coherence"].to_numpy().reshape(coherence.shape), coherence, atol=1e-7)
    np.testing.assert_allclose(matrices(rows, "re", "im", i), error, atol=1e-7)


def test_energy_audit_sums_up_cells_not_front_ends(spark, monkeypatch):
    """A cell enters the aggregation once for all front-ends, and long clips get the same numbers another way."""
    names = ["near", "far", "wiener", "adaptive_filter", "late_score_fusion"]
    packed = spectra.stft(clips(spark, signals((200, 61))), CONV)
    audit = frontends.energy_audit(packed, names, CONV.bins)
    assert "keys=[clip_no" in (plan := audit._jdf.queryExecution().executedPlan().toString()) and "percentile(r0" in plan
    rows = lambda df: {(r["clip_no"], r["frontend"]): (r["fraction_below_0_2"], r["median_energy_ratio"]) for r in df.collect()}
    short = rows(audit)
    monkeypatch.setattr(frontends, "AUDITED", 0)
    long = rows(frontends.energy_audit(packed, names, CONV.bins))
    assert short.keys() == long.keys() and len(short) == 10
    for key, values in short.items():
        np.testing.assert_allclose(values, long[key], rtol=1e-12)


@pytest.mark.parametrize("name", ["spectral_subtraction", "wiener", "coherence_mask", "adaptive_filter", "difference"])
def test_silent_far_channel_leaves_near_unchanged(spark, name):
    data = {0: (np.random.default_rng(1).normal(size=80), np.zeros(80))}
    rows = frontends.apply(spectra.stft(clips(spark, data), CONV), name).toPandas()
    np.testing.assert_allclose(matrices(rows, "re", "im", 0), plain(data[0][0]), atol=1e-9)


@pytest.mark.parametrize("name", list(frontends.REGISTRY))
def test_views_are_finite_and_complete(spark, name):
    data = signals((70,))
    rows = frontends.apply(spectra.stft(clips(spark, data), CONV), name).toPandas()
    assert np.isfinite(rows[["re", "im", "coherence", "view_to_near_energy_ratio"]].to_numpy()).all()
    assert len(rows) == plain(data[0][0]).size * len(frontends.REGISTRY[name].views)


def test_unknown_front_end_is_rejected(spark):
    with pytest.raises(ValueError, match="Unknown front-end"):
        frontends.frontend("nope")


def test_future_frames_do_not_change_the_past(spark):
    near, far = signals((160,))[0]
    other = near.copy()
    other[96:] += 5.0
    out = []
    for x in (near, other):
        rows = acoustic_path.acoustic_path(spectra.stft(clips(spark, {0: (x, far)}), CONV, 4), acoustic_path.PathSettings(block=4))
        out.append(rows.where("frame < 10").orderBy("frame", "bin").toPandas())
    np.testing.assert_array_equal(out[0]["residual_re"], out[1]["residual_re"])
    np.testing.assert_array_equal(out[0]["path_confidence"], out[1]["path_confidence"])


@pytest.mark.parametrize("mode", ["causal_ema", "static_per_clip"])
def test_removal_is_bounded_and_bypass_returns_near(spark, mode):
    near = signals((120,))[0][0]
    packed = spectra.stft(clips(spark, {0: (near, 0.9 * near)}), CONV)
    settings = acoustic_path.PathSettings(mode=mode, max_removed_ratio=0.3, smoothing_bins=3)
    rows = acoustic_path.acoustic_path(packed, settings).toPandas()
    assert rows["removed_energy_ratio"].max() <= 0.3 + 1e-9
    assert rows["path_confidence"].between(0, 1).all()
    bypass = acoustic_path.acoustic_path(packed, acoustic_path.PathSettings(mode=mode, bypass=True)).toPandas()
    np.testing.assert_allclose(bypass["residual_re"], bypass["near_re"], atol=0)
    assert (bypass["gate"] == 0).all() and bypass["snr_proxy"].abs().max() > 0


def test_stacked_vectors_cross_block_borders(spark):
    rows = [(c, f // 4, f, [float(10 * c + f), float(-f)]) for c, n in ((0, 11), (1, 5), (2, 4)) for f in range(n)]
    df = spark.createDataFrame(rows, "clip_no long, block long, frame long, values array<double>")
    got = log_mel.stack_frames(df, "values", 5, 4).orderBy("clip_no", "vec_idx").toPandas()
    assert got.groupby("clip_no").size().to_dict() == {0: 7, 1: 1}
    assert list(got["values"][3]) == [x for f in range(3, 8) for x in (float(f), float(-f))]


def test_log_mel_vectors_match_numpy(spark):
    from hushline.functions.mel import area_normalised_filters

    near, far = signals((200,))[0]
    conv = Stft.log_mel(64, 32)
    filters = area_normalised_filters(64, 16000, 8)
    mel = 10 * np.log10(np.maximum(filters @ (np.abs(centred(near, conv)) ** 2).T, np.finfo(float).eps))
    count = mel.shape[1] - 4
    expected = np.concatenate([mel[:, i : i + count] for i in range(5)]).T
    got = log_mel.log_mel_vectors(clips(spark, {0: (near, far)}), "near", 16000, 8, conv).orderBy("vec_idx").toPandas()
    np.testing.assert_allclose(np.stack(got["values"]), expected, rtol=1e-5)
