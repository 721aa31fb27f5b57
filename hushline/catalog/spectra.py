"""Queries over clip spectra: transforms, front-ends, summaries, scores, acoustic path, mel maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.scores import roc_sql, round_all, rounded
from hushline.catalog.views import Views
from hushline.functions import complexes as c
from hushline.functions import mel
from hushline.operators import acoustic_path, frontends, guards, selection, spectra
from hushline.operators.reference_model import fit_normaliser, fit_reference, normalise
from hushline.operators.selection import tag_union
from hushline.operators.spectra import Stft
from hushline.plans import benchmark
from hushline.session import stored

SMALL = Stft(n_fft=64, win=64, hop=32)

# Starts every hop while a window fits, one more frame ending at the last sample, symmetric Hann, no scaling.
FRAMES_SQL = """geo AS (SELECT clip_no, samples, CASE WHEN samples > 64 THEN (samples - 64) // 32 ELSE 0 END AS last FROM (SELECT DISTINCT clip_no, samples FROM clips)),
starts AS (SELECT clip_no, samples, f AS frame, f * 32 AS start FROM geo, unnest(range(0, last + 1)) u(f)
  UNION ALL SELECT clip_no, samples, last + 1, samples - 64 FROM geo WHERE samples > 64 AND last * 32 <> samples - 64),
smp AS (SELECT s.clip_no, s.frame, c.t - s.start AS k, c.near * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (c.t - s.start) / 63e0)) AS near,
    c.far * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (c.t - s.start) / 63e0)) AS far
  FROM starts s JOIN clips c ON c.clip_no = s.clip_no AND c.t >= s.start AND c.t < s.start + 64),
twiddle AS (SELECT b AS bin, k, cos(2e0 * pi() * ((b * k) % 64) / 64e0) AS c, -sin(2e0 * pi() * ((b * k) % 64) / 64e0) AS s
  FROM unnest(range(0, 33)) x(b), unnest(range(0, 64)) y(k)),
sp AS MATERIALIZED (SELECT clip_no, frame, bin, sum(near * c) AS nr, sum(near * s) AS ni, sum(far * c) AS fr, sum(far * s) AS fi
  FROM smp JOIN twiddle USING (k) GROUP BY clip_no, frame, bin)"""


def small_packed(v: Views, block: int = spectra.BLOCK) -> DataFrame:
    return spectra.stft(v.clips, SMALL, block)


def trained_manifest(v: Views) -> DataFrame:
    """Clips of machines with normal training clips; the jobs refuse the others, which j08 and m01_refused report."""
    return guards.trained_only(v.manifest, guards.normal_train(v.manifest), ["machine_type"])


@query(
    "w04_framing",
    "clips",
    f"WITH {FRAMES_SQL} SELECT clip_no, frame, count(*) AS width, round(sum(near), 6) + 0e0 AS near_sum, round(sum(far), 6) + 0e0 AS far_sum FROM smp GROUP BY clip_no, frame",
)
def w04(v: Views) -> DataFrame:
    framed = spectra.frames(v.clips, SMALL)
    window = F.array(*[F.lit(float(w)) for w in SMALL.window()])
    total = lambda c: F.aggregate(F.zip_with(c, window, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return rounded(framed.select("clip_no", "frame", "width", total("near").alias("near_sum"), total("far").alias("far_sum")))


@query(
    "t01_stft",
    "clips",
    f"WITH {FRAMES_SQL} SELECT clip_no, frame, bin, round(nr, 6) + 0e0 AS near_re, round(ni, 6) + 0e0 AS near_im, round(fr, 6) + 0e0 AS far_re, round(fi, 6) + 0e0 AS far_im FROM sp",
)
def t01(v: Views) -> DataFrame:
    return rounded(spectra.explode_bins(spectra.stft(v.clips, SMALL, placed=False)).drop("block", "samples", "frames"))


# Static coherence, adaptive filter and causal averages restated over the trig-sum spectra.
STATIC_SQL = """st AS (SELECT clip_no, bin, greatest(0e0, least(1e0, (pow(avg(nr*fr + ni*fi), 2) + pow(avg(ni*fr - nr*fi), 2))
    / (avg(nr*nr + ni*ni) * avg(fr*fr + fi*fi) + 1e-8))) AS coh FROM sp GROUP BY clip_no, bin)"""
ADAPTIVE_SQL = """ad AS (SELECT clip_no, bin, frame, nr AS er, ni AS ei, 0.05e0 * (fr*nr + fi*ni) / (fr*fr + fi*fi + 1e-8) AS wr, 0.05e0 * (fr*ni - fi*nr) / (fr*fr + fi*fi + 1e-8) AS wi
    FROM sp WHERE frame = 0
  UNION ALL SELECT clip_no, bin, frame, er, ei, wr + 0.05e0 * (fr*er + fi*ei) / (fr*fr + fi*fi + 1e-8), wi + 0.05e0 * (fr*ei - fi*er) / (fr*fr + fi*fi + 1e-8)
    FROM (SELECT s.clip_no, s.bin, s.frame, s.fr, s.fi, s.nr - (ad.wr*s.fr - ad.wi*s.fi) AS er, s.ni - (ad.wr*s.fi + ad.wi*s.fr) AS ei, ad.wr, ad.wi
      FROM ad JOIN sp s ON s.clip_no = ad.clip_no AND s.bin = ad.bin AND s.frame = ad.frame + 1) q)"""
EMA_SQL = """em AS (SELECT clip_no, bin, frame, nr*fr + ni*fi AS xr, ni*fr - nr*fi AS xi, nr*nr + ni*ni AS nn, fr*fr + fi*fi AS ff FROM sp WHERE frame = 0
  UNION ALL SELECT s.clip_no, s.bin, s.frame, 0.95e0*em.xr + 0.05e0*(s.nr*s.fr + s.ni*s.fi), 0.95e0*em.xi + 0.05e0*(s.ni*s.fr - s.nr*s.fi),
    0.95e0*em.nn + 0.05e0*(s.nr*s.nr + s.ni*s.ni), 0.95e0*em.ff + 0.05e0*(s.fr*s.fr + s.fi*s.fi)
    FROM em JOIN sp s ON s.clip_no = em.clip_no AND s.bin = em.bin AND s.frame = em.frame + 1)"""
MAG = "sqrt(nr*nr + ni*ni)"
SUB_GAIN = f"greatest({MAG} - 0.5e0 * sqrt(fr*fr + fi*fi), 0e0) / greatest({MAG}, 1e-8)"
WIENER_GAIN = "CASE WHEN fr*fr + fi*fi = 0 THEN 1e0 ELSE (nr*nr + ni*ni) / (nr*nr + ni*ni + fr*fr + fi*fi + 1e-8) END"

# View name -> (re, im) for each front-end.
VIEW_SQL = {
    "near": {"near": ("nr", "ni")},
    "far": {"far": ("fr", "fi")},
    "average": {"average": ("0.5e0*(nr+fr)", "0.5e0*(ni+fi)")},
    "difference": {"difference": ("nr-fr", "ni-fi")},
    "early_concat": {"near": ("nr", "ni"), "far": ("fr", "fi")},
    "spectral_subtraction": {"residual": (f"nr*{SUB_GAIN}", f"ni*{SUB_GAIN}")},
    "wiener": {"wiener": (f"nr*({WIENER_GAIN})", f"ni*({WIENER_GAIN})")},
    "coherence_mask": {"coherence_mask": ("nr*(1e0-coh)", "ni*(1e0-coh)")},
    "adaptive_filter": {"adaptive_residual": ("er", "ei")},
    "late_score_fusion": {"near": ("nr", "ni"), "far": ("fr", "fi")},
}
SOURCE_SQL = {
    "coherence_mask": "sp JOIN st USING (clip_no, bin)",
    "adaptive_filter": "sp JOIN ad USING (clip_no, bin, frame)",
}
IDS = {
    "near": "t05", "far": "t06", "average": "t07", "difference": "t08", "early_concat": "t09", "late_score_fusion": "t10",
    "spectral_subtraction": "t11", "wiener": "t12", "coherence_mask": "t13", "adaptive_filter": "t14",
}


def frontend_sql(name: str) -> str:
    parts = [
        f"SELECT clip_no, frame, bin, '{view}' AS \"view\", {re} AS re, {im} AS im, nr, ni FROM {SOURCE_SQL.get(name, 'sp')}"
        for view, (re, im) in VIEW_SQL[name].items()
    ]
    return " UNION ALL ".join(parts)


def base_sql() -> str:
    return f"WITH RECURSIVE {FRAMES_SQL}, {STATIC_SQL}, {ADAPTIVE_SQL}"


def register_frontend(name: str) -> None:
    first = next(iter(VIEW_SQL[name].values()))
    sql = f"""{base_sql()}, vw AS ({frontend_sql(name)}),
    ra AS (SELECT clip_no, frame, bin, ln(1e0 + (pow({first[0]}, 2) + pow({first[1]}, 2)) / greatest(nr*nr + ni*ni, 1e-8)) AS log_energy_ratio FROM {SOURCE_SQL.get(name, 'sp')})
    SELECT clip_no, frame, bin, "view", round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im, round(log_energy_ratio, 6) + 0e0 AS log_energy_ratio FROM vw JOIN ra USING (clip_no, frame, bin)"""

    @query(f"{IDS[name]}_{name}", "clips", sql)
    def build(v: Views) -> DataFrame:
        rows = frontends.apply(small_packed(v), name)
        return rounded(
            rows.select("clip_no", "frame", "bin", "view", "re", "im", F.log1p("view_to_near_energy_ratio").alias("log_energy_ratio"))
        )


for _name in VIEW_SQL:
    register_frontend(_name)


@query(
    "w05_causal_coherence",
    "clips",
    f"WITH RECURSIVE {FRAMES_SQL}, {EMA_SQL} SELECT clip_no, frame, bin, round(greatest(0e0, least(1e0, (xr*xr + xi*xi) / (nn*ff + 1e-8))), 6) + 0e0 AS coherence FROM em",
)
def w05(v: Views) -> DataFrame:
    long = frontends.prepared(small_packed(v), [], coherence=True)
    return rounded(long.select("clip_no", "frame", "bin", "coherence"))


@query(
    "w06_adaptive_coefficient",
    "clips",
    f"WITH RECURSIVE {FRAMES_SQL}, {ADAPTIVE_SQL} SELECT clip_no, frame, bin, round(er, 6) + 0e0 AS error_re, round(ei, 6) + 0e0 AS error_im, round(wr*wr + wi*wi, 6) + 0e0 AS adaptive_gain FROM ad",
)
def w06(v: Views) -> DataFrame:
    rows = frontends.apply(small_packed(v), "adaptive_filter")
    return rounded(rows.select("clip_no", "frame", "bin", F.col("re").alias("error_re"), F.col("im").alias("error_im"), "adaptive_gain"))


# The same recurrences with a nearly memoryless average and a step beyond one, over clips cut into blocks of four frames.
@query(
    "w05_small_alpha",
    "clips",
    f"WITH RECURSIVE {FRAMES_SQL}, {EMA_SQL.replace('0.95e0', '0.04e0').replace('0.05e0', '0.96e0')} SELECT clip_no, frame, bin, round(greatest(0e0, least(1e0, (xr*xr + xi*xi) / (nn*ff + 1e-8))), 6) + 0e0 AS coherence FROM em",
)
def w05_small(v: Views) -> DataFrame:
    settings = frontends.Settings(coherence_alpha=0.04, block=4)
    long = frontends.prepared(small_packed(v, 4), [], settings, coherence=True)
    return rounded(long.select("clip_no", "frame", "bin", "coherence"))


@query(
    "w06_large_step",
    "clips",
    f"WITH RECURSIVE {FRAMES_SQL}, {ADAPTIVE_SQL.replace('0.05e0', '1.2e0')} SELECT clip_no, frame, bin, round(er, 6) + 0e0 AS error_re, round(ei, 6) + 0e0 AS error_im, round(wr*wr + wi*wi, 6) + 0e0 AS adaptive_gain FROM ad",
)
def w06_large(v: Views) -> DataFrame:
    rows = frontends.apply(small_packed(v, 4), "adaptive_filter", frontends.Settings(adaptive_step=1.2, block=4))
    return rounded(rows.select("clip_no", "frame", "bin", F.col("re").alias("error_re"), F.col("im").alias("error_im"), "adaptive_gain"))


# Mean and deviation of log1p magnitude for all ten front-ends.
ALL_VIEWS = " UNION ALL ".join(
    f"SELECT clip_no, bin, '{n}' AS frontend, \"view\", ln(1e0 + sqrt(re*re + im*im)) AS x FROM ({frontend_sql(n)})" for n in VIEW_SQL
)
SUMMARY_SQL = f"""{base_sql()}, av AS ({ALL_VIEWS}),
  sm AS (SELECT clip_no, bin, frontend, "view", avg(x) AS mean, stddev_pop(x) AS std FROM av GROUP BY ALL)"""


@query(
    "a01_spectral_summary",
    "clips",
    f'{SUMMARY_SQL} SELECT clip_no, bin, frontend, "view", round(mean, 6) + 0e0 AS mean, round(std, 6) + 0e0 AS std FROM sm',
)
def a01(v: Views) -> DataFrame:
    return rounded(frontends.spectral_summaries(small_packed(v), list(VIEW_SQL)))


MODEL_SQL = f"""{SUMMARY_SQL}, js AS (SELECT sm.*, file_id, machine_type, section, domain, condition, dataset_split FROM sm JOIN manifest USING (clip_no)),
  fit AS (SELECT machine_type, frontend, "view", bin, avg(mean) AS mc, greatest(stddev_pop(mean), 1e-4) AS ms, avg(std) AS sc, greatest(stddev_pop(std), 1e-4) AS ss
    FROM js WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY ALL),
  vs AS (SELECT frontend, "view", file_id, machine_type, section, domain, condition, avg((pow((mean - mc) / ms, 2) + pow((std - sc) / ss, 2)) / 2e0) AS x
    FROM js JOIN fit USING (machine_type, frontend, "view", bin) WHERE dataset_split = 'dev_test' GROUP BY ALL),
  sx AS (SELECT frontend, file_id, machine_type, section, domain, condition, avg(x) AS anomaly_score FROM vs GROUP BY ALL)"""


@query(
    "a02_reference_fit",
    "manifest clips",
    f'{MODEL_SQL} SELECT machine_type, frontend, "view", bin, round(mc, 6) + 0e0 AS mean_centre, round(ms, 6) + 0e0 AS mean_scale, round(sc, 6) + 0e0 AS std_centre, round(ss, 6) + 0e0 AS std_scale FROM fit',
)
def a02(v: Views) -> DataFrame:
    rows = frontends.spectral_summaries(small_packed(v), list(VIEW_SQL)).join(v.manifest, "clip_no")
    return rounded(fit_reference(guards.normal_train(rows, ["dev_train"]), benchmark.MODEL_KEYS, benchmark.VALUES))


@query(
    "a03_reference_score",
    "manifest clips",
    f"{MODEL_SQL} SELECT frontend, file_id, machine_type, section, domain, condition, round(anomaly_score, 4) + 0e0 AS anomaly_score FROM sx",
)
def a03(v: Views) -> DataFrame:
    # Scores reach millions where a training deviation sits at its floor: four decimals are eleven digits there.
    return rounded(benchmark.scored_summaries(frontends.spectral_summaries(small_packed(v), list(VIEW_SQL)), trained_manifest(v)), places=4)


@query(
    "m01_frontend_benchmark",
    "manifest clips",
    f"""{MODEL_SQL}, scoped AS (SELECT *, 'all' AS scope FROM sx UNION ALL SELECT *, domain AS scope FROM sx),
    {roc_sql('scoped', 'frontend, machine_type, section, scope', 'anomaly_score')},
    c AS (SELECT *, 'all' AS category FROM areas UNION ALL SELECT *, CASE WHEN machine_type LIKE '%Emu' THEN 'emulated' ELSE 'real' END FROM areas),
    r AS (SELECT frontend, category, avg(CASE WHEN scope='all' THEN auc END) AS mean_auc_all, avg(CASE WHEN scope='all' THEN pauc END) AS mean_pauc_all_max_fpr_0_1,
      avg(CASE WHEN scope='source' THEN auc END) AS mean_auc_source, avg(CASE WHEN scope='target' THEN auc END) AS mean_auc_target FROM c GROUP BY frontend, category)
    SELECT """
    + round_all("mean_auc_all mean_pauc_all_max_fpr_0_1 mean_auc_source mean_auc_target", "frontend, category")
    + " FROM r",
)
def m01(v: Views) -> DataFrame:
    packed = spectra.stft(stored(v.clips, "samples"), SMALL)
    return rounded(benchmark.benchmark(packed, trained_manifest(v), materialise=True).summary)


@query(
    "m01_refused",
    "manifest",
    """SELECT machine_type, count(*) AS clips FROM manifest WHERE dataset_split IN ('dev_test', 'eval_test') AND machine_type NOT IN
      (SELECT machine_type FROM manifest WHERE dataset_split IN ('dev_train', 'add_train') AND condition = 'normal') GROUP BY machine_type""",
)
def m01_refused(v: Views) -> DataFrame:
    """Test clips that the benchmark refuses, by machine."""
    missing = guards.untrained_groups(guards.test_rows(v.manifest), guards.normal_train(v.manifest), ["machine_type"])
    return guards.test_rows(v.manifest).join(missing, "machine_type").groupBy("machine_type").agg(F.count("*").alias("clips"))


@query(
    "a04_energy_audit",
    "clips",
    f"""{base_sql()}, """
    + "ra AS ("
    + " UNION ALL ".join(
        f"SELECT clip_no, '{n}' AS frontend, (pow({z[0]}, 2) + pow({z[1]}, 2)) / greatest(nr*nr + ni*ni, 1e-8) AS r FROM {SOURCE_SQL.get(n, 'sp')}"
        for n, z in ((n, next(iter(VIEW_SQL[n].values()))) for n in VIEW_SQL)
    )
    + """) SELECT clip_no, frontend, round(avg(CASE WHEN r < 0.2e0 THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS fraction_below_0_2, round(quantile_cont(r, 0.5), 6) + 0e0 AS median_energy_ratio
    FROM ra GROUP BY clip_no, frontend""",
)
def a04(v: Views) -> DataFrame:
    return rounded(frontends.energy_audit(small_packed(v), list(VIEW_SQL), SMALL.bins))


@query(
    "t15_energy_ratio",
    "clips",
    f"""{base_sql()} SELECT clip_no, bin, round(avg(ln(1e0 + (er*er + ei*ei) / greatest(nr*nr + ni*ni, 1e-8))), 6) + 0e0 AS mean_log_ratio
    FROM sp JOIN ad USING (clip_no, bin, frame) GROUP BY clip_no, bin""",
)
def t15(v: Views) -> DataFrame:
    rows = frontends.apply(small_packed(v), "adaptive_filter")
    return rounded(rows.groupBy("clip_no", "bin").agg(F.avg(F.log1p("view_to_near_energy_ratio")).alias("mean_log_ratio")))


@query(
    "t24_registry",
    "clips",
    f"""{base_sql()}, av AS ({ALL_VIEWS}) SELECT frontend, "view", count(*) AS cells, round(avg(x), 6) + 0e0 AS mean_log FROM av GROUP BY frontend, "view" """,
)
def t24(v: Views) -> DataFrame:
    packed = small_packed(v)
    frames = {n: frontends.apply(packed, n).select("view", F.hypot("re", "im").alias("m")) for n in frontends.REGISTRY}
    rows = tag_union(frames, "frontend")
    return rounded(rows.groupBy("frontend", "view").agg(F.count("*").alias("cells"), F.avg(F.log1p("m")).alias("mean_log")))


# ---- acoustic path -----------------------------------------------------------------------------


def smooth_sql(width: int, keys: str, source: str, names: str) -> str:
    cols = ", ".join(
        f"sum({n}) OVER (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN {width // 2} PRECEDING AND {width - width // 2 - 1} FOLLOWING) / {width}e0 AS {n}"
        for n in names.split()
    )
    return f"SELECT {keys}, bin, {cols} FROM {source}"


TRANSFER_OUT = """round(xr / (ff + 1e-5), 6) + 0e0 AS transfer_re, round(xi / (ff + 1e-5), 6) + 0e0 AS transfer_im,
  round(greatest(0e0, least(1e0, (xr*xr + xi*xi) / (nn*ff + 1e-8))), 6) + 0e0 AS coherence"""
WIDE = acoustic_path.PathSettings(smoothing_bins=3)


@query(
    "w08_bin_smoothing",
    "clips",
    f"WITH {FRAMES_SQL}, w AS ({smooth_sql(4, 'clip_no, frame', 'sp', 'nr fi')}) SELECT clip_no, frame, bin, round(nr, 6) + 0e0 AS near_re, round(fi, 6) + 0e0 AS far_im FROM w",
)
def w08(v: Views) -> DataFrame:
    smoothed = acoustic_path.smooth_bins(small_packed(v), ["near_re", "far_im"], 4)
    return rounded(spectra.explode_bins(smoothed).select("clip_no", "frame", "bin", "near_re", "far_im"))


@query(
    "t16_static_transfer",
    "clips",
    f"""WITH {FRAMES_SQL}, mn AS (SELECT clip_no, bin, avg(nr*fr + ni*fi) AS xr, avg(ni*fr - nr*fi) AS xi, avg(nr*nr + ni*ni) AS nn, avg(fr*fr + fi*fi) AS ff FROM sp GROUP BY clip_no, bin),
    w AS ({smooth_sql(3, 'clip_no', 'mn', 'xr xi nn ff')}) SELECT clip_no, bin, {TRANSFER_OUT} FROM w""",
)
def t16(v: Views) -> DataFrame:
    return rounded(acoustic_path.static_transfer(small_packed(v), WIDE).drop("last_block"))


@query(
    "t17_causal_transfer",
    "clips",
    f"WITH RECURSIVE {FRAMES_SQL}, {EMA_SQL}, w AS ({smooth_sql(3, 'clip_no, frame', 'em', 'xr xi nn ff')}) SELECT clip_no, frame, bin, {TRANSFER_OUT} FROM w",
)
def t17(v: Views) -> DataFrame:
    rows = spectra.explode_bins(acoustic_path.with_transfer(small_packed(v), WIDE), acoustic_path.TRANSFER)
    return rounded(rows.select("clip_no", "frame", "bin", "transfer_re", "transfer_im", "coherence"))


def path_sql(bypass: bool = False) -> str:
    """CTEs up to ``ap``: residual, gate, bounded removal and confidence from causal averages."""
    gate = "0e0" if bypass else "greatest(0e0, least(0.9e0, 0.9e0 / (1e0 + exp(-greatest(-40e0, least(40e0, 4e0 * (2e0*coh - 1e0) - 0.5e0 * snr))))))"
    return f"""WITH RECURSIVE {FRAMES_SQL}, {EMA_SQL},
    tr AS (SELECT sp.*, xr / (ff + 1e-5) AS hr, xi / (ff + 1e-5) AS hi, greatest(0e0, least(1e0, (xr*xr + xi*xi) / (nn*ff + 1e-8))) AS coh,
      greatest(-12e0, least(12e0, ln((nr*nr + ni*ni + 1e-8) / (fr*fr + fi*fi + 1e-8)))) AS snr FROM sp JOIN em USING (clip_no, frame, bin)),
    gt AS (SELECT *, {gate} AS gate FROM tr),
    cn AS (SELECT *, gate * (hr*fr - hi*fi) AS cr, gate * (hr*fi + hi*fr) AS ci FROM gt),
    en AS (SELECT *, sum(cr*cr + ci*ci) OVER (PARTITION BY clip_no, frame) / greatest(sum(nr*nr + ni*ni) OVER (PARTITION BY clip_no, frame), 1e-8) AS ratio FROM cn),
    sc AS (SELECT *, least(1e0, sqrt(0.8e0 / greatest(ratio, 1e-8))) AS k FROM en),
    ap AS (SELECT *, nr - k*cr AS rr, ni - k*ci AS ri, ratio*k*k AS removed, greatest(0e0, least(1e0, coh * (1e0 - greatest(0e0, least(1e0, ratio*k*k / 0.8e0))))) AS conf FROM sc)"""


PATH_OUT = """round(rr, 6) + 0e0 AS residual_re, round(ri, 6) + 0e0 AS residual_im, round(gate, 6) + 0e0 AS gate, round(snr, 6) + 0e0 AS snr_proxy,
  round(coh, 6) + 0e0 AS coherence, round(conf, 6) + 0e0 AS path_confidence, round(removed, 6) + 0e0 AS removed_energy_ratio"""
PATH_COLUMNS = ["residual_re", "residual_im", "gate", "snr_proxy", "coherence", "path_confidence", "removed_energy_ratio"]


@query("t18_bounded_cancellation", "clips", f"{path_sql()} SELECT clip_no, frame, bin, {PATH_OUT} FROM ap")
def t18(v: Views) -> DataFrame:
    rows = acoustic_path.acoustic_path(small_packed(v))
    return rounded(rows.select("clip_no", "frame", "bin", *PATH_COLUMNS))


@query("t18_bypass", "clips", f"{path_sql(True)} SELECT clip_no, frame, bin, {PATH_OUT} FROM ap")
def t18_bypass(v: Views) -> DataFrame:
    rows = acoustic_path.acoustic_path(small_packed(v), acoustic_path.PathSettings(bypass=True))
    return rounded(rows.select("clip_no", "frame", "bin", *PATH_COLUMNS))


VIEWS_SQL = """mv AS (SELECT *, ln((sqrt(nr*nr + ni*ni) + 1e-8) / (sqrt(fr*fr + fi*fi) + 1e-8)) AS log_ratio, sin(atan2(ni*fr - nr*fi, nr*fr + ni*fi)) AS phase_sin,
  cos(atan2(ni*fr - nr*fi, nr*fr + ni*fi)) AS phase_cos, sqrt(hr*hr + hi*hi) AS transfer_magnitude, (rr*rr + ri*ri) / greatest(nr*nr + ni*ni, 1e-8) AS er FROM ap)"""


@query(
    "t19_multi_view",
    "clips",
    f"""{path_sql()}, {VIEWS_SQL} SELECT clip_no, frame, bin, round(log_ratio, 6) + 0e0 AS log_ratio, round(phase_sin, 6) + 0e0 AS phase_sin, round(phase_cos, 6) + 0e0 AS phase_cos,
      round(transfer_magnitude, 6) + 0e0 AS transfer_magnitude, round(ln(1e0 + er), 6) + 0e0 AS log_energy_ratio FROM mv""",
)
def t19(v: Views) -> DataFrame:
    rows = acoustic_path.multi_view(small_packed(v))
    return rounded(
        rows.select(
            "clip_no", "frame", "bin", "log_ratio", "phase_sin", "phase_cos", "transfer_magnitude",
            F.log1p("view_to_near_energy_ratio").alias("log_energy_ratio"),
        )
    )


MELS = 8
MEL_SQL = f"""ed AS (SELECT i, CAST(floor(65e0 * (700e0 * (pow(10e0, (2595e0 * log10(1e0 + 8000e0 / 700e0)) * i / {MELS + 1}e0 / 2595e0) - 1e0)) / 16000e0) AS INTEGER) AS e
    FROM unnest(range(0, {MELS + 2})) x(i)),
  tri AS (SELECT a.i AS mel, a.e AS l, greatest(b.e, a.e + 1) AS c, greatest(r.e, greatest(b.e, a.e + 1) + 1) AS r FROM ed a JOIN ed b ON b.i = a.i + 1 JOIN ed r ON r.i = a.i + 2),
  wt AS (SELECT * FROM (SELECT mel, bin, CASE WHEN bin >= l AND bin < c THEN (bin - l) / CAST(c - l AS DOUBLE) WHEN bin >= c AND bin < r THEN (r - bin) / CAST(r - c AS DOUBLE) ELSE 0e0 END AS w
    FROM tri, unnest(range(0, 33)) y(bin)) WHERE w > 0)"""
MEANS = ("coherence", "log_ratio", "phase_sin", "phase_cos", "path_confidence")
MAPS_SQL = f"""mp AS (SELECT clip_no, frame, mel, ln(1e0 + sum(w * (nr*nr + ni*ni))) AS near, ln(1e0 + sum(w * (fr*fr + fi*fi))) AS far, ln(1e0 + sum(w * (rr*rr + ri*ri))) AS residual,
    sum(w * coh) / greatest(sum(w), 1e-12) AS coherence, sum(w * log_ratio) / greatest(sum(w), 1e-12) AS log_ratio, sum(w * phase_sin) / greatest(sum(w), 1e-12) AS phase_sin,
    sum(w * phase_cos) / greatest(sum(w), 1e-12) AS phase_cos, sum(w * conf) / greatest(sum(w), 1e-12) AS path_confidence FROM mv JOIN wt USING (bin) GROUP BY clip_no, frame, mel)"""


def small_weights(v: Views) -> DataFrame:
    return mel.weight_table(v.spark, mel.floor_binned_filters(64, 16000, MELS))


def small_maps(v: Views) -> DataFrame:
    return acoustic_path.mel_maps(acoustic_path.multi_view(small_packed(v)), small_weights(v))


@query(
    "fn15_mel_weights",
    sql=f"""WITH {MEL_SQL}, n AS (SELECT min(s_suppkey) AS a FROM supplier)
    SELECT s_suppkey, mel, bin, round(w * s_acctbal, 6) + 0e0 AS weighted FROM supplier JOIN wt ON bin = s_suppkey % 33""",
)
def fn15(v: Views) -> DataFrame:
    suppliers = v.table("supplier").withColumn("bin", (F.col("s_suppkey") % 33).cast("int"))
    joined = suppliers.join(F.broadcast(small_weights(v)), "bin")
    return rounded(joined.select("s_suppkey", "mel", "bin", (F.col("weight") * F.col("s_acctbal")).alias("weighted")))


@query(
    "fn16_mel_projection",
    "clips",
    f"""WITH {FRAMES_SQL}, {MEL_SQL} SELECT clip_no, frame, mel, round(ln(1e0 + sum(w * (nr*nr + ni*ni))), 6) + 0e0 AS log_mel,
      round(sum(w * sqrt(fr*fr + fi*fi)) / greatest(sum(w), 1e-12), 6) + 0e0 AS far_mean FROM sp JOIN wt USING (bin) GROUP BY clip_no, frame, mel""",
)
def fn16(v: Views) -> DataFrame:
    long = spectra.explode_bins(small_packed(v)).join(F.broadcast(small_weights(v)), "bin")
    w = F.col("weight")
    out = long.groupBy("clip_no", "block", "frame", "mel").agg(
        F.log1p(F.sum(w * c.power(c.cx("near")))).alias("log_mel"),
        (F.sum(w * c.magnitude(c.cx("far"))) / F.greatest(F.sum(w), F.lit(1.0e-12))).alias("far_mean"),
    )
    return rounded(out.drop("block"))


@query(
    "t20_base_mel_maps",
    "clips",
    f"{path_sql()}, {VIEWS_SQL}, {MEL_SQL}, {MAPS_SQL} SELECT " + round_all(" ".join(selection.BASE_CHANNELS), "clip_no, frame, mel") + " FROM mp",
)
def t20(v: Views) -> DataFrame:
    return rounded(small_maps(v).drop("block"))


@query(
    "a05_band_statistics",
    "clips",
    f"""{path_sql()}, bd AS (SELECT clip_no, CASE WHEN bin * 250e0 < 1000 THEN '0-1000Hz' WHEN bin * 250e0 < 4000 THEN '1000-4000Hz' WHEN bin * 250e0 < 8000 THEN '4000-8000Hz' END AS band, coh, gate, conf FROM ap),
    pc AS (SELECT clip_no, band, avg(coh) AS a, avg(gate) AS b, avg(conf) AS c FROM bd WHERE band IS NOT NULL GROUP BY clip_no, band)
    SELECT band, round(avg(a), 6) + 0e0 AS mean_coherence, round(avg(b), 6) + 0e0 AS mean_gate, round(avg(c), 6) + 0e0 AS mean_path_confidence FROM pc GROUP BY band""",
)
def a05(v: Views) -> DataFrame:
    per_clip = acoustic_path.band_statistics(acoustic_path.acoustic_path(small_packed(v)), 16000, 64)
    return rounded(acoustic_path.band_summary(per_clip))


@query(
    "a28_channel_normaliser",
    "manifest clips",
    f"""{path_sql()}, {VIEWS_SQL}, {MEL_SQL}, {MAPS_SQL},
    tn AS (SELECT mp.*, machine_type FROM mp JOIN manifest USING (clip_no) WHERE dataset_split = 'dev_train' AND condition = 'normal'),
    ch AS ("""
    + " UNION ALL ".join(f"SELECT machine_type, '{n}' AS channel, {n} AS x FROM tn" for n in selection.BASE_CHANNELS)
    + """) SELECT machine_type, channel, round(avg(x), 6) + 0e0 AS mean, round(sqrt(greatest(sum(x*x) / count(*) - pow(sum(x) / count(*), 2), 1e-6)), 6) + 0e0 AS std FROM ch GROUP BY machine_type, channel""",
)
def a28(v: Views) -> DataFrame:
    maps = small_maps(v).join(v.manifest.select("clip_no", "machine_type", "dataset_split", "condition"), "clip_no")
    return rounded(fit_normaliser(guards.normal_train(maps), ["machine_type"], selection.BASE_CHANNELS))


@query(
    "a28_normalised_maps",
    "manifest clips",
    f"""{path_sql()}, {VIEWS_SQL}, {MEL_SQL}, {MAPS_SQL},
    al AS (SELECT mp.*, machine_type, dataset_split, condition FROM mp JOIN manifest USING (clip_no)),
    tn AS (SELECT machine_type, avg(near) AS nm, sqrt(greatest(sum(near*near) / count(*) - pow(sum(near) / count(*), 2), 1e-6)) AS ns,
      avg(residual) AS rm, sqrt(greatest(sum(residual*residual) / count(*) - pow(sum(residual) / count(*), 2), 1e-6)) AS rs
      FROM al WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY machine_type)
    SELECT clip_no, frame, mel, round((near - nm) / ns, 6) + 0e0 AS near, round((residual - rm) / rs, 6) + 0e0 AS residual FROM al JOIN tn USING (machine_type) WHERE dataset_split = 'dev_test'""",
)
def a28_apply(v: Views) -> DataFrame:
    maps = small_maps(v).join(trained_manifest(v).select("clip_no", "machine_type", "dataset_split", "condition"), "clip_no")
    fit = fit_normaliser(guards.normal_train(maps), ["machine_type"], ("near", "residual"))
    scaled = normalise(guards.test_rows(maps), fit, ["machine_type"], ("near", "residual"))
    return rounded(scaled.select("clip_no", "frame", "mel", "near", "residual"))


@query(
    "a29_reliability_index",
    "clips",
    f"{path_sql()}, {VIEWS_SQL}, {MEL_SQL}, {MAPS_SQL} SELECT clip_no, round(greatest(0e0, least(1e0, avg(path_confidence))), 6) + 0e0 AS reliability FROM mp GROUP BY clip_no",
)
def a29(v: Views) -> DataFrame:
    return rounded(acoustic_path.reliability_index(small_maps(v)))


OVERLAP_SQL = """ir AS (SELECT clip_no, frame, tw.k AS k, sum(CASE WHEN bin = 0 OR bin = 32 THEN 1e0 ELSE 2e0 END * (rr * tw.c + ri * tw.s)) / 64e0 * (0.5e0 - 0.5e0 * cos(2e0 * pi() * tw.k / 63e0)) AS x,
        pow(0.5e0 - 0.5e0 * cos(2e0 * pi() * tw.k / 63e0), 2) AS w FROM ap JOIN twiddle tw USING (bin) GROUP BY clip_no, frame, tw.k),
    oa AS (SELECT i.clip_no, st0.start + i.k AS t, sum(x) AS x, sum(w) AS w FROM ir i JOIN starts st0 USING (clip_no, frame) GROUP BY ALL),
    rw AS (SELECT c.clip_no, c.t, c.samples, CASE WHEN w > 2.220446049250313e-16 THEN x / w ELSE c.near END AS value FROM clips c LEFT JOIN oa USING (clip_no, t))"""


def log_mel_sql(source: str, column: str) -> str:
    """CTEs ``vt``: five stacked dB frames of a centred, unscaled 64-point transform and 8 area-normalised bands."""
    return f"""lg AS (SELECT clip_no, samples // 32 AS last FROM (SELECT DISTINCT clip_no, samples FROM {source})),
    ls AS (SELECT clip_no, f AS frame, f * 32 - 32 AS start FROM lg, unnest(range(0, last + 1)) u(f)),
    lf AS (SELECT s.clip_no, s.frame, c.t - s.start AS k, c.{column} * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (c.t - s.start) / 64e0)) AS x FROM ls s JOIN {source} c ON c.clip_no = s.clip_no AND c.t >= s.start AND c.t < s.start + 64),
    lt AS (SELECT b AS bin, k, cos(2e0 * pi() * ((b * k) % 64) / 64e0) AS c, sin(2e0 * pi() * ((b * k) % 64) / 64e0) AS s FROM unnest(range(0, 33)) p(b), unnest(range(0, 64)) q(k)),
    lp AS MATERIALIZED (SELECT clip_no, frame, bin, pow(sum(x * c), 2) + pow(sum(x * s), 2) AS p FROM lf JOIN lt USING (k) GROUP BY ALL),
    mz AS (SELECT i, CASE WHEN m < 15e0 THEN m * 200e0 / 3e0 ELSE 1000e0 * exp(ln(6.4e0) / 27e0 * (m - 15e0)) END AS hz FROM (SELECT i, i * (15e0 + ln(8e0) / (ln(6.4e0) / 27e0)) / 9e0 AS m FROM unnest(range(0, 10)) u(i))),
    mw AS (SELECT a.i AS mel, bin, greatest(0e0, least((bin * 250e0 - a.hz) / (b.hz - a.hz), (c.hz - bin * 250e0) / (c.hz - b.hz))) * 2e0 / (c.hz - a.hz) AS w
      FROM mz a JOIN mz b ON b.i = a.i + 1 JOIN mz c ON c.i = a.i + 2, unnest(range(0, 33)) v(bin)),
    ml AS (SELECT clip_no, frame, mel, 10e0 * log10(greatest(sum(w * p), 2.220446049250313e-16)) AS db FROM lp JOIN mw USING (bin) GROUP BY ALL),
    fr AS (SELECT clip_no, frame, sum(CAST(CAST(db AS FLOAT) AS DOUBLE)) AS db, max(frame) OVER (PARTITION BY clip_no) AS last FROM ml GROUP BY clip_no, frame),
    vt AS (SELECT clip_no, frame AS vec_idx, sum(db) OVER (PARTITION BY clip_no ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS total, last FROM fr)"""


@query(
    "t04_overlap_add",
    "clips",
    f"{path_sql()}, {OVERLAP_SQL} SELECT clip_no, t, round(value, 6) + 0e0 AS value FROM rw",
)
def t04(v: Views) -> DataFrame:
    rows = acoustic_path.acoustic_path(small_packed(v))
    packed = spectra.pack_bins(rows, ["residual_re", "residual_im"], ["samples"])
    return rounded(spectra.reconstruct(packed, SMALL, "residual_re", "residual_im", v.clips))


@query(
    "m01_acoustic_path_scores",
    "manifest clips",
    f"""{path_sql()}, av AS (SELECT clip_no, bin, 'near' AS "view", ln(1e0 + sqrt(nr*nr + ni*ni)) AS x FROM ap UNION ALL SELECT clip_no, bin, 'far', ln(1e0 + sqrt(fr*fr + fi*fi)) FROM ap
      UNION ALL SELECT clip_no, bin, 'residual', ln(1e0 + sqrt(rr*rr + ri*ri)) FROM ap),
    js AS (SELECT q.*, file_id, machine_type, section, domain, condition, dataset_split FROM (SELECT clip_no, bin, "view", avg(x) AS mean, stddev_pop(x) AS std FROM av GROUP BY ALL) q JOIN manifest USING (clip_no)),
    fit AS (SELECT machine_type, "view", bin, avg(mean) AS mc, greatest(stddev_pop(mean), 1e-4) AS ms, avg(std) AS sc, greatest(stddev_pop(std), 1e-4) AS ss
      FROM js WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY ALL),
    vs AS (SELECT "view", file_id, condition, avg((pow((mean - mc) / ms, 2) + pow((std - sc) / ss, 2)) / 2e0) AS x FROM js JOIN fit USING (machine_type, "view", bin) WHERE dataset_split = 'dev_test' GROUP BY ALL)
    SELECT file_id, condition, round(avg(x), 4) + 0e0 AS anomaly_score FROM vs GROUP BY file_id, condition""",
)
def m01_path(v: Views) -> DataFrame:
    scores = benchmark.scored_summaries(benchmark.path_summaries(small_packed(v)), trained_manifest(v))
    return rounded(scores.select("file_id", "condition", "anomaly_score"), places=4)
