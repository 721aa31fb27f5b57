"""Queries of the reference-subtraction path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.scores import round_all, rounded
from hushline.catalog.views import Views
from hushline.functions.numeric import d
from hushline.operators import chunks, guards, policy, spectra
from hushline.operators import subtraction as sub
from hushline.operators.spectra import Stft
from hushline.operators.subtraction import SubtractionSettings
from hushline.plans import safe_reference
from hushline.schemas import GROUP
from hushline.session import stored

SMALL = Stft.reference(64, 32)
S = SubtractionSettings()

# Half a window of zeros on both sides, padded to whole hops, periodic Hann, divided by the window sum (32).
SPECTRA_SQL = """geo AS (SELECT clip_no, samples, CAST(ceil(greatest(samples, 64) / 32e0) AS BIGINT) AS last FROM (SELECT DISTINCT clip_no, samples FROM clips)),
starts AS (SELECT clip_no, samples, f AS frame, f * 32 - 32 AS start FROM geo, unnest(range(0, last + 1)) u(f)),
smp AS (SELECT s.clip_no, s.frame, c.t - s.start AS k, c.near * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (c.t - s.start) / 64e0)) / 32e0 AS near,
    c.far * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (c.t - s.start) / 64e0)) / 32e0 AS far
  FROM starts s JOIN clips c ON c.clip_no = s.clip_no AND c.t >= s.start AND c.t < s.start + 64),
twiddle AS (SELECT b AS bin, k, cos(2e0 * pi() * ((b * k) % 64) / 64e0) AS c, -sin(2e0 * pi() * ((b * k) % 64) / 64e0) AS s
  FROM unnest(range(0, 33)) x(b), unnest(range(0, 64)) y(k)),
sp AS MATERIALIZED (SELECT clip_no, frame, bin, sum(near * c) AS nr, sum(near * s) AS ni, sum(far * c) AS fr, sum(far * s) AS fi FROM smp JOIN twiddle USING (k) GROUP BY clip_no, frame, bin)"""
FLOORS_SQL = """fl AS (SELECT clip_no, bin, quantile_cont(nr*nr + ni*ni, 0.1) AS nf, quantile_cont(fr*fr + fi*fi, 0.1) AS ff FROM sp GROUP BY clip_no, bin),
tf AS (SELECT machine_type, section, bin, greatest(0.1e0, least(10e0, quantile_cont(nf / greatest(ff, 1e-8), 0.5))) AS h FROM fl JOIN manifest USING (clip_no)
  WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY ALL)"""
ENHANCED_SQL = """eh AS (SELECT clip_no, frame, bin, nr, ni, fr, fi, CASE WHEN nr*nr + ni*ni > 0 THEN sqrt(greatest(nr*nr + ni*ni - 1.5e0 * h * (fr*fr + fi*fi), 0.1e0 * (nr*nr + ni*ni)) / (nr*nr + ni*ni)) ELSE 0e0 END AS g
  FROM sp JOIN manifest USING (clip_no) JOIN tf USING (machine_type, section, bin))"""
WAVE_SQL = """ir AS (SELECT clip_no, frame, tw.k AS k, 32e0 * sum(CASE WHEN bin = 0 OR bin = 32 THEN 1e0 ELSE 2e0 END * g * (nr * tw.c + ni * tw.s)) / 64e0 AS x FROM eh JOIN twiddle tw USING (bin) GROUP BY clip_no, frame, tw.k),
wv AS (SELECT i.clip_no, st.start + i.k AS t, sum(x * (0.5e0 - 0.5e0 * cos(2e0 * pi() * i.k / 64e0))) / sum(pow(0.5e0 - 0.5e0 * cos(2e0 * pi() * i.k / 64e0), 2)) AS value
  FROM ir i JOIN starts st USING (clip_no, frame) WHERE st.start + i.k >= 0 AND st.start + i.k < samples GROUP BY ALL)"""
DIAGNOSTICS_SQL = """es AS (SELECT s.clip_no, s.frame, w.t - s.start AS k, value * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (w.t - s.start) / 64e0)) / 32e0 AS x
  FROM starts s JOIN wv w ON w.clip_no = s.clip_no AND w.t >= s.start AND w.t < s.start + 64),
e2 AS (SELECT clip_no, frame, bin, sum(x * c) AS er, sum(x * s) AS ei FROM es JOIN twiddle USING (k) GROUP BY clip_no, frame, bin),
pb AS (SELECT clip_no, bin, avg(nr*fr + ni*fi) AS xr, avg(ni*fr - nr*fi) AS xi, avg(nr*nr + ni*ni) AS nn, avg(fr*fr + fi*fi) AS fm, quantile_cont(nr*nr + ni*ni, 0.1) AS nf,
    quantile_cont(fr*fr + fi*fi, 0.1) AS ff, quantile_cont(er*er + ei*ei, 0.1) AS ef, sum(abs(sqrt(er*er + ei*ei) - sqrt(nr*nr + ni*ni))) AS moved, sum(sqrt(nr*nr + ni*ni)) AS size
  FROM sp JOIN e2 USING (clip_no, frame, bin) GROUP BY clip_no, bin),
dg0 AS (SELECT clip_no, sum(greatest(0e0, least(1e0, (xr*xr + xi*xi) / greatest(nn*fm, 1e-8))) * greatest(nn - nf, 0e0)) / greatest(sum(greatest(nn - nf, 0e0)), 1e-8) AS leakage_index,
    quantile_cont(abs(ln(greatest(greatest(0.1e0, least(10e0, nf / greatest(ff, 1e-8))), 1e-8)) - ln(greatest(h, 1e-8))), 0.5) AS transfer_instability,
    sum(moved) / greatest(sum(size), 1e-8) AS spectral_drift, 10e0 * log10(greatest(sum(nf), 1e-8) / greatest(sum(ef), 1e-8)) AS noise_reduction_db
  FROM pb JOIN manifest USING (clip_no) JOIN tf USING (machine_type, section, bin) GROUP BY clip_no),
dg AS (SELECT *, greatest(greatest(0e0, least(1e0, leakage_index)), transfer_instability / (1e0 + transfer_instability), spectral_drift / (1e0 + spectral_drift)) AS risk_score FROM dg0)"""
PROFILE_SQL = """pf AS (SELECT machine_type, section, quantile_cont(leakage_index, 0.95) AS leakage_u95, quantile_cont(transfer_instability, 0.95) AS transfer_instability_u95,
    quantile_cont(spectral_drift, 0.95) AS spectral_drift_u95, quantile_cont(noise_reduction_db, 0.05) AS noise_reduction_l05_db, count(*) AS training_clips
  FROM dg JOIN manifest USING (clip_no) WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY ALL),
pr AS (SELECT *, greatest(greatest(0e0, least(1e0, leakage_u95)), transfer_instability_u95 / (1e0 + transfer_instability_u95), spectral_drift_u95 / (1e0 + spectral_drift_u95)) AS risk_score FROM pf)"""


def trained_manifest(v: Views) -> DataFrame:
    """Clips of groups with normal training clips; the job refuses the others, which m08_refused reports."""
    return guards.trained_only(v.manifest, guards.normal_train(v.manifest))


def trained_clips(v: Views) -> DataFrame:
    return v.clips.join(trained_manifest(v).select("clip_no"), "clip_no", "left_semi").select(*v.clips.columns)


@query(
    "m08_refused",
    "manifest",
    """SELECT machine_type, section, count(*) AS clips FROM manifest WHERE (machine_type, section) NOT IN
      (SELECT (machine_type, section) FROM manifest WHERE dataset_split IN ('dev_train', 'add_train') AND condition = 'normal') GROUP BY ALL""",
)
def m08_refused(v: Views) -> DataFrame:
    """Clips of groups without a noise profile, by group."""
    missing = guards.untrained_groups(v.manifest, guards.normal_train(v.manifest))
    return v.manifest.join(missing, GROUP).groupBy(*GROUP).agg(F.count("*").alias("clips"))


def packed(v: Views) -> DataFrame:
    return spectra.stft(v.clips, SMALL)


def built(v: Views) -> safe_reference.SafeReference:
    # The bridge view derives sample positions with windows; the build reads the samples several times, always in these blocks.
    blocks = spectra.blocks(trained_clips(v), SMALL, S.block)
    return safe_reference.build(stored(blocks, "blocks"), trained_manifest(v), SMALL, S, materialise=True)


def transfers(v: Views, rows: DataFrame) -> DataFrame:
    train = guards.normal_train(v.manifest)
    kept = rows.join(train.select("clip_no"), "clip_no", "left_semi")
    return sub.noise_transfer(sub.power_floors(kept, ("near", "far"), S), train, S)


@query(
    "t02_reference_stft",
    "clips",
    f"WITH {SPECTRA_SQL} SELECT clip_no, frame, bin, round(nr, 6) + 0e0 AS near_re, round(ni, 6) + 0e0 AS near_im, round(fr, 6) + 0e0 AS far_re, round(fi, 6) + 0e0 AS far_im FROM sp",
)
def t02(v: Views) -> DataFrame:
    return rounded(spectra.explode_bins(spectra.stft(v.clips, SMALL, placed=False)).drop("block", "samples", "frames"))


@query(
    "t03_inverse_round_trip",
    "clips",
    "SELECT clip_no, t, round(near, 6) + 0e0 AS value FROM clips",
)
def t03(v: Views) -> DataFrame:
    wave = spectra.overlap_add(packed(v), SMALL, "near_re", "near_im")
    return rounded(wave.select("clip_no", "t", "value"))


@query(
    "a13_noise_floor",
    "clips manifest",
    f"WITH {SPECTRA_SQL}, {FLOORS_SQL} SELECT clip_no, bin, round(nf, 6) + 0e0 AS near_floor, round(ff, 6) + 0e0 AS far_floor FROM fl",
)
def a13(v: Views) -> DataFrame:
    return rounded(sub.power_floors(packed(v), ("near", "far"), S))


@query(
    "a14_noise_transfer",
    "clips manifest",
    f"WITH {SPECTRA_SQL}, {FLOORS_SQL} SELECT machine_type, section, bin, round(h, 6) + 0e0 AS transfer_power FROM tf",
)
def a14(v: Views) -> DataFrame:
    return rounded(transfers(v, packed(v)))


@query(
    "j06_group_lookup",
    "clips manifest",
    f"WITH {SPECTRA_SQL}, {FLOORS_SQL} SELECT clip_no, frame, bin, round(h, 6) + 0e0 AS transfer_power FROM sp JOIN manifest USING (clip_no) JOIN tf USING (machine_type, section, bin)",
)
def j06(v: Views) -> DataFrame:
    rows = spectra.stft(trained_clips(v), SMALL)
    shaped = sub.with_group_transfer(rows, transfers(v, rows), v.manifest)
    return rounded(spectra.explode_bins(shaped, ["transfer_power"]).select("clip_no", "frame", "bin", "transfer_power"))


@query(
    "t22_reference_subtraction",
    "clips manifest",
    f"WITH {SPECTRA_SQL}, {FLOORS_SQL}, {ENHANCED_SQL} SELECT clip_no, frame, bin, round(nr*g, 6) + 0e0 AS enh_re, round(ni*g, 6) + 0e0 AS enh_im FROM eh",
)
def t22(v: Views) -> DataFrame:
    rows = spectra.stft(trained_clips(v), SMALL)
    shaped = sub.with_group_transfer(rows, transfers(v, rows), v.manifest)
    return rounded(sub.subtract(shaped, S).select("clip_no", "frame", "bin", "enh_re", "enh_im"))


@query(
    "t22_enhanced_waveform",
    "clips manifest",
    f"WITH {SPECTRA_SQL}, {FLOORS_SQL}, {ENHANCED_SQL}, {WAVE_SQL} SELECT clip_no, t, round(value, 6) + 0e0 AS value FROM wv",
)
def t22_wave(v: Views) -> DataFrame:
    wave = safe_reference.build(trained_clips(v), trained_manifest(v), SMALL, S).waveform
    return rounded(chunks.samples_of(wave, ["value"]).select("clip_no", "t", "value"))


CHAIN = f"WITH {SPECTRA_SQL}, {FLOORS_SQL}, {ENHANCED_SQL}, {WAVE_SQL}, {DIAGNOSTICS_SQL}"


@query(
    "a15_clip_diagnostics",
    "clips manifest",
    f"{CHAIN} SELECT " + round_all("leakage_index transfer_instability spectral_drift noise_reduction_db risk_score", "clip_no") + " FROM dg",
)
def a15(v: Views) -> DataFrame:
    return rounded(built(v).diagnostics.select("clip_no", *sub.DIAGNOSTICS, "risk_score"))


@query(
    "a16_group_profile",
    "clips manifest",
    f"{CHAIN}, {PROFILE_SQL} SELECT "
    + round_all("leakage_u95 transfer_instability_u95 spectral_drift_u95 noise_reduction_l05_db risk_score", "machine_type, section, training_clips")
    + " FROM pr",
)
def a16(v: Views) -> DataFrame:
    return rounded(built(v).profiles)


@query(
    "m08_safe_reference_build",
    "clips manifest",
    f"""{CHAIN}, {PROFILE_SQL} SELECT clip_no, round(dg.risk_score, 6) + 0e0 AS risk_score, round(pr.risk_score, 6) + 0e0 AS group_risk,
      CASE WHEN pr.risk_score <= 0.5e0 AND noise_reduction_l05_db >= 1e0 THEN 'refsub' ELSE 'near' END AS decision FROM dg JOIN manifest USING (clip_no) JOIN pr USING (machine_type, section)""",
)
def m08(v: Views) -> DataFrame:
    out = built(v)
    rule = v.spark.range(1).select(d(0.5).alias("risk_max"), d(1.0).alias("benefit_min_db"))
    groups = policy.decisions(out.profiles, rule).withColumnRenamed("risk_score", "group_risk")
    joined = out.diagnostics.join(groups.select(*GROUP, "group_risk", "decision"), GROUP)
    return rounded(joined.select("clip_no", F.col("risk_score"), "group_risk", "decision"))
