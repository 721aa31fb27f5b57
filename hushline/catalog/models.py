"""Queries over feature vectors: subsamples, reconstruction scorers, calibration and selective decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.scores import roc_sql, round_all, rounded, spearman_sql
from hushline.catalog.spectra import MELS, OVERLAP_SQL, SMALL, log_mel_sql, path_sql, small_maps
from hushline.catalog.views import Views
from hushline.functions.numeric import d
from hushline.operators import acoustic_path, calibration, chunks, guards, log_mel, roc, spectra, summaries
from hushline.operators import linear_model as lm
from hushline.plans import failure_analysis, multi_view, systems
from hushline.schemas import GROUP, IDENTITY
from hushline.session import stored


def clip_vectors(v: Views) -> DataFrame:
    """One vector per clip with the identity columns."""
    return v.vector_pairs.select(
        F.col("vec_id").cast("string").alias("file_id"), *GROUP, "domain", "condition", "dataset_split",
        F.lit(0).alias("vec_idx"), "near", F.col("residual").alias("refsub"), "reliability",
    )


@query(
    "m05_held_out_split",
    "vectors",
    """WITH n AS (SELECT vec_id, machine_type, row_number() OVER (PARTITION BY machine_type ORDER BY md5(concat('42|', CAST(vec_id AS VARCHAR)))) - 1 AS pos,
      count(*) OVER (PARTITION BY machine_type) AS n FROM vectors WHERE dataset_split = 'dev_train' AND condition = 'normal')
    SELECT vec_id, machine_type, pos >= ceil(0.1e0 * n) AS kept FROM n""",
)
def m05(v: Views) -> DataFrame:
    train = guards.normal_train(v.vectors)
    return lm.held_out_split(train, ["machine_type"], "vec_id", 42).select("vec_id", "machine_type", "kept")


def scored_by_machine(v: Views, rows: DataFrame, value: str, target: int | None = None, seed: int = 13711) -> DataFrame:
    keys = ["machine_type"]
    train = lm.held_out_split(guards.normal_train(rows, ["dev_train"]), keys, "file_id", seed).where("kept")
    model = lm.fit_subspace(train, keys, value)
    packed = lm.pack_vectors(rows.where(F.col("dataset_split") == "dev_test"), IDENTITY, "vec_idx", value)
    return lm.reconstruction_scores(packed, model, keys, IDENTITY, target)


@query("m02_reconstruction_scores")
def m02(v: Views) -> DataFrame:
    return rounded(scored_by_machine(v, clip_vectors(v), "near"))


@query("m02_reconstruction_metrics")
def m02_metrics(v: Views) -> DataFrame:
    scores = scored_by_machine(v, clip_vectors(v), "near")
    return rounded(summaries.macro_summary(roc.metric_table(scores)))


@query("m03_gated_fusion_scores")
def m03(v: Views) -> DataFrame:
    rows = clip_vectors(v)
    gated = F.transform("refsub", lambda x: x * F.col("reliability"))
    return rounded(scored_by_machine(v, rows.withColumn("both", F.concat("near", gated)), "both", target=64))


@query("m04_multi_view_scores")
def m04(v: Views) -> DataFrame:
    maps = small_maps(v).join(v.manifest.select("clip_no", *IDENTITY, "dataset_split"), "clip_no")
    return rounded(multi_view.multi_view_scores(stored(maps), MELS, (42, 2026)))


def decided(v: Views) -> DataFrame:
    rule = F.when(F.col("machine_type").isin("L0", "L2", "L4"), "refsub").otherwise("near")
    return v.vectors.select(*GROUP).distinct().withColumn("decision", rule)


SEEDS = (13711, 42, 2026)


@query("m06_development_gate")
def m06(v: Views) -> DataFrame:
    return rounded(systems.development_run(clip_vectors(v), decided(v), SEEDS, iterations=5000).gate)


@query("m06_system_summary")
def m06_summary(v: Views) -> DataFrame:
    return rounded(systems.development_run(clip_vectors(v), decided(v), SEEDS, iterations=5000).summary)


@query("m06_system_bootstrap")
def m06_bootstrap(v: Views) -> DataFrame:
    return rounded(systems.development_run(clip_vectors(v), decided(v), SEEDS, iterations=5000).bootstrap)


@query("m07_label_blind_scores")
def m07(v: Views) -> DataFrame:
    rows = clip_vectors(v).replace({"dev_train": "add_train", "dev_test": "eval_test"}, subset=["dataset_split"])
    hidden = F.when(F.col("dataset_split") == "eval_test", "unknown").otherwise(F.col("condition"))
    run = systems.evaluation_run(rows.withColumn("condition", hidden), decided(v), SEEDS)
    return rounded(run.scores.drop("model_id", "experiment_id"))


M09_SQL = f"""WITH mv AS (SELECT vec_id, avg(near) AS near_mean, avg(residual) AS residual_mean, avg(residual - near) AS residual_minus_near, avg(abs(residual - near)) AS shift_l1,
      avg(near*near) AS ra, avg(residual*residual) AS ca FROM dims GROUP BY vec_id),
    pc AS (SELECT CAST(vec_id AS VARCHAR) AS file_id, machine_type, section, domain, condition, ca - ra AS score_delta, abs(ca - ra) AS absolute_score_delta, residual_minus_near, shift_l1
      FROM mv JOIN vectors USING (vec_id) WHERE dataset_split = 'dev_test')"""


def analysed(v: Views) -> failure_analysis.FailureAnalysis:
    rows = clip_vectors(v).where(F.col("dataset_split") == "dev_test")
    energy = lambda c: F.aggregate(c, d(0.0), lambda a, x: a + x * x) / F.size(c)
    score = lambda c: rows.select(*IDENTITY, energy(c).alias("anomaly_score"))
    return failure_analysis.analyse(rows.withColumnRenamed("refsub", "residual"), score("near"), score("refsub"))


@query(
    "m09_failure_strata",
    "dims",
    f"""{M09_SQL} SELECT machine_type, section, domain, condition, clips, round(a, 6) + 0e0 AS score_delta_mean, round(b, 6) + 0e0 AS residual_minus_near_mean, round(c, 6) + 0e0 AS shift_l1_mean, round(m, 6) + 0e0 AS score_delta_median
    FROM (SELECT machine_type, section, domain, condition, count(*) AS clips, avg(score_delta) AS a, avg(residual_minus_near) AS b, avg(shift_l1) AS c, quantile_cont(score_delta, 0.5) AS m FROM pc GROUP BY ALL)""",
)
def m09(v: Views) -> DataFrame:
    return rounded(analysed(v).strata)


@query(
    "m09_failure_correlations",
    "dims",
    f"""{M09_SQL}, o AS (SELECT file_id, machine_type, section, residual_minus_near, 'score_delta' AS outcome, score_delta AS y FROM pc
      UNION ALL SELECT file_id, machine_type, section, residual_minus_near, 'absolute_score_delta', absolute_score_delta FROM pc),
    g AS (SELECT 'all' AS "group", * FROM o UNION ALL SELECT concat(machine_type,'/',section), * FROM o),
    {spearman_sql('g', '"group", outcome', 'residual_minus_near', 'y')}
    SELECT "group", outcome, clips, round(spearman_rho, 6) + 0e0 AS spearman_rho FROM rho""",
)
def m09_correlations(v: Views) -> DataFrame:
    return rounded(analysed(v).correlations.drop("two_sided_p_value"))


@query(
    "a30_micro_mean_score",
    sql="""SELECT l_suppkey, round(sum(l_quantity * l_quantity) / sum(l_linenumber), 6) + 0e0 AS anomaly_score FROM lineitem GROUP BY l_suppkey""",
)
def a30(v: Views) -> DataFrame:
    rows = v.table("lineitem").withColumn("error", F.col("l_quantity") * F.col("l_quantity"))
    return rounded(lm.micro_mean(rows, ["l_suppkey"], "error", "l_linenumber"))


# ---- log-mel vectors ---------------------------------------------------------------------------


@query(
    "w03_stacked_frames",
    "clips",
    """WITH f AS (SELECT clip_no, t // 8 AS frame, sum(near) AS a, sum(far) AS b FROM clips GROUP BY ALL)
    SELECT clip_no, frame AS vec_idx, i AS dim, round(v, 3) + 0e0 AS value FROM (
      SELECT clip_no, frame, lead(a, CAST(k AS INTEGER)) OVER (PARTITION BY clip_no, k ORDER BY frame) AS a, lead(b, CAST(k AS INTEGER)) OVER (PARTITION BY clip_no, k ORDER BY frame) AS b, k,
        max(frame) OVER (PARTITION BY clip_no) AS last FROM f, unnest(range(0, 5)) u(k)) q, LATERAL (VALUES (2 * k, a), (2 * k + 1, b)) x(i, v)
    WHERE frame + 4 <= last""",
)
def w03(v: Views) -> DataFrame:
    frames = v.clips.groupBy("clip_no", F.expr("t div 8").alias("frame")).agg(F.sum("near").alias("a"), F.sum("far").alias("b"))
    frames = frames.select("clip_no", F.expr("frame div 16").alias("block"), "frame", F.array("a", "b").alias("values"))
    stacked = log_mel.stack_frames(frames, "values", 5, 16)
    long = stacked.select("clip_no", "vec_idx", F.posexplode("values").alias("dim", "value"))
    return rounded(long.withColumn("dim", F.col("dim").cast("bigint")).withColumn("value", F.col("value").cast("double")), places=3)


@query("t21_log_mel_vectors", "clips", f"WITH {log_mel_sql('clips', 'near')} SELECT clip_no, vec_idx, 40 AS width, round(total, 4) + 0e0 AS total FROM vt WHERE vec_idx + 4 <= last")
def t21(v: Views) -> DataFrame:
    vectors = log_mel.log_mel_vectors(v.clips, "near", 16000, 8, spectra.Stft.log_mel(64, 32))
    return rounded(
        vectors.select("clip_no", "vec_idx", F.size("values").alias("width"), F.aggregate(F.col("values").cast("array<double>"), d(0.0), lambda a, x: a + x).alias("total")),
        places=4,
    )


@query("t23_residual_vectors", "clips", f"{path_sql()}, {OVERLAP_SQL}, {log_mel_sql('rw', 'value')} SELECT clip_no, vec_idx, 40 AS width, round(total, 4) + 0e0 AS total FROM vt WHERE vec_idx + 4 <= last")
def t23(v: Views) -> DataFrame:
    rows = acoustic_path.acoustic_path(spectra.stft(v.clips, SMALL))
    packed = spectra.pack_bins(rows, ["residual_re", "residual_im"], ["samples"])
    wave = chunks.inverse(packed, SMALL, spectra.BLOCK, "residual_re", "residual_im", fallback=v.clips)
    vectors = log_mel.log_mel_vectors(wave, "value", 16000, 8, spectra.Stft.log_mel(64, 32))
    return rounded(
        vectors.select("clip_no", "vec_idx", F.size("values").alias("width"), F.aggregate(F.col("values").cast("array<double>"), d(0.0), lambda a, x: a + x).alias("total")),
        places=4,
    )


# ---- declared: calibration and selective decisions ---------------------------------------------


def normal_scores(v: Views) -> DataFrame:
    return v.score_table("candidate", "dev_train").where(F.col("condition") == "normal")


CAL = "cal AS (SELECT * FROM scores_pair WHERE dataset_split = 'dev_train' AND condition = 'normal'), tst AS (SELECT * FROM scores_pair WHERE dataset_split = 'dev_test')"


@query(
    "d07_conformal_p_values",
    "scores_pair",
    f"""WITH {CAL}, u AS (SELECT machine_type, section, score_candidate AS s, file_id, 0 AS c FROM tst UNION ALL SELECT machine_type, section, score_candidate, NULL, 1 FROM cal),
    w AS (SELECT *, sum(c) OVER (PARTITION BY machine_type, section ORDER BY s DESC) AS above, sum(c) OVER (PARTITION BY machine_type, section) AS n FROM u)
    SELECT file_id, round((1e0 + above) / (n + 1e0), 6) + 0e0 AS p_value, CAST(n AS BIGINT) AS calibration_n FROM w WHERE file_id IS NOT NULL""",
)
def d07(v: Views) -> DataFrame:
    p = calibration.conformal_p_values(normal_scores(v), v.score_table("candidate"), GROUP)
    return rounded(p.select("file_id", "p_value", "calibration_n"))


@query(
    "d08_thresholds",
    "scores_pair",
    f"""WITH {CAL}, m AS (SELECT machine_type, section, quantile_cont(score_candidate, 0.95) AS percentile, quantile_cont(score_candidate, 0.5) AS median FROM cal GROUP BY ALL),
    a AS (SELECT machine_type, section, quantile_cont(abs(score_candidate - median), 0.5) AS mad FROM cal JOIN m USING (machine_type, section) GROUP BY ALL)
    SELECT machine_type, section, round(percentile, 6) + 0e0 AS percentile, round(median, 6) + 0e0 AS median, round(mad, 6) + 0e0 AS mad, round(median + 3e0 * mad, 6) + 0e0 AS threshold FROM m JOIN a USING (machine_type, section)""",
)
def d08(v: Views) -> DataFrame:
    train = normal_scores(v)
    plain = calibration.percentile_threshold(train, GROUP, 0.95).withColumnRenamed("threshold", "percentile")
    return rounded(plain.join(calibration.robust_threshold(train, GROUP), GROUP))


DECIDED_SQL = f"""{CAL}, th AS (SELECT machine_type, section, quantile_cont(score_candidate, 0.95) AS threshold FROM cal GROUP BY ALL),
    dc AS (SELECT *, CASE WHEN abs(score_candidate - threshold) <= 20e0 OR (CAST(file_id AS BIGINT) % 10) / 10e0 < 0.1e0 THEN 'ABSTAIN' WHEN score_candidate > threshold THEN 'ANOMALOUS' ELSE 'NORMAL' END AS decision
      FROM tst JOIN th USING (machine_type, section))"""


def selective(v: Views) -> DataFrame:
    thresholds = calibration.percentile_threshold(normal_scores(v), GROUP, 0.95)
    rows = v.score_table("candidate").join(thresholds, GROUP)
    confidence = (F.col("file_id").cast("bigint") % 10) / d(10.0)
    choice = calibration.selective_decision(F.col("anomaly_score"), F.col("threshold"), 20.0, confidence, 0.1)
    return rows.withColumn("decision", choice)


@query("d09_selective_decisions", "scores_pair", f"WITH {DECIDED_SQL} SELECT file_id, decision FROM dc")
def d09(v: Views) -> DataFrame:
    return selective(v).select("file_id", "decision")


@query(
    "d10_selective_metrics",
    "scores_pair",
    f"""WITH {DECIDED_SQL}, k AS (SELECT machine_type, count(*) AS clips, count(*) FILTER (decision = 'ABSTAIN') AS abstained, count(*) FILTER (decision = 'ANOMALOUS' AND condition = 'anomaly') AS tp,
      count(*) FILTER (decision = 'ANOMALOUS' AND condition <> 'anomaly') AS fp, count(*) FILTER (decision = 'NORMAL' AND condition = 'anomaly') AS fn, count(*) FILTER (decision = 'NORMAL' AND condition <> 'anomaly') AS tn FROM dc GROUP BY machine_type)
    SELECT machine_type, clips, abstained, tp, fp, fn, tn, round(abstained / CAST(clips AS DOUBLE), 6) + 0e0 AS abstention_rate, round(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 6) + 0e0 AS false_positive_rate,
      round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) + 0e0 AS "precision", round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) + 0e0 AS recall, round(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 6) + 0e0 AS f1 FROM k""",
)
def d10(v: Views) -> DataFrame:
    return rounded(calibration.selective_metrics(selective(v), ["machine_type"]))


CURVE_SQL = """q AS (SELECT machine_type, section, round(abs(score_candidate - 100e0), 3) AS confidence, (score_candidate > 100) <> (condition = 'anomaly') AS wrong FROM scores_pair WHERE dataset_split = 'dev_test'),
    cc AS (SELECT machine_type, section, confidence, count(*) AS n, count(*) FILTER (wrong) AS e FROM q GROUP BY ALL),
    cv AS (SELECT machine_type, section, confidence, n, sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY machine_type, section) AS DOUBLE) AS coverage, sum(e) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS risk
      FROM cc WINDOW w AS (PARTITION BY machine_type, section ORDER BY confidence DESC))"""


def curve(v: Views) -> DataFrame:
    rows = v.score_table("candidate").withColumn("confidence", F.round(F.abs(F.col("anomaly_score") - d(100.0)), 3))
    wrong = (F.col("anomaly_score") > 100) != (F.col("condition") == "anomaly")
    return calibration.risk_coverage(rows, GROUP, "confidence", wrong)


@query(
    "d10_risk_coverage",
    "scores_pair",
    f"WITH {CURVE_SQL} SELECT machine_type, section, round(confidence, 6) + 0e0 AS confidence, n, round(coverage, 6) + 0e0 AS coverage, round(risk, 6) + 0e0 AS risk FROM cv",
)
def d10_curve(v: Views) -> DataFrame:
    return rounded(curve(v))


@query(
    "d10_aurc",
    "scores_pair",
    f"WITH {CURVE_SQL} SELECT machine_type, section, round(sum(risk * n) / sum(n), 6) + 0e0 AS aurc FROM cv GROUP BY machine_type, section",
)
def d10_aurc(v: Views) -> DataFrame:
    return rounded(calibration.area_under_risk_coverage(curve(v), GROUP))


@query("d11_mahalanobis_scores")
def d11(v: Views) -> DataFrame:
    rows = clip_vectors(v)
    model = lm.fit_mahalanobis(guards.normal_train(rows, ["dev_train"]), ["machine_type"], "near")
    packed = lm.pack_vectors(rows.where(F.col("dataset_split") == "dev_test"), IDENTITY, "vec_idx", "near")
    return rounded(lm.mahalanobis_scores(packed, model, ["machine_type"], IDENTITY))


@query(
    "d12_prototype_distances",
    "dims",
    """WITH p AS (SELECT machine_type, dim, avg(near) FILTER (domain = 'source') AS s, avg(near) FILTER (domain = 'target') AS t FROM dims WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY ALL),
    a AS (SELECT *, 0.2e0 * coalesce(t, s) + 0.8e0 * coalesce(s, t) AS m FROM p)
    SELECT machine_type, vec_id, round(sqrt(sum(pow(near - s, 2))), 6) + 0e0 AS source_distance, round(sqrt(sum(pow(near - t, 2))), 6) + 0e0 AS target_distance, round(sqrt(sum(pow(near - m, 2))), 6) + 0e0 AS adapted_distance
    FROM dims JOIN a USING (machine_type, dim) WHERE dataset_split = 'dev_test' GROUP BY machine_type, vec_id""",
)
def d12(v: Views) -> DataFrame:
    fit = calibration.adapted_prototypes(guards.normal_train(v.dims, ["dev_train"]), ["machine_type"], "near")
    test = v.dims.where(F.col("dataset_split") == "dev_test")
    return rounded(calibration.prototype_distances(test, fit, ["machine_type"], "near", "vec_id"))


@query(
    "d13_knn_scores",
    "dims",
    """WITH g AS (SELECT q.machine_type, q.vec_id, b.vec_id AS other, sqrt(sum(pow(q.near - b.near, 2))) AS dist FROM dims q JOIN dims b USING (machine_type, dim)
      WHERE q.dataset_split = 'dev_test' AND b.dataset_split = 'dev_train' AND b.condition = 'normal' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM g)
    SELECT machine_type, vec_id, round(avg(dist), 5) + 0e0 AS knn_score FROM r WHERE rn <= 5 GROUP BY machine_type, vec_id""",
)
def d13(v: Views) -> DataFrame:
    test = v.vectors.where(F.col("dataset_split") == "dev_test")
    bank = guards.normal_train(v.vectors, ["dev_train"])
    return rounded(calibration.knn_scores(test, bank, ["machine_type"], "vec_id", "near", 5), places=5)


@query(
    "d14_hierarchical_p_values",
    "scores_pair",
    f"""WITH {CAL}, u AS (SELECT machine_type, section, score_candidate AS s, file_id, 0 AS c FROM tst UNION ALL SELECT machine_type, section, score_candidate, NULL, 1 FROM cal),
    w AS (SELECT *, sum(c) OVER (PARTITION BY machine_type, section ORDER BY s DESC) AS a, sum(c) OVER (PARTITION BY machine_type, section) AS n, sum(c) OVER (ORDER BY s DESC) AS pa, sum(c) OVER () AS pn FROM u)
    SELECT file_id, CASE WHEN n >= 410 THEN 'group' ELSE 'pooled' END AS level, round(CASE WHEN n >= 410 THEN (1e0 + a) / (n + 1e0) ELSE (1e0 + pa) / (pn + 1e0) END, 6) + 0e0 AS calibrated_p FROM w WHERE file_id IS NOT NULL""",
)
def d14(v: Views) -> DataFrame:
    p = calibration.hierarchical_p_values(normal_scores(v), v.score_table("candidate"), GROUP, "file_id", 410)
    return rounded(p.select("file_id", "level", "calibrated_p"))
