import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushline.operators import calibration, guards, policy
from hushline.operators import linear_model as lm
from hushline.operators.reference_model import fit_normaliser, normalise


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 80), ("b", 40)):
        basis = rng.normal(size=(3, 12))
        for i in range(n):
            rows.append((g, f"{g}{i // 4}", i % 4, "normal" if i % 4 else "anomaly", (rng.normal(size=3) @ basis + 0.1 * rng.normal(size=12)).tolist()))
    frame = pd.DataFrame(rows, columns=["g", "clip", "i", "condition", "x"])
    return frame, spark.createDataFrame(frame).repartition(6).cache()


def test_subspace_scores_match_numpy(vectors):
    frame, df = vectors
    model = lm.fit_subspace(df.where("condition = 'normal'"), ["g"], "x", 3)
    packed = lm.pack_vectors(df, ["g", "clip"], "i", "x", 3)
    got = {r["clip"]: r["anomaly_score"] for r in lm.reconstruction_scores(packed, model, ["g"], ["clip"], target=5).collect()}
    for g, part in frame.groupby("g"):
        train = np.stack(part[part["condition"] == "normal"]["x"])
        mean = train.mean(0)
        _, _, vt = np.linalg.svd(train - mean, full_matrices=False)
        for clip, rows in part.groupby("clip"):
            x = np.stack(rows["x"]) - mean
            missed = (x - x @ vt[:3].T @ vt[:3])[:, :5]
            assert got[clip] == pytest.approx(np.mean(missed**2), rel=1e-8)


def test_one_group_is_spread_over_tasks(spark):
    """With one machine, neither the normaliser nor the scorer may read all its rows in one task."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(400).select(F.lit("m").alias("g"), F.col("id").alias("clip"), (F.col("id") % 7).cast("double").alias("near"))
        fit = fit_normaliser(rows, ["g"], ["near"])
        scaled = normalise(rows, fit, ["g"], ["near"])
        assert scaled.select(F.spark_partition_id()).distinct().count() > 1
        assert scaled.agg(F.count("*"), F.round(F.avg("near"), 9)).first()[:] == (400, 0.0)
        pairs = rows.select("g", "clip", F.array("near", F.lit(1.0)).alias("flat"))
        model = spark.createDataFrame([("m", [0.0, 0.0], [1.0, 0.0])], "g string, mean array<double>, components array<double>")
        plan = lm.reconstruction_scores(pairs, model, ["g"], ["clip"])
        assert {r["anomaly_score"] for r in plan.collect()} == {0.5} and plan.count() == 400
        assert "_slice" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_anomaly_rows_never_reach_a_fit(vectors, spark):
    frame, df = vectors
    tagged = df.withColumn("dataset_split", F.lit("dev_train"))
    louder = tagged.withColumn("x", F.when(F.col("condition") == "anomaly", F.transform("x", lambda v: v * 1000)).otherwise(F.col("x")))
    fit = lambda d: lm.fit_subspace(guards.normal_train(d), ["g"], "x", 3).orderBy("g").toPandas()
    np.testing.assert_allclose(np.stack(fit(tagged)["mean"]), np.stack(fit(louder)["mean"]), rtol=1e-12)


def test_mahalanobis_matches_numpy_and_survives_singular_covariance(vectors, spark):
    frame, df = vectors
    model = lm.fit_mahalanobis(df, ["g"], "x", 0.2)
    got = {r["clip"]: r["anomaly_score"] for r in lm.mahalanobis_scores(lm.pack_vectors(df, ["g", "clip"], "i", "x"), model, ["g"], ["clip"]).collect()}
    part = frame[frame["g"] == "a"]
    x = np.stack(part["x"])
    cov = np.cov(x.T, bias=True)
    shrunk = 0.8 * cov + 0.2 * np.trace(cov) / 12 * np.eye(12)
    c = np.stack(part[part["clip"] == "a0"]["x"]) - x.mean(0)
    assert got["a0"] == pytest.approx(np.mean(np.sum(c @ np.linalg.inv(shrunk) * c, 1)), rel=1e-8)
    flat = spark.createDataFrame([("z", "c", 0, [1.0, 2.0])] * 3, "g string, clip string, i int, x array<double>")
    score = lm.mahalanobis_scores(lm.pack_vectors(flat, ["g", "clip"], "i", "x"), lm.fit_mahalanobis(flat, ["g"], "x"), ["g"], ["clip"]).first()
    assert np.isfinite(score["anomaly_score"])


def test_held_out_share(vectors):
    _, df = vectors
    token = df.withColumn("token", F.concat("clip", F.col("i").cast("string")))
    kept = {r["g"]: r["n"] for r in lm.held_out_split(token, ["g"], "token", 1).where("kept").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 72, "b": 36}


def test_knn_is_exact_over_small_blocks(vectors):
    frame, df = vectors
    ids = df.withColumn("id", F.concat("clip", F.lit("#"), F.col("i").cast("string")))
    queries, bank = ids.where("condition = 'anomaly'"), ids.where("condition = 'normal'")
    got = {r["id"]: r["knn_score"] for r in calibration.knn_scores(queries, bank, ["g"], "id", "x", 4, 7, 5).collect()}
    assert len(got) == queries.count()
    for row in queries.collect():
        others = np.stack(frame[(frame["g"] == row["g"]) & (frame["condition"] == "normal")]["x"])
        dist = np.sort(np.linalg.norm(others - np.array(row["x"]), axis=1))[:4]
        assert got[row["id"]] == pytest.approx(dist.mean(), rel=1e-9)


def test_conformal_and_hierarchical(spark):
    cal = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], ["g", "anomaly_score"])
    new = spark.createDataFrame([("x", "a", 2.0), ("y", "a", 9.0), ("z", "b", 4.0), ("w", "c", 1.0)], ["id", "g", "anomaly_score"])
    p = {r["id"]: r for r in calibration.hierarchical_p_values(cal, new, ["g"], "id", 2).collect()}
    assert p["x"]["p_value"] == 0.75 and p["y"]["p_value"] == 0.25 and p["w"]["p_value"] == 1.0
    assert p["z"]["level"] == "pooled" and p["z"]["calibrated_p"] == pytest.approx(2 / 5)


def brute_policy(frame, step=5):
    """Every candidate pair against every case."""
    best = None
    z = 1.959963984540054
    for r in np.unique(np.percentile(frame["risk_score"], np.arange(step, 100, step))):
        for b in np.unique(np.percentile(frame["estimated_noise_reduction_db"], np.arange(step, 100, step))):
            ok = (frame["risk_score"] <= r) & (frame["estimated_noise_reduction_db"] >= b)
            n, bad = int(ok.sum()), int((ok & ~frame["is_safe"]).sum())
            p = bad / max(n, 1)
            up = 1.0 if not n else min(1.0, (p + z * z / (2 * n) + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))
            feasible, cover = n > 0 and p <= 0.05 and up <= 0.10, n / len(frame)
            key = (feasible, cover, -up, -p, -r, b) if feasible else (feasible, -up, cover, -p, -r, b)
            best = max(best, (key, r, b)) if best else (key, r, b)
    return best


@pytest.mark.parametrize("safe_share", [0.5, 0.0])
def test_policy_matches_brute_force(spark, safe_share):
    n = 100
    frame = pd.DataFrame({"case_id": np.arange(n), "risk_score": np.linspace(0, 1, n), "estimated_noise_reduction_db": np.linspace(3, 0, n),
                          "is_safe": np.arange(n) < safe_share * n, "anomaly_loss": np.linspace(0, 1, n)})
    df = spark.createDataFrame(frame)
    row = policy.calibrate(df).first()
    key, risk, benefit = brute_policy(frame)
    assert (row["feasible"], row["risk_max"], row["benefit_min_db"]) == (key[0], pytest.approx(risk), pytest.approx(benefit))
    metrics = policy.evaluate(df, policy.calibrate(df)).first()
    assert metrics["safe_prevalence"] == safe_share and metrics["risk_spearman"] == pytest.approx(1.0)


def test_constant_risk_gives_zero_correlation(spark):
    df = spark.createDataFrame([(0.5, 1.0, True, float(i)) for i in range(10)], ["risk_score", "estimated_noise_reduction_db", "is_safe", "anomaly_loss"])
    fixed = spark.createDataFrame([(0.1, 0.0)], ["risk_max", "benefit_min_db"])
    row = policy.evaluate(df, fixed).first()
    assert (row["risk_spearman"], row["accepted"], row["false_safe_upper_ci"], row["false_safe_rate"]) == (0.0, 0, 1.0, 0.0)
