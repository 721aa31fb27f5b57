import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushline.functions.numeric import student_t_two_sided
from hushline.operators import bootstrap, correlation, joins, roc, summaries
from hushline.schemas import GROUP


def table(spark, scores, labels, **extra):
    frame = pd.DataFrame({"anomaly_score": np.asarray(scores, float), "condition": ["anomaly" if x else "normal" for x in labels]})
    frame["file_id"] = [f"f{i}" for i in range(len(frame))]
    frame["machine_type"], frame["section"], frame["domain"] = "M", "section_00", "source"
    return spark.createDataFrame(frame.assign(**extra))


def brute(scores, labels, max_fpr=0.1):
    """AUC by pair counting with half ties, pAUC by a dense polygon."""
    s, y = np.asarray(scores, float), np.asarray(labels)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    levels = np.unique(s)[::-1]
    fpr = np.r_[0, [np.mean(neg >= t) for t in levels]]
    tpr = np.r_[0, [np.mean(pos >= t) for t in levels]]
    inside = fpr <= max_fpr
    x, t = np.r_[fpr[inside], max_fpr], np.r_[tpr[inside], np.interp(max_fpr, fpr, tpr)]
    low = 0.5 * max_fpr**2
    return auc, 0.5 * (1 + (np.trapezoid(t, x) - low) / (max_fpr - low))


@pytest.mark.parametrize("seed", range(3))
def test_areas_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.normal(size=200) + 0.7 * y, 1)
    got = roc.roc_areas(table(spark, s, y), GROUP).first()
    auc, pauc = brute(s, y)
    assert got["auc"] == pytest.approx(auc, abs=1e-12)
    assert got["pauc"] == pytest.approx(pauc, abs=1e-12)


def test_separable_scores_give_one_and_single_class_gives_null(spark):
    df = table(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], domain=["source", "target", "source", "target"])
    row = roc.metric_table(df).first()
    assert row["auc_all"] == row["auc_source"] == row["auc_target"] == 1.0
    only = roc.roc_areas(table(spark, [1, 2, 3], [0, 0, 0]), GROUP).first()
    assert only["auc"] is None and only["pauc"] is None


def test_weights_equal_repeated_rows(spark):
    s, y, w = [1.0, 2.0, 2.0, 3.0, 4.0], [0, 0, 1, 0, 1], [3, 1, 2, 2, 1]
    weighted = table(spark, s, y).withColumn("w", F.element_at(F.array(*map(F.lit, w)), F.expr("int(substr(file_id, 2)) + 1")))
    got = roc.roc_areas(weighted, GROUP, weight=F.col("w")).first()
    auc, pauc = brute(np.repeat(s, w), np.repeat(y, w))
    assert (got["auc"], got["pauc"]) == (pytest.approx(auc), pytest.approx(pauc))


def test_bootstrap_is_repeatable_and_brackets_the_delta(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 120)
    paired = joins.paired_scores(
        table(spark, rng.normal(size=120), y), table(spark, rng.normal(size=120) + 2.0 * y, y)
    )
    one = {r["metric"]: r for r in bootstrap.paired_bootstrap(paired, 100, 7).collect()}
    two = {r["metric"]: r for r in bootstrap.paired_bootstrap(paired.repartition(3), 100, 7).collect()}
    for metric in one:
        assert one[metric]["mean"] == pytest.approx(two[metric]["mean"], abs=1e-12)
    assert one["auc_delta"]["ci95_low"] > 0.2 and one["auc_delta"]["iterations"] == 100
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(paired, 10)


def test_draws_keep_stratum_sizes(spark):
    df = table(spark, range(50), [i % 3 == 0 for i in range(50)])
    from hushline.operators.ordered import hashed_positions

    placed = hashed_positions(df, bootstrap.STRATUM, F.col("file_id"))
    counts = {}
    for row in bootstrap.weights(placed, 5, 1).collect():
        counts[row["condition"]] = counts.get(row["condition"], 0) + np.frombuffer(row["weights"], np.uint8).astype(int)
    assert {c: n.tolist() for c, n in counts.items()} == {"anomaly": [17] * 5, "normal": [33] * 5}


@pytest.mark.parametrize("targets,rows", [(1024, 256), (8, 3)])
def test_resampled_areas_match_weighted_curves(spark, targets, rows):
    """Blocks and slices of any size, ties across slices, and a group without anomalies."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 90)
    sides = [table(spark, np.round(rng.normal(size=90) + shift * y, 1), y) for shift in (0.0, 1.0)]
    lone = [s.where("condition = 'normal'").withColumn("machine_type", F.lit("lone")).withColumn("file_id", F.concat(F.lit("l"), "file_id")) for s in sides]
    paired = joins.paired_scores(*[s.unionByName(x) for s, x in zip(sides, lone)]).cache()
    got = {(r["iteration"], r["side"], r["machine_type"]): (r["auc"], r["pauc"]) for r in bootstrap.resampled_areas(paired, 7, 3, targets=targets, size=rows).collect()}
    from hushline.operators.ordered import hashed_positions

    placed = hashed_positions(paired, bootstrap.STRATUM, F.col("file_id"))
    drawn = bootstrap.weights(placed, 7, 3).join(placed, [*bootstrap.STRATUM, "pos"]).collect()
    assert len(got) == 7 * 2 * 2
    for (i, side, machine), areas in got.items():
        mine = [r for r in drawn if r["machine_type"] == machine]
        w = [np.frombuffer(r["weights"], np.uint8)[i - 1] for r in mine]
        s, label = ([r[c] for r in mine] for c in (f"anomaly_score_{side}", "condition"))
        if machine == "lone":
            assert areas == (None, None)
        else:
            assert areas == pytest.approx(brute(np.repeat(s, w), np.repeat([c == "anomaly" for c in label], w)))


def test_ensemble_requires_full_coverage(spark):
    df = table(spark, [1.0, 2.0], [0, 1])
    df = df.withColumn("model_id", F.lit("one"))
    other = df.withColumn("anomaly_score", F.col("anomaly_score") * 3).withColumn("model_id", F.lit("other"))
    mean = summaries.seed_ensemble(df.unionByName(other), 2, "m", "e")
    assert sorted(r["anomaly_score"] for r in mean.collect()) == [2.0, 4.0]
    with pytest.raises(Exception, match="do not cover"):
        summaries.seed_ensemble(df.unionByName(df.limit(1)), 2, "m", "e").collect()


def test_spearman_ties_and_constant(spark):
    frame = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 3, "x": [1, 2, 2, 3, 9, 1, 1, 1], "y": [2, 1, 4, 4, 5, 1, 2, 3]})
    got = {r["g"]: r["spearman_rho"] for r in correlation.spearman(spark.createDataFrame(frame), ["g"], "x", "y").collect()}
    ranks = frame[frame["g"] == "a"][["x", "y"]].rank()
    assert got["a"] == pytest.approx(ranks.corr().iloc[0, 1]) and got["b"] is None


def test_two_sided_p_values():
    # Student t with 8 degrees of freedom at t = 2.306 has p = 0.05.
    rho = 2.306004 / np.sqrt(8 + 2.306004**2)
    assert student_t_two_sided(rho, 10) == pytest.approx(0.05, abs=1e-6)
    assert student_t_two_sided(0.0, 10) == pytest.approx(1.0)
    assert student_t_two_sided(1.0, 10) == 0.0 and np.isnan(student_t_two_sided(0.3, 2))


def test_displacement_and_deltas_by_hand(spark):
    rows = [("a", [2.0] * 4, [1.0] * 4), ("b", [4.0] * 4, [3.0] * 4)]
    got = {r["file_id"]: r for r in correlation.displacement(spark.createDataFrame(rows, "file_id string, near array<double>, residual array<double>"), ["file_id"]).collect()}
    assert got["a"]["residual_minus_near"] == got["b"]["residual_minus_near"] == -1.0
    assert got["a"]["near_mean"] == 2.0 and got["b"]["shift_l1"] == 1.0


def test_gate_counts_and_margins(spark):
    def metric(system, machine, value):
        return (system, machine, "section_00", value, value, value, value, value, value)

    rows = [metric("near", m, 0.6) for m in "ABC"]
    rows += [metric("unconditional_refsub", m, x) for m, x in zip("ABC", (0.5, 0.58, 0.7))]
    rows += [metric("safe_ref", m, x) for m, x in zip("ABC", (0.6, 0.596, 0.7))]
    names = ["system", *GROUP, "auc_all", "auc_source", "auc_target", "pauc_all", "pauc_source", "pauc_target"]
    decisions = spark.createDataFrame([("A", "section_00", "near"), ("B", "section_00", "refsub"), ("C", "section_00", "refsub")], [*GROUP, "decision"])
    row = summaries.development_gate(spark.createDataFrame(rows, names), decisions).first()
    assert (row["unconditional_harm_events"], row["safe_ref_harm_events"], row["harm_reduction"]) == (2, 0, 1.0)
    assert row["minimum_machine_delta"] == pytest.approx(-0.004) and row["passed"]
    assert (row["accepted_groups"], row["rejected_groups"]) == (2, 1)


def test_latency_uses_the_ceiling_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], ["ms"])
    row = summaries.latency_summary(df, [], "ms").first()
    assert (row["p50"], row["p95"], row["p99"], row["ordered"]) == (6.0, 11.0, 11.0, True)


def test_bootstrap_weights_equal_single_draws_and_stay_small(spark):
    """Counts against the md5 of every counter text, hot strata cut by positions, at under three bits a count."""
    import hashlib

    from hushline.operators.ordered import hashed_positions

    df = table(spark, range(1300), [i < 3 for i in range(1300)])
    placed = hashed_positions(df, bootstrap.STRATUM, F.col("file_id")).select(*bootstrap.STRATUM, "pos", "pos_count").cache()
    want = {}
    for condition, n in (("anomaly", 3), ("normal", 1297)):
        for i in range(40):
            for pos in range(n):
                digest = hashlib.md5(f"5|{i + 1}|M|section_00|{condition}|{pos}".encode()).digest()
                key = condition, int.from_bytes(digest[:4], "big") % n
                want.setdefault(key, [0] * 40)[i] += 1
    for positions in (bootstrap.POSITIONS, 600):
        got = bootstrap.weighted(placed, 40, 5, targets=128, positions=positions).collect()
        assert {(r["condition"], r["pos"]): list(bootstrap.inflated(r["weights"])) for r in got} == want
    long = bootstrap.weighted(placed, 2000, 5).collect()
    assert sum(len(r["weights"]) for r in long) < 1300 * 2000 * 3 / 8
