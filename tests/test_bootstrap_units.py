import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushline import session
from hushline.operators import bootstrap


def paired(spark, n, groups=("a", "b"), digits=1, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for group in groups:
        for i in range(n):
            bad = i % 3 == 0 and group != "lone"
            rows.append((f"{group}{i}", group, "section_00", "anomaly" if bad else "normal", *np.round(rng.normal(size=2) + bad, digits).tolist()))
    return spark.createDataFrame(
        rows, "file_id string, machine_type string, section string, condition string, anomaly_score_reference double, anomaly_score_candidate double"
    ).repartition(3)


def areas(df, *args, **more):
    return {(r["iteration"], r["side"], r["machine_type"]): (r["auc"], r["pauc"]) for r in bootstrap.resampled_areas(df, *args, **more).collect()}


def test_groups_in_tasks_and_in_ranges_agree(spark, monkeypatch):
    """All groups inside tasks, in units of few resamples and draws; all in value ranges; some here, some there."""
    monkeypatch.setattr(bootstrap, "UNIT", 300)
    df = paired(spark, 90, ("a", "lone")).unionByName(paired(spark, 40, ("b",), digits=6, seed=5))
    inside = areas(df, 9, 3)
    ranges = areas(df, 9, 3, group_rows=0, targets=16, size=5)
    both = areas(df, 9, 3, group_rows=50, targets=16, size=5)
    assert len(inside) == 9 * 2 * 3 and inside.keys() == ranges.keys() == both.keys()
    for key, value in inside.items():
        if key[2] == "lone":
            assert value == ranges[key] == both[key] == (None, None)
        else:
            assert value == pytest.approx(ranges[key], abs=1e-12) and both[key] == pytest.approx(ranges[key], abs=1e-12)


def test_nothing_of_rows_times_resamples_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "new_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    rows, iterations = 4000, 1000
    got = bootstrap.resampled_areas(paired(spark, rows, ("a",), digits=6), iterations, 1).agg(F.count("auc").alias("n")).first()["n"]
    assert got == 2 * iterations
    held = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert held < rows * iterations / 16


def test_step_areas_stop_inside_a_step():
    """Steps of (anomalies, normals): the limit of 0.1 falls into the second step."""
    pos, neg = np.array([1, 1, 2]), np.array([1, 3, 16])
    auc, part = bootstrap.step_areas(pos, neg, 0.1)
    assert auc == pytest.approx((1 * 0.5 + 3 * 1.5 + 16 * 3) / (4 * 20))
    assert part == pytest.approx(0.05 * 0.125 + 0.05 * (0.25 + 0.25 + 0.25 / 3) / 2)
    assert np.isnan(bootstrap.step_areas(pos, 0 * neg, 0.1)).all()
    rank, steps = bootstrap._descending_ranks(np.array([1.0, np.nan, 2.0, np.nan, 2.0, -0.0, 0.0]))
    assert rank.tolist() == [2, 0, 1, 0, 1, 3, 3] and steps == 4
