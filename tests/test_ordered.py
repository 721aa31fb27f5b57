import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushline.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.normal(size=6000), 3)})
    cold = pd.DataFrame({"k": rng.choice(list("abc"), 300), "v": np.round(rng.normal(5, 2, 300), 3)})
    frame = pd.concat([hot, cold, pd.DataFrame({"k": ["one"], "v": [7.0]})], ignore_index=True)
    frame["id"] = np.arange(len(frame))
    return frame, spark.createDataFrame(frame).cache()


@pytest.mark.parametrize("accuracy", [10_000, 400])
def test_quantiles_match_numpy_on_both_paths(skewed, accuracy):
    frame, df = skewed
    wanted = {"q01": 0.01, "q50": 0.5, "q99": 0.99, "q100": 1.0, "q0": 0.0}
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", wanted, accuracy).collect()}
    for key, part in frame.groupby("k"):
        for name, q in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(part["v"], q), abs=1e-12), (key, name)


def test_quantiles_of_every_size(spark):
    """Sizes around the sketch's exact one and below it go one way, ties included."""
    rng = np.random.default_rng(8)
    groups = {n: np.round(rng.normal(size=n), 1 if n % 2 else 6) for n in [*range(1, 30), 99, 100, 101, 399, 2500]}
    frame = pd.concat([pd.DataFrame({"k": n, "v": v}) for n, v in groups.items()])
    wanted = {f"q{i}": p for i, p in enumerate((0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.95, 0.99, 1.0))}
    df = spark.createDataFrame(frame).cache()
    for accuracy in (100, 10_000):
        got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", wanted, accuracy).collect()}
        for n, values in groups.items():
            for name, q in wanted.items():
                assert got[n][name] == pytest.approx(np.quantile(values, q), abs=1e-12), (n, name, accuracy)


def test_a_missed_rank_fails(skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda v, grid, accuracy: F.array(*[F.max(v) for _ in grid]))
    with pytest.raises(Exception, match="outside its sketch's bracket"):
        ordered.quantiles(df, ["k"], "v", {"m": 0.5}).collect()


def test_sized_quantiles_split_by_size(skewed):
    frame, df = skewed
    sizes = df.groupBy("k").agg(F.count("*").alias("size"))
    rows = df.join(sizes, "k")
    got = {r["k"]: r["m"] for r in ordered.sized_quantiles(rows, ["k"], "v", {"m": 0.3}, F.col("size"), 500).collect()}
    for key, part in frame.groupby("k"):
        assert got[key] == pytest.approx(np.quantile(part["v"], 0.3), abs=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(skewed, descending):
    frame, df = skewed
    cells = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    run = ordered.running_sums(cells, ["k"], "v", {"n": F.col("n")}, descending).toPandas()
    for key, part in run.groupby("k"):
        part = part.sort_values("v", ascending=not descending)
        assert (part["n_before"].to_numpy() == part["n"].cumsum().to_numpy() - part["n"].to_numpy()).all()
        assert (part["n_total"] == (frame["k"] == key).sum()).all()


def test_running_sums_without_keys(skewed):
    frame, df = skewed
    run = ordered.running_sums(df, [], "id", {"n": F.lit(1).cast("bigint")}).toPandas()
    assert (run["n_before"] == run["id"]).all() and (run["n_total"] == len(frame)).all()


def test_hashed_positions_are_dense_and_repeatable(skewed):
    frame, df = skewed
    one = ordered.hashed_positions(df, ["k"], F.col("id")).toPandas()
    two = ordered.hashed_positions(df.repartition(5), ["k"], F.col("id")).toPandas()
    for key, part in one.groupby("k"):
        assert sorted(part["pos"]) == list(range(len(part)))
        assert (part["pos_count"] == len(part)).all()
    assert one.sort_values("id")["pos"].tolist() == two.sort_values("id")["pos"].tolist()
