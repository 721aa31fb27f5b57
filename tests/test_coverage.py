"""Rows without a partner fail the job instead of vanishing."""

import pytest
from pyspark.sql import functions as F

from hushline.operators import calibration, joins, linear_model, one_to_one, reference_model, summaries
from hushline.plans import failure_analysis
from hushline.schemas import IDENTITY


def scores(spark, files, model="m"):
    rows = [(f, "M0", "section_00", "source", "normal", float(i), model, "e") for i, f in enumerate(files)]
    names = "file_id string, machine_type string, section string, domain string, condition string"
    return spark.createDataFrame(rows, f"{names}, anomaly_score double, model_id string, experiment_id string")


def test_paired_scores(spark):
    assert joins.paired_scores(scores(spark, "ab"), scores(spark, "ab")).count() == 2
    for left, right in (("ab", "a"), ("a", "ab")):
        with pytest.raises(Exception, match="score for b"):
            joins.paired_scores(scores(spark, left), scores(spark, right)).collect()


def test_repeated_keys_and_other_identities(spark):
    two = scores(spark, "ab")
    with pytest.raises(Exception, match="Repeated candidate score for b"):
        joins.paired_scores(two, two.unionByName(two.where("file_id = 'b'"))).count()
    with pytest.raises(Exception, match="describe differently b"):
        joins.paired_scores(two, two.withColumn("domain", F.when(F.col("file_id") == "b", "target").otherwise("source"))).count()
    i = index(spark, "ab")
    for sides in ((i, i.unionByName(i), two, two), (i, i, two.unionByName(two), two)):
        with pytest.raises(Exception, match="Repeated r"):
            joins.paired_indexes(*sides).count()
    with pytest.raises(Exception, match="No near features for c"):  # a score that no index knows
        joins.paired_indexes(i, i, two, scores(spark, "abc")).count()
    half = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("b", 0.5)], "file_id string, reliability double")
    with pytest.raises(Exception, match="Repeated reliability for b"):
        joins.gated_inputs(i, i, half).count()
    with pytest.raises(Exception, match="No near features for c"):
        joins.gated_inputs(i, i, half.dropDuplicates().unionByName(spark.createDataFrame([("c", 0.1)], half.schema))).count()


def test_faults_name_every_side(spark):
    left, right = scores(spark, "abc").select("file_id"), scores(spark, "bccd").select("file_id")
    null = spark.createDataFrame([(None,)], "file_id string")
    got = {tuple(r) for r in one_to_one.faults({"left": left.unionByName(null), "right": right}, ["file_id"]).collect()}
    assert got == {("a", "right", "missing", 0), ("c", "right", "repeated", 2), ("d", "left", "missing", 0), (None, "right", "missing", 0)}
    with pytest.raises(ValueError, match="share value columns"):
        one_to_one.gathered({"left": scores(spark, "a"), "right": scores(spark, "a")}, ["file_id"])


def test_failure_analysis_needs_vectors(spark):
    two = scores(spark, "ab")
    vectors = spark.createDataFrame([("a", [1.0, 2.0], [1.0, 3.0])], "file_id string, near array<double>, residual array<double>")
    with pytest.raises(Exception, match="No vectors for b"):
        failure_analysis.analyse(vectors, two, two).per_clip.collect()


def test_decisions_and_thresholds(spark):
    views = scores(spark, "a").withColumn("near_score", F.lit(1.0)).withColumn("refsub_score", F.lit(2.0)).drop("anomaly_score")
    other = spark.createDataFrame([("M1", "section_00", "near", 0.5)], "machine_type string, section string, decision string, threshold double")
    with pytest.raises(Exception, match="No decision for M0 section_00"):
        joins.system_scores(views, other).collect()
    with pytest.raises(Exception, match="No threshold for M0 section_00"):
        joins.apply_thresholds(scores(spark, "a"), other).collect()


def index(spark, files, count=2, split="dev_test"):
    return scores(spark, files).select(*IDENTITY, F.lit(split).alias("dataset_split"), F.lit(count).cast("long").alias("vector_count"))


def test_feature_indexes(spark):
    s = scores(spark, "ab")
    assert joins.paired_indexes(index(spark, "ab"), index(spark, "ab"), s, s).count() == 2
    with pytest.raises(Exception, match="No residual features for b"):
        joins.paired_indexes(index(spark, "ab"), index(spark, "a"), s, s).collect()
    with pytest.raises(Exception, match="Unequal vector counts for"):
        joins.paired_indexes(index(spark, "ab"), index(spark, "ab", 3), s, s).collect()
    with pytest.raises(Exception, match="No candidate score for b"):
        joins.paired_indexes(index(spark, "ab"), index(spark, "ab"), s, scores(spark, "a")).collect()


def test_gated_inputs(spark):
    reliability = spark.createDataFrame([("a", 0.5), ("b", 1.5)], "file_id string, reliability double")
    with pytest.raises(Exception, match="Reliability outside"):
        joins.gated_inputs(index(spark, "ab"), index(spark, "ab"), reliability).collect()
    with pytest.raises(Exception, match="No reliability for b"):
        joins.gated_inputs(index(spark, "ab"), index(spark, "ab"), reliability.where("reliability < 1")).collect()
    with pytest.raises(Exception, match="No near features for b"):
        joins.gated_inputs(index(spark, "a"), index(spark, "ab"), reliability).collect()


def test_models(spark):
    rows = spark.createDataFrame([("M0", "a", "v", 1.0, [1.0, 2.0]), ("M1", "b", "v", 1.0, [1.0, 2.0])], "machine_type string, file_id string, view string, x double, flat array<double>")
    model = reference_model.fit_reference(rows.where("machine_type = 'M0'"), ["machine_type"], ["x"])
    with pytest.raises(Exception, match="No reference model for M1"):
        reference_model.reference_scores(rows, model, ["machine_type"], ["x"], ["file_id"]).collect()
    linear = spark.createDataFrame([("M0", [0.0, 0.0], [1.0, 0.0])], "machine_type string, mean array<double>, components array<double>")
    with pytest.raises(Exception, match="No linear model for M1"):
        linear_model.reconstruction_scores(rows, linear, ["machine_type"], ["file_id"]).collect()


def test_every_seed_once(spark):
    one, two = scores(spark, "ab", "1"), scores(spark, "ab", "2")
    assert summaries.seed_ensemble(one.unionByName(two), 2, "m", "e").count() == 2
    with pytest.raises(Exception, match="do not cover"):  # twice in one seed, absent from the other
        summaries.seed_ensemble(one.unionByName(one.where("file_id = 'b'")).unionByName(two.where("file_id = 'a'")), 2, "m", "e").collect()


def test_knn_keeps_queries_without_bank(spark):
    rows = spark.createDataFrame([("M0", "a", [0.0, 1.0]), ("M1", "b", [1.0, 1.0])], "g string, id string, x array<double>")
    got = {r["id"]: r["knn_score"] for r in calibration.knn_scores(rows, rows.where("g = 'M0'"), ["g"], "id", "x", 1).collect()}
    assert got["b"] is None and got["a"] == 0.0
