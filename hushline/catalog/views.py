"""Bridge views: projections of the driver tables with the schemas the operators expect.

Each view exists twice: as a DataFrame for Spark and as SQL text for the independent check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.functions.numeric import d
from hushline.operators.ordered import ordered_positions

SQL = {
    "manifest": """
SELECT concat(machine_type,'/',part,'/section_00_',domain,'_',part,'_',condition,'_',lpad(CAST(clip_no AS VARCHAR(9)),6,'0'),'.wav') AS file_id,
       clip_no, machine_type, 'section_00' AS section, condition, domain,
       concat('dev_',part) AS dataset_split, 16000 AS sample_rate, 2 AS channels
FROM (SELECT s_suppkey AS clip_no,
             concat(r_name, CASE WHEN r_regionkey < 2 THEN '' ELSE 'Emu' END) AS machine_type,
             CASE WHEN s_suppkey % 10 < 6 THEN 'train' ELSE 'test' END AS part,
             CASE WHEN s_suppkey % 2 = 0 THEN 'source' ELSE 'target' END AS domain,
             CASE WHEN s_suppkey % 10 >= 8 THEN 'anomaly' ELSE 'normal' END AS condition
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) q""",
    "clips": """
SELECT l_suppkey AS clip_no,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS t,
       count(*) OVER (PARTITION BY l_suppkey) AS samples,
       l_quantity - 25.5e0 AS near,
       0.5e0 * (l_quantity - 25.5e0) + 100e0 * l_discount - 5e0 AS far
FROM lineitem""",
    "scores_pair": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS file_id,
       concat('M', substr(o_orderpriority,1,1), CASE WHEN substr(o_orderpriority,1,1) >= '3' THEN 'Emu' ELSE '' END) AS machine_type,
       concat('section_0', CAST(o_custkey % 2 AS VARCHAR(1))) AS section,
       CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'target' END AS domain,
       CASE WHEN o_orderstatus = 'F' THEN 'anomaly' ELSE 'normal' END AS condition,
       CASE WHEN o_orderkey % 5 < 2 AND o_orderstatus <> 'F' THEN 'dev_train' ELSE 'dev_test' END AS dataset_split,
       CAST(floor(o_totalprice / 5000e0) AS DOUBLE) AS score_reference,
       round(coalesce(rev, 0e0) / 1000e0, 3) AS score_candidate
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1e0 - l_discount)) AS rev FROM lineitem GROUP BY l_orderkey) r
  ON o_orderkey = l_orderkey""",
    "vectors": """
SELECT a.vec_id, concat('L', CAST(a.label AS VARCHAR(4))) AS machine_type, 'section_00' AS section,
       CASE WHEN a.vec_id % 2 = 0 THEN 'source' ELSE 'target' END AS domain,
       CASE WHEN a.vec_id % 5 < 3 THEN 'dev_train' ELSE 'dev_test' END AS dataset_split,
       CASE WHEN a.vec_id % 5 = 4 THEN 'anomaly' ELSE 'normal' END AS condition,
       a.embedding AS near, b.embedding AS neighbour,
       (a.vec_id % 11) / 10e0 AS reliability
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
    "dims": """
SELECT vec_id, machine_type, section, domain, dataset_split, condition, reliability, i - 1 AS dim,
       CAST(near[i] AS DOUBLE) AS near,
       0.8e0 * CAST(near[i] AS DOUBLE) + 0.2e0 * CAST(neighbour[i] AS DOUBLE) AS residual
FROM vectors, unnest(range(1, len(near) + 1)) u(i)""",
    "cases": """
SELECT event_id AS case_id, value / 500e0 AS risk_score,
       CAST(json_extract_string(props,'$.k') AS DOUBLE) / 10e0 AS estimated_noise_reduction_db,
       (event_id * 7919) % 1000 >= value * 2e0 AS is_safe,
       least(1e0, value / 500e0 * (0.5e0 + ((event_id * 31) % 100) / 100e0)) AS anomaly_loss
FROM events""",
    "event_scores": """
SELECT event_id, user_id AS stream_id, ts, value AS score, event_type = 'error' AS is_anomaly FROM events""",
}

# Views built on other views, in the order they must be declared.
NEEDS = {"dims": ("vectors",)}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views (space separated) declared in front of ``body``."""
    ordered: list[str] = []
    for name in names.split():
        for needed in (*NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    heads = [f"{n} AS ({SQL[n]}\n)" for n in ordered]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        recursive = "RECURSIVE " if body[:10].upper() == "RECURSIVE " else ""
        body = body[len(recursive) :]
        return f"WITH {recursive}" + ",\n".join([*heads, body])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


class Views:
    """Driver tables and bridge views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def manifest(self) -> DataFrame:
        part = F.when(F.col("s_suppkey") % 10 < 6, "train").otherwise("test")
        base = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("clip_no"),
                F.concat("r_name", F.when(F.col("r_regionkey") < 2, "").otherwise("Emu")).alias("machine_type"),
                part.alias("part"),
                F.when(F.col("s_suppkey") % 2 == 0, "source").otherwise("target").alias("domain"),
                F.when(F.col("s_suppkey") % 10 >= 8, "anomaly").otherwise("normal").alias("condition"),
            )
        )
        return base.select(
            F.concat(
                "machine_type", F.lit("/"), "part", F.lit("/section_00_"), "domain", F.lit("_"), "part",
                F.lit("_"), "condition", F.lit("_"), F.lpad(F.col("clip_no").cast("string"), 6, "0"),
                F.lit(".wav"),
            ).alias("file_id"),
            "clip_no",
            "machine_type",
            F.lit("section_00").alias("section"),
            "condition",
            "domain",
            F.concat(F.lit("dev_"), "part").alias("dataset_split"),
            F.lit(16000).alias("sample_rate"),
            F.lit(2).alias("channels"),
        )

    @cached_property
    def clips(self) -> DataFrame:
        """Stereo samples in long form; the ship date is the coarse key of the sample order."""
        raw = self.table("lineitem").select(
            F.col("l_suppkey").alias("clip_no"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
            "l_quantity", "l_discount",
        )
        placed = ordered_positions(
            raw, ["clip_no"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey"], "t"
        )
        near = F.col("l_quantity") - d(25.5)
        return placed.select(
            "clip_no", "t", F.col("t_count").alias("samples"), near.alias("near"),
            (d(0.5) * near + d(100.0) * F.col("l_discount") - d(5.0)).alias("far"),
        )

    @cached_property
    def scores_pair(self) -> DataFrame:
        revenue = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum(F.col("l_extendedprice") * (d(1.0) - F.col("l_discount"))).alias("rev"))
        )
        priority = F.substring("o_orderpriority", 1, 1)
        return (
            self.table("orders")
            .join(revenue, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").cast("string").alias("file_id"),
                F.concat(F.lit("M"), priority, F.when(priority >= "3", "Emu").otherwise("")).alias("machine_type"),
                F.concat(F.lit("section_0"), (F.col("o_custkey") % 2).cast("string")).alias("section"),
                F.when(F.col("o_orderkey") % 2 == 0, "source").otherwise("target").alias("domain"),
                F.when(F.col("o_orderstatus") == "F", "anomaly").otherwise("normal").alias("condition"),
                F.when((F.col("o_orderkey") % 5 < 2) & (F.col("o_orderstatus") != "F"), "dev_train")
                .otherwise("dev_test")
                .alias("dataset_split"),
                F.floor(F.col("o_totalprice") / d(5000.0)).cast("double").alias("score_reference"),
                F.round(F.coalesce("rev", d(0.0)) / d(1000.0), 3).alias("score_candidate"),
            )
        )

    def score_table(self, which: str = "reference", split: str = "dev_test") -> DataFrame:
        """One side of ``scores_pair`` in the score-table schema."""
        return self.scores_pair.where(F.col("dataset_split") == split).select(
            "file_id", "machine_type", "section", "domain", "condition",
            F.col(f"score_{which}").alias("anomaly_score"),
            F.lit(f"fixture_{which}").alias("model_id"),
            F.lit("fixture").alias("experiment_id"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        a = self.table("embeddings")
        count = a.agg(F.count("*").alias("n"))
        following = a.select(
            F.col("vec_id").alias("next_id"), F.col("embedding").alias("neighbour")
        )
        keyed = a.withColumn("next_id", (F.col("vec_id") + 1) % count.scalar())
        return keyed.join(following, "next_id").select(
            "vec_id",
            F.concat(F.lit("L"), F.col("label").cast("string")).alias("machine_type"),
            F.lit("section_00").alias("section"),
            F.when(F.col("vec_id") % 2 == 0, "source").otherwise("target").alias("domain"),
            F.when(F.col("vec_id") % 5 < 3, "dev_train").otherwise("dev_test").alias("dataset_split"),
            F.when(F.col("vec_id") % 5 == 4, "anomaly").otherwise("normal").alias("condition"),
            F.col("embedding").alias("near"),
            "neighbour",
            ((F.col("vec_id") % 11) / d(10.0)).alias("reliability"),
        )

    @cached_property
    def vector_pairs(self) -> DataFrame:
        """Near and residual vectors as double arrays; residual = 0.8 near + 0.2 neighbour."""
        wide = self.vectors.withColumn("near", F.col("near").cast("array<double>"))
        wide = wide.withColumn("neighbour", F.col("neighbour").cast("array<double>"))
        mixed = F.zip_with("near", "neighbour", lambda x, y: d(0.8) * x + d(0.2) * y)
        return wide.withColumn("residual", mixed).drop("neighbour")

    @cached_property
    def dims(self) -> DataFrame:
        keys = ["vec_id", "machine_type", "section", "domain", "dataset_split", "condition", "reliability"]
        return self.vector_pairs.select(
            *keys, F.posexplode(F.arrays_zip("near", "residual")).alias("dim", "v")
        ).select(*keys, F.col("dim").cast("bigint").alias("dim"), "v.near", "v.residual")

    @cached_property
    def cases(self) -> DataFrame:
        value = F.col("value") / d(500.0)
        return self.table("events").select(
            F.col("event_id").alias("case_id"),
            value.alias("risk_score"),
            (F.get_json_object("props", "$.k").cast("double") / d(10.0)).alias("estimated_noise_reduction_db"),
            ((F.col("event_id") * 7919) % 1000 >= F.col("value") * d(2.0)).alias("is_safe"),
            F.least(
                d(1.0), value * (d(0.5) + ((F.col("event_id") * 31) % 100) / d(100.0))
            ).alias("anomaly_loss"),
        )

    @cached_property
    def event_scores(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("user_id").alias("stream_id"), "ts", F.col("value").alias("score"),
            (F.col("event_type") == "error").alias("is_anomaly"),
        )
