"""Queries over manifests and score tables: scans, projections, guards, audits, joins, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.catalog.registry import query
from hushline.catalog.scores import METRICS_CTE, round_all, rounded, scored
from hushline.catalog.views import Views
from hushline.functions import numeric as num
from hushline.functions import paths
from hushline.functions.numeric import d
from hushline.operators import guards, joins, one_to_one, selection
from hushline.schemas import GROUP, SCORE_COLUMNS, require_columns
from hushline.session import new_folder, stored
from hushline.sources import score_files, sinks
from hushline.sources import tables as scans

REL = "SELECT *, file_id AS relative_path FROM manifest"


def pathed(v: Views) -> DataFrame:
    return v.manifest.withColumn("relative_path", F.col("file_id"))


# ---- scans -------------------------------------------------------------------------------------


@query(
    "src1_manifest_scan",
    sql="SELECT s_suppkey, s_nationkey, round(s_acctbal, 6) + 0e0 AS s_acctbal FROM supplier",
)
def src1(v: Views) -> DataFrame:
    df = scans.read_table(v.spark, f"{v.sf_dir}/supplier.parquet", ("s_suppkey", "s_nationkey", "s_acctbal"))
    return rounded(df.select("s_suppkey", "s_nationkey", "s_acctbal"))


@query(
    "src5_score_contract",
    "scores_pair",
    """WITH s AS (SELECT * FROM scores_pair WHERE dataset_split = 'dev_test')
    SELECT count(*) AS scores, count(DISTINCT file_id) AS distinct_ids,
           count(*) - count(DISTINCT file_id) AS duplicate_ids,
           CAST(sum(CASE WHEN condition IN ('normal','anomaly') THEN 0 ELSE 1 END) AS BIGINT) AS unknown_labels
    FROM s""",
)
def src5(v: Views) -> DataFrame:
    return scans.score_contract(require_columns(v.score_table(), SCORE_COLUMNS, "score table"))


@query(
    "src6_feature_index",
    "vectors",
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, machine_type, section, domain, condition, dataset_split,
      len(near) AS near_width, len(near) = 64 AS width_ok, CAST(1 AS BIGINT) AS near_vector_count FROM vectors""",
)
def src6(v: Views) -> DataFrame:
    stored = v.vectors.select(F.col("vec_id").cast("string").alias("file_id"), *GROUP, "domain", "condition",
                              "dataset_split", F.col("near").alias("values"))
    index = scans.feature_index(stored, "near", 64)
    return index.withColumnRenamed("width", "near_width")


FAULTY = """fv AS (SELECT vec_id, CASE WHEN vec_id % 83 = 0 THEN 'Near' ELSE 'near' END AS vw, domain, CASE WHEN vec_id % 89 = 0 THEN 63 ELSE len(near) END AS width FROM vectors
    UNION ALL SELECT vec_id, 'refsub', CASE WHEN vec_id % 79 = 0 THEN 'other' ELSE domain END, len(neighbour) FROM vectors WHERE vec_id % 97 <> 0)"""


@query(
    "src6_feature_faults",
    "vectors",
    f"""WITH {FAULTY}, n AS (SELECT CAST(vec_id AS VARCHAR) AS file_id, count(*) FILTER (width <> 64) AS wrong_width, CAST(0 AS BIGINT) AS not_finite,
      count(*) FILTER (vw NOT IN ('near', 'refsub')) AS unknown_view, count(*) FILTER (vw = 'near') AS a, count(*) FILTER (vw = 'refsub') AS b, count(DISTINCT domain) AS told FROM fv GROUP BY vec_id),
    f AS (SELECT file_id, wrong_width, not_finite, unknown_view, CAST(a = 0 AS BIGINT) + CAST(b = 0 AS BIGINT) AS missing_views, abs(a - b) AS uneven_views, CAST(told > 1 AS BIGINT) AS described_twice FROM n)
    SELECT * FROM f WHERE wrong_width + unknown_view + missing_views + uneven_views + described_twice > 0""",
)
def src6_faults(v: Views) -> DataFrame:
    """Faults planted in a feature table of two views: a misnamed view, a short vector, a missing view, a second description."""
    clip = F.col("vec_id").cast("string").alias("file_id")
    planted = lambda n: F.col("vec_id") % n == 0
    near = v.vectors.select(
        clip, F.when(planted(83), "Near").otherwise("near").alias("view"), "domain",
        F.when(planted(89), F.slice("near", 1, 63)).otherwise(F.col("near")).alias("values"),
    )
    refsub = v.vectors.where(~planted(97)).select(
        clip, F.lit("refsub").alias("view"), F.when(planted(79), "other").otherwise(F.col("domain")).alias("domain"), F.col("neighbour").alias("values")
    )
    return scans.feature_faults(near.unionByName(refsub), 64, ("near", "refsub"))


@query(
    "src7_channel_load",
    "dims",
    "SELECT vec_id, dim, " + round_all("residual near") + " FROM dims",
)
def src7(v: Views) -> DataFrame:
    keys = ["vec_id", "dim"]
    return rounded(scans.load_channels(v.dims, keys, ("residual", "near"), available=("near", "residual")))


# ---- projections -------------------------------------------------------------------------------


@query(
    "p01_path_tokens",
    "manifest",
    """WITH t AS (SELECT file_id, string_split(regexp_replace(string_split(file_id,'/')[-1], '\\.[^.]*$', ''), '_') AS tok,
        string_split(file_id,'/')[1] AS machine_type FROM manifest)
    SELECT file_id, machine_type,
      CASE WHEN list_contains(tok,'anomaly') THEN 'anomaly' WHEN list_contains(tok,'normal') THEN 'normal' ELSE 'unknown' END AS condition,
      CASE WHEN list_contains(tok,'source') THEN 'source' WHEN list_contains(tok,'target') THEN 'target' ELSE 'unknown' END AS domain,
      CASE WHEN list_contains(tok,'section') AND list_position(tok,'section') < len(tok)
           THEN concat('section_', tok[list_position(tok,'section') + 1]) ELSE 'unknown' END AS section FROM t""",
)
def p01(v: Views) -> DataFrame:
    parsed = paths.with_clip_metadata(v.manifest.select("file_id"), "file_id", "dev")
    return parsed.drop("dataset_split")


@query(
    "p02_split_labels",
    "manifest",
    """SELECT file_id, CASE WHEN list_contains(string_split(file_id,'/'),'test') THEN 'dev_test' ELSE 'dev_train' END AS dev,
      'add_train' AS additional, 'eval_test' AS evaluation FROM manifest""",
)
def p02(v: Views) -> DataFrame:
    releases = ("dev", "additional", "evaluation")
    return v.manifest.select(
        "file_id", *[paths.dataset_split(F.col("file_id"), r).alias(r) for r in releases]
    )


@query(
    "p03_storage_key",
    "manifest",
    """SELECT file_id, sha256(file_id) AS clip_key, sha256(concat(machine_type,'/',section)) AS group_key FROM manifest""",
)
def p03(v: Views) -> DataFrame:
    return v.manifest.select(
        "file_id",
        paths.storage_key(F.col("file_id")).alias("clip_key"),
        paths.storage_key(F.concat_ws("/", *GROUP)).alias("group_key"),
    )


@query(
    "p04_basename_and_prefix",
    "manifest",
    "SELECT file_id, string_split(file_id,'/')[-1] AS basename, machine_type AS machine FROM manifest",
)
def p04(v: Views) -> DataFrame:
    prefixed = F.concat(F.lit(paths.DATASET_PREFIX), "machine_type")
    return v.manifest.select(
        "file_id",
        paths.basename(F.col("file_id")).alias("basename"),
        paths.strip_dataset_prefix(prefixed).alias("machine"),
    )


@query(
    "p05_machine_category",
    "manifest",
    """WITH c AS (SELECT machine_type, CASE WHEN machine_type LIKE '%Emu' THEN 'emulated' ELSE 'real' END AS cat FROM manifest)
    SELECT category, count(*) AS clips, count(DISTINCT machine_type) AS machines
    FROM (SELECT machine_type, cat AS category FROM c UNION ALL SELECT machine_type, 'all' FROM c) GROUP BY category""",
)
def p05(v: Views) -> DataFrame:
    tagged = selection.with_categories(v.manifest)
    return tagged.groupBy("category").agg(
        F.count("*").alias("clips"), F.countDistinct("machine_type").alias("machines")
    )


@query(
    "p06_ablation_channels",
    "dims",
    """WITH c AS (SELECT vec_id, dim, near, residual AS far, residual - near AS residual FROM dims),
    m AS (SELECT vec_id, dim, near, far, residual, near + far AS coherence, near - far AS log_ratio, near * 2e0 AS phase_sin, far * 2e0 AS phase_cos, near * far AS path_confidence FROM c)
    SELECT ablation, channel, count(*) AS cells, round(sum(value), 6) + 0e0 AS total FROM (
      SELECT 'a00_near' AS ablation, 'near' AS channel, near AS value FROM m
      UNION ALL SELECT 'a01_near_far', channel, value FROM (UNPIVOT m ON near, far INTO NAME channel VALUE value)
      UNION ALL SELECT 'a02_multiview', channel, value FROM (UNPIVOT m ON near, far, residual, coherence, log_ratio, phase_sin, phase_cos, path_confidence INTO NAME channel VALUE value)) GROUP BY ALL""",
)
def p06(v: Views) -> DataFrame:
    near, far = F.col("near"), F.col("residual")
    maps = v.dims.select(
        "vec_id", "dim", "near", far.alias("far"), (far - near).alias("residual"), (near + far).alias("coherence"), (near - far).alias("log_ratio"),
        (near * 2.0).alias("phase_sin"), (far * 2.0).alias("phase_cos"), (near * far).alias("path_confidence"),
    )
    frames = [
        selection.ablation_channels(maps, name, ["vec_id", "dim"])
        .unpivot(["vec_id", "dim"], list(channels), "channel", "value")
        .withColumn("ablation", F.lit(name))
        for name, channels in selection.ABLATIONS.items()
    ]
    stacked = reduce(DataFrame.unionByName, frames)
    return rounded(
        stacked.groupBy("ablation", "channel").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))
    )


@query(
    "p07_time_crop",
    "clips",
    """WITH n AS (SELECT clip_no, t, near, samples FROM clips),
    kept AS (SELECT clip_no, t - (samples - 64) // 2 AS frame, near AS value FROM n
             WHERE samples >= 64 AND t >= (samples - 64) // 2 AND t < (samples - 64) // 2 + 64),
    short AS (SELECT DISTINCT clip_no, samples FROM n WHERE samples < 64)
    SELECT clip_no, frame, round(value, 6) + 0e0 AS value FROM (
      SELECT clip_no, frame, value FROM kept
      UNION ALL SELECT clip_no, t, near FROM n WHERE samples < 64
      UNION ALL SELECT clip_no, i, 0e0 FROM short, unnest(range(samples, 64)) u(i))""",
)
def p07(v: Views) -> DataFrame:
    maps = v.clips.select("clip_no", F.col("t").alias("frame"), F.col("near").alias("value"), "samples")
    return rounded(selection.crop_time(maps, ["clip_no"], "samples", ["value"], 64))


@query(
    "p08_score_rows",
    "scores_pair",
    """SELECT file_id, machine_type, section, domain, condition, round(score_candidate, 6) + 0e0 AS anomaly_score,
      'near_model' AS model_id, 'run_a' AS experiment_id FROM scores_pair""",
)
def p08(v: Views) -> DataFrame:
    return rounded(joins.score_rows(v.scores_pair, F.col("score_candidate"), "near_model", "run_a"))


@query(
    "p09_system_fan_out",
    "scores_pair",
    """WITH dec AS (SELECT DISTINCT machine_type, section, CASE WHEN section = 'section_00' THEN 'refsub' ELSE 'near' END AS decision FROM scores_pair),
    j AS (SELECT s.*, decision FROM scores_pair s JOIN dec USING (machine_type, section))
    SELECT file_id, system, decision, round(anomaly_score, 6) + 0e0 AS anomaly_score FROM (
      SELECT file_id, 'near' AS system, decision, score_reference AS anomaly_score FROM j
      UNION ALL SELECT file_id, 'unconditional_refsub', decision, score_candidate FROM j
      UNION ALL SELECT file_id, 'safe_ref', decision, CASE WHEN decision = 'refsub' THEN score_candidate ELSE score_reference END FROM j)""",
)
def p09(v: Views) -> DataFrame:
    rule = F.when(F.col("section") == "section_00", "refsub").otherwise("near")
    decisions = v.scores_pair.select(*GROUP).distinct().withColumn("decision", rule)
    fan = joins.system_scores(v.scores_pair, decisions, "score_reference", "score_candidate")
    return rounded(fan.select("file_id", "system", "decision", "anomaly_score"))


# ---- filters and guards ------------------------------------------------------------------------


@query(
    "f01_normal_train",
    "manifest",
    "SELECT file_id, dataset_split, condition FROM manifest WHERE dataset_split IN ('dev_train','add_train') AND condition = 'normal'",
)
def f01(v: Views) -> DataFrame:
    return guards.normal_train(v.manifest).select("file_id", "dataset_split", "condition")


@query(
    "f02_release_splits",
    "manifest",
    """SELECT file_id, replace(replace(dataset_split,'dev_train','add_train'),'dev_test','eval_test') AS dataset_split
    FROM manifest WHERE dataset_split IN ('dev_train','dev_test')""",
)
def f02(v: Views) -> DataFrame:
    renamed = v.manifest.replace({"dev_train": "add_train", "dev_test": "eval_test"}, subset=["dataset_split"])
    return guards.test_rows(renamed, ("add_train", "eval_test")).select("file_id", "dataset_split")


@query(
    "f03_leakage_guard",
    "manifest",
    """SELECT dataset_split, count(*) AS clips, count(*) FILTER (condition IN ('normal','anomaly')) AS known_labels,
      count(*) FILTER (condition = 'unknown') AS unknown_labels, count(*) FILTER (condition = 'anomaly') AS anomaly_labels,
      CASE dataset_split WHEN 'eval_test' THEN count(*) FILTER (condition IN ('normal','anomaly')) = 0
        WHEN 'dev_test' THEN count(*) FILTER (condition = 'unknown') = 0 ELSE true END AS passed
    FROM (SELECT condition, dataset_split FROM manifest UNION ALL
          SELECT CASE WHEN clip_no % 3 = 0 THEN condition ELSE 'unknown' END, 'eval_test' FROM manifest) GROUP BY dataset_split""",
)
def f03(v: Views) -> DataFrame:
    hidden = F.when(F.col("clip_no") % 3 == 0, F.col("condition")).otherwise("unknown")
    evaluation = v.manifest.select(hidden.alias("condition"), F.lit("eval_test").alias("dataset_split"))
    both = v.manifest.select("condition", "dataset_split").unionByName(evaluation)
    return guards.leakage_report(both)


@query(
    "f04_unsafe_paths",
    "manifest",
    """WITH p AS (SELECT clip_no, CASE clip_no % 5 WHEN 0 THEN concat('/', file_id) WHEN 1 THEN concat('a/../', file_id)
        WHEN 2 THEN '..' WHEN 3 THEN '' ELSE file_id END AS relative_path FROM manifest)
    SELECT clip_no, relative_path, relative_path IN ('', '.', '..') OR starts_with(relative_path, '/')
      OR list_contains(string_split(relative_path, '/'), '..') AS unsafe FROM p""",
)
def f04(v: Views) -> DataFrame:
    kind = F.col("clip_no") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("/"), "file_id"))
        .when(kind == 1, F.concat(F.lit("a/../"), "file_id"))
        .when(kind == 2, "..")
        .when(kind == 3, "")
        .otherwise(F.col("file_id"))
    )
    shaped = v.manifest.select("clip_no", path.alias("relative_path"))
    return shaped.withColumn("unsafe", paths.unsafe(F.col("relative_path")))


@query(
    "f05_reliability_range",
    "vectors",
    """SELECT count(*) AS clips, count(*) FILTER (r >= 0 AND r <= 1) AS inside, count(*) FILTER (NOT (r >= 0 AND r <= 1)) AS outside
    FROM (SELECT reliability * 1.2e0 AS r FROM vectors)""",
)
def f05(v: Views) -> DataFrame:
    ok = guards.within_unit(F.col("reliability") * d(1.2))
    return v.vectors.agg(
        F.count("*").alias("clips"), F.count_if(ok).alias("inside"), F.count_if(~ok).alias("outside")
    )


@query(
    "f06_finite_vectors",
    "vectors",
    """SELECT vec_id, count(*) FILTER (isnan(x) OR isinf(x)) = 0 AS finite, CAST(count(*) AS INTEGER) AS width
    FROM (SELECT vec_id, unnest(near) AS x FROM vectors) GROUP BY vec_id""",
)
def f06(v: Views) -> DataFrame:
    return v.vectors.select(
        "vec_id", guards.all_finite(F.col("near")).alias("finite"), F.size("near").alias("width")
    )


@query(
    "f07_fit_input",
    "vectors",
    """SELECT machine_type, count(*) AS fit_rows, CAST(0 AS BIGINT) AS anomaly_rows FROM vectors
    WHERE dataset_split = 'dev_train' AND condition = 'normal' GROUP BY machine_type""",
)
def f07(v: Views) -> DataFrame:
    return guards.normal_train(v.vectors).groupBy("machine_type").agg(
        F.count("*").alias("fit_rows"), F.count_if(F.col("condition") == "anomaly").alias("anomaly_rows")
    )


# ---- data quality ------------------------------------------------------------------------------


@query(
    "q01_manifest_audit",
    "manifest",
    """SELECT count(*) AS clips, count(*) FILTER (channels = 2) AS stereo_clips, count(*) FILTER (channels <> 2) AS invalid_channel_clips,
      CAST(0 AS BIGINT) AS unsafe_paths, array_to_string(list_sort(list(DISTINCT sample_rate)), ',') AS sample_rates,
      array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains
    FROM manifest""",
)
def q01(v: Views) -> DataFrame:
    row = guards.manifest_summary(pathed(v))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return row.select(*[flat(c) if c in ("sample_rates", "conditions", "domains") else c for c in row.columns])


@query(
    "q02_duplicate_keys",
    sql="SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def q02(v: Views) -> DataFrame:
    return guards.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "q03_coverage",
    "scores_pair",
    """WITH a AS (SELECT DISTINCT file_id FROM scores_pair WHERE dataset_split = 'dev_test'),
    b AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS file_id FROM lineitem)
    SELECT count(*) FILTER (a.file_id IS NULL) AS missing, count(*) FILTER (b.file_id IS NULL) AS unexpected, count(*) AS ids
    FROM a FULL OUTER JOIN b ON a.file_id = b.file_id""",
)
def q03(v: Views) -> DataFrame:
    expected = v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("file_id"))
    return guards.coverage(v.score_table(), expected)


@query(
    "q04_vector_counts",
    "clips",
    """WITH n AS (SELECT clip_no, count(*) AS a, count(*) FILTER (far > -30) AS b FROM clips GROUP BY clip_no)
    SELECT count(*) AS clips, count(*) FILTER (a <> b) AS unequal FROM n""",
)
def q04(v: Views) -> DataFrame:
    near = v.clips.groupBy("clip_no").agg(F.count("*").alias("near_vector_count"))
    far = v.clips.where(F.col("far") > -30).groupBy("clip_no").agg(F.count("*").alias("residual_vector_count"))
    return near.join(far, "clip_no").agg(
        F.count("*").alias("clips"),
        F.count_if(F.col("near_vector_count") != F.col("residual_vector_count")).alias("unequal"),
    )


UNTRAINED = """SELECT DISTINCT machine_type, section FROM scores_pair t WHERE dataset_split = 'dev_test' AND NOT EXISTS
    (SELECT 1 FROM scores_pair r WHERE r.dataset_split = 'dev_train' AND r.score_candidate > 600 AND r.machine_type = t.machine_type AND r.section = t.section)"""


@query("q05_untrained_groups", "scores_pair", UNTRAINED)
def q05(v: Views) -> DataFrame:
    train = v.scores_pair.where((F.col("dataset_split") == "dev_train") & (F.col("score_candidate") > 600))
    return guards.untrained_groups(v.scores_pair.where(F.col("dataset_split") == "dev_test"), train)


@query(
    "q07_label_balance",
    "scores_pair",
    "SELECT dataset_split, domain, condition, count(*) AS clips FROM scores_pair GROUP BY ROLLUP (dataset_split, domain, condition)",
)
def q07(v: Views) -> DataFrame:
    return guards.label_balance(v.scores_pair)


# ---- joins -------------------------------------------------------------------------------------


@query(
    "j01_label_official_scores",
    "manifest",
    """SELECT file_id, machine_type, section, domain, condition, round(s_acctbal, 6) + 0e0 AS anomaly_score,
      'official_ae_mse' AS model_id, 'run_a' AS experiment_id FROM manifest JOIN supplier ON clip_no = s_suppkey
    WHERE dataset_split = 'dev_test'""",
)
def j01(v: Views) -> DataFrame:
    manifest = pathed(v)
    official = manifest.where(F.col("dataset_split") == "dev_test").join(
        v.table("supplier"), F.col("clip_no") == F.col("s_suppkey")
    ).select(
        F.concat(F.lit(paths.DATASET_PREFIX), "machine_type").alias("machine_type"),
        "section",
        paths.basename(F.col("file_id")).alias("basename"),
        F.col("s_acctbal").alias("anomaly_score"),
    )
    return rounded(joins.label_official_scores(official, manifest, "official_ae_mse", "run_a"))


def indexes(v: Views) -> tuple[DataFrame, DataFrame]:
    """Near and residual indexes of the orders: line counts stand in for vector counts."""
    lines = v.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file_id")).agg(
        F.count("*").alias("vector_count"), F.count_if(F.col("l_discount") >= 0.01).alias("kept")
    )
    rows = v.scores_pair.select("file_id", *GROUP, "domain", "condition", "dataset_split").join(lines, "file_id")
    return rows.drop("kept"), rows.drop("vector_count").withColumnRenamed("kept", "vector_count")


INDEXES = """lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS file_id, count(*) AS near_vector_count,
    count(*) FILTER (l_discount >= 0.01) AS residual_vector_count FROM lineitem GROUP BY l_orderkey)"""


@query(
    "j02_paired_indexes",
    "scores_pair",
    f"""WITH {INDEXES}, j AS (SELECT s.*, near_vector_count, residual_vector_count FROM scores_pair s JOIN lines USING (file_id) WHERE dataset_split = 'dev_test')
    SELECT (SELECT count(*) FROM j) AS joined, (SELECT count(*) FROM j) AS input_0, (SELECT count(*) FROM j) AS input_1,
      (SELECT count(*) FROM scores_pair WHERE dataset_split = 'dev_test') AS input_2,
      (SELECT count(*) FROM scores_pair WHERE dataset_split = 'dev_test') AS input_3,
      (SELECT count(*) FROM j) = (SELECT count(*) FROM scores_pair WHERE dataset_split = 'dev_test') AS one_to_one""",
)
def j02(v: Views) -> DataFrame:
    near, residual = indexes(v)
    reference, candidate = v.score_table(), v.score_table("candidate")
    # A report over sides that differ: clips without lines have scores, but no features.
    joined = one_to_one.matched(joins.index_sides(near, residual, reference, candidate), ["file_id"])
    test = F.col("dataset_split") == "dev_test"
    return joins.join_cardinalities(joined, near.where(test), residual.where(test), reference, candidate)


@query(
    "j03_gated_inputs",
    "scores_pair",
    f"""WITH {INDEXES}
    SELECT file_id, dataset_split, near_vector_count, residual_vector_count, round((CAST(file_id AS BIGINT) % 11) / 10e0, 6) + 0e0 AS reliability,
      near_vector_count = residual_vector_count AS aligned FROM scores_pair JOIN lines USING (file_id)""",
)
def j03(v: Views) -> DataFrame:
    near, residual = indexes(v)
    reliability = v.scores_pair.select(
        "file_id", ((F.col("file_id").cast("bigint") % 11) / d(10.0)).alias("reliability")
    )
    joined = one_to_one.matched(joins.gated_sides(near, residual, reliability), ["file_id"])
    aligned = F.col("near_vector_count") == F.col("residual_vector_count")
    return rounded(joined.select("file_id", "dataset_split", "near_vector_count", "residual_vector_count",
                                 "reliability", aligned.alias("aligned")))


@query(
    "j04_paired_scores",
    "scores_pair",
    """SELECT file_id, machine_type, section, domain, condition, round(score_reference, 6) + 0e0 AS anomaly_score_reference,
      round(score_candidate, 6) + 0e0 AS anomaly_score_candidate FROM scores_pair WHERE dataset_split = 'dev_test'""",
)
def j04(v: Views) -> DataFrame:
    return rounded(joins.paired_scores(v.score_table(), v.score_table("candidate")))


# One planted fault of each kind per side, on whole tables: a side lacks, repeats or adds the keys that a rule picks.
def planted(df: DataFrame, key: Column, lacks: int, repeats: int) -> DataFrame:
    kept = df.where(key % 29 != lacks)
    return kept.unionByName(kept.where(key % 29 == repeats))


def fault_sql(sides: list[tuple[str, str, int, int]], keys: str, number: str) -> str:
    """SQL of :func:`one_to_one.faults` over (side, relation, lacks, repeats)."""
    counts = ", ".join(f"count(*) FILTER (side = '{side}') AS n{i}" for i, (side, *_) in enumerate(sides))
    rows = " UNION ALL ".join(
        f"SELECT {keys}, '{side}' AS side FROM {relation} WHERE {number} % 29 <> {lacks} "
        f"UNION ALL SELECT {keys}, '{side}' FROM {relation} WHERE {number} % 29 = {repeats}" for side, relation, lacks, repeats in sides
    )
    each = " UNION ALL ".join(f"SELECT {keys}, '{side}' AS side, n{i} AS rows FROM g" for i, (side, *_) in enumerate(sides))
    return f"""t AS ({rows}), g AS (SELECT {keys}, {counts} FROM t GROUP BY {keys})
    SELECT {keys}, side, CASE WHEN rows = 0 THEN 'missing' ELSE 'repeated' END AS fault, rows FROM ({each}) WHERE rows <> 1"""


@query(
    "j01_faults",
    "manifest",
    "WITH m AS (SELECT *, string_split(file_id, '/')[-1] AS basename FROM manifest WHERE dataset_split = 'dev_test'), "
    + fault_sql([("manifest clip", "m", 3, 4), ("official score", "m", 5, 6)], "machine_type, section, basename", "CAST(regexp_extract(basename, '([0-9]+).wav$', 1) AS BIGINT)"),
)
def j01_faults(v: Views) -> DataFrame:
    manifest = pathed(v)
    number = F.col("clip_no")
    official = planted(manifest.where(F.col("dataset_split") == "dev_test"), number, 5, 6).select(
        F.concat(F.lit(paths.DATASET_PREFIX), "machine_type").alias("machine_type"), "section",
        paths.basename(F.col("file_id")).alias("basename"), F.lit(1.0).alias("anomaly_score"),
    )
    return one_to_one.faults(joins.official_sides(official, planted(manifest, number, 3, 4)), [*GROUP, "basename"])


@query(
    "j02_faults",
    "scores_pair",
    "WITH j AS (SELECT file_id FROM scores_pair WHERE dataset_split = 'dev_test'), l AS (SELECT file_id FROM j WHERE CAST(file_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem)), "
    + fault_sql([("near features", "l", 3, 4), ("residual features", "l", 5, 6), ("reference score", "j", 7, 8), ("candidate score", "j", 9, 10)], "file_id", "CAST(file_id AS BIGINT)"),
)
def j02_faults(v: Views) -> DataFrame:
    number = F.col("file_id").cast("bigint")
    near, residual = indexes(v)
    return one_to_one.faults(
        joins.index_sides(
            planted(near, number, 3, 4), planted(residual, number, 5, 6),
            planted(v.score_table(), number, 7, 8), planted(v.score_table("candidate"), number, 9, 10),
        ),
        ["file_id"],
    )


@query(
    "j03_faults",
    "scores_pair",
    "WITH l AS (SELECT file_id FROM scores_pair WHERE CAST(file_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem)), "
    + fault_sql([("near features", "l", 3, 4), ("residual features", "l", 5, 6), ("reliability", "scores_pair", 7, 8)], "file_id", "CAST(file_id AS BIGINT)"),
)
def j03_faults(v: Views) -> DataFrame:
    number = F.col("file_id").cast("bigint")
    near, residual = indexes(v)
    reliability = v.scores_pair.select("file_id", F.lit(0.5).alias("reliability"))
    sides = joins.gated_sides(planted(near, number, 3, 4), planted(residual, number, 5, 6), planted(reliability, number, 7, 8))
    return one_to_one.faults(sides, ["file_id"])


@query(
    "j04_faults",
    "scores_pair",
    "WITH j AS (SELECT file_id FROM scores_pair WHERE dataset_split = 'dev_test'), "
    + fault_sql([("reference score", "j", 3, 4), ("candidate score", "j", 5, 6)], "file_id", "CAST(file_id AS BIGINT)"),
)
def j04_faults(v: Views) -> DataFrame:
    number = F.col("file_id").cast("bigint")
    sides = joins.score_sides(planted(v.score_table(), number, 3, 4), planted(v.score_table("candidate"), number, 5, 6))
    return one_to_one.faults(sides, ["file_id"])


@query(
    "j07_threshold_decisions",
    "scores_pair",
    """WITH th AS (SELECT machine_type, section, avg(threshold) AS threshold FROM (
        SELECT machine_type, section, 1 AS seed, quantile_cont(score_candidate, 0.99) AS threshold FROM scores_pair WHERE dataset_split = 'dev_train' GROUP BY ALL
        UNION ALL SELECT machine_type, section, 2, quantile_cont(score_reference, 0.99) FROM scores_pair WHERE dataset_split = 'dev_train' GROUP BY ALL) GROUP BY ALL)
    SELECT file_id, round(score_candidate, 6) + 0e0 AS anomaly_score, round(threshold, 6) + 0e0 AS threshold,
      CAST(score_candidate > threshold AS INTEGER) AS decision FROM scores_pair JOIN th USING (machine_type, section) WHERE dataset_split = 'dev_test'""",
)
def j07(v: Views) -> DataFrame:
    from hushline.operators.summaries import detection_thresholds

    train = v.scores_pair.where(F.col("dataset_split") == "dev_train")
    seeds = train.select(*GROUP, F.inline(F.array(
        F.struct(F.lit(1).alias("seed"), F.col("score_candidate").alias("anomaly_score")),
        F.struct(F.lit(2).alias("seed"), F.col("score_reference").alias("anomaly_score")),
    )))
    decided = joins.apply_thresholds(v.score_table("candidate"), detection_thresholds(seeds, ["seed", *GROUP]))
    return rounded(decided.select("file_id", "anomaly_score", "threshold", "decision"))


@query("j08_anti_join_groups", "scores_pair", UNTRAINED.replace("> 600", "> 550"))
def j08(v: Views) -> DataFrame:
    train = v.scores_pair.where((F.col("dataset_split") == "dev_train") & (F.col("score_candidate") > 550))
    return guards.untrained_groups(v.scores_pair.where(F.col("dataset_split") == "dev_test"), train)


@query(
    "j09_band_statistics",
    sql="""WITH b AS (SELECT event_id, (event_id % 513) * 16000e0 / 1024e0 AS f, value FROM events)
    SELECT band, count(*) AS cells, round(avg(value), 6) + 0e0 AS mean_value FROM b
    JOIN (VALUES ('0-1000Hz', 0e0, 1000e0), ('1000-4000Hz', 1000e0, 4000e0), ('4000-8000Hz', 4000e0, 8000e0)) x(band, lo, hi)
      ON f >= lo AND f < hi GROUP BY band""",
)
def j09(v: Views) -> DataFrame:
    frequency = num.bin_frequency(F.col("event_id") % 513, F.lit(16000), 1024)
    banded = v.table("events").withColumn("band", selection.frequency_band(frequency))
    return rounded(
        banded.where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.count("*").alias("cells"), F.avg("value").alias("mean_value"))
    )


# ---- windows, sorts, limits, set operations ----------------------------------------------------


@query(
    "w01_balanced_sample",
    "manifest",
    """WITH n AS (SELECT machine_type, file_id AS relative_path, row_number() OVER (PARTITION BY machine_type ORDER BY file_id) AS rn,
        ceil(24e0 / (SELECT count(DISTINCT machine_type) FROM manifest WHERE dataset_split = 'dev_train' AND condition = 'normal')) AS per_group
      FROM manifest WHERE dataset_split = 'dev_train' AND condition = 'normal')
    SELECT machine_type, relative_path FROM n WHERE rn <= per_group ORDER BY machine_type, relative_path LIMIT 24""",
)
def w01(v: Views) -> DataFrame:
    return selection.balanced_sample(guards.normal_train(pathed(v)), 24).select("machine_type", "relative_path")


@query(
    "s01_sorted_scores",
    "scores_pair",
    """SELECT file_id, round(score_reference, 6) + 0e0 AS anomaly_score FROM scores_pair WHERE dataset_split = 'dev_test' ORDER BY file_id""",
)
def s01(v: Views) -> DataFrame:
    return rounded(v.score_table().select("file_id", "anomaly_score")).orderBy("file_id")


@query("s02_head", "manifest", "SELECT file_id, machine_type FROM manifest ORDER BY file_id LIMIT 20")
def s02(v: Views) -> DataFrame:
    return selection.head(v.manifest, 20).select("file_id", "machine_type")


@query(
    "u01_union_splits",
    "manifest",
    """SELECT file_id, dataset_split FROM manifest WHERE dataset_split = 'dev_train' AND condition = 'normal'
    UNION ALL SELECT file_id, dataset_split FROM manifest WHERE dataset_split = 'dev_test'""",
)
def u01(v: Views) -> DataFrame:
    both = guards.normal_train(v.manifest).unionByName(guards.test_rows(v.manifest))
    return both.select("file_id", "dataset_split")


@query(
    "u02_tagged_union",
    "scores_pair",
    """SELECT frontend, file_id, round(anomaly_score, 6) + 0e0 AS anomaly_score FROM (
      SELECT 'reference' AS frontend, file_id, score_reference AS anomaly_score, dataset_split FROM scores_pair
      UNION ALL SELECT 'candidate', file_id, score_candidate, dataset_split FROM scores_pair) WHERE dataset_split = 'dev_test'""",
)
def u02(v: Views) -> DataFrame:
    tagged = selection.tag_union({k: v.score_table(k) for k in ("reference", "candidate")}, "frontend")
    return rounded(tagged.select("frontend", "file_id", "anomaly_score"))


@query(
    "u03_id_differences",
    "scores_pair",
    """WITH a AS (SELECT DISTINCT file_id FROM scores_pair WHERE score_reference >= 20), b AS (SELECT DISTINCT file_id FROM scores_pair WHERE score_reference < 60)
    SELECT file_id, 'left' AS side FROM (SELECT file_id FROM a EXCEPT SELECT file_id FROM b)
    UNION ALL SELECT file_id, 'right' FROM (SELECT file_id FROM b EXCEPT SELECT file_id FROM a)""",
)
def u03(v: Views) -> DataFrame:
    high = v.scores_pair.where(F.col("score_reference") >= 20)
    return guards.id_differences(high, v.scores_pair.where(F.col("score_reference") < 60))


@query(
    "u04_label_subset",
    sql="""SELECT event_type, count(*) AS copies FROM events WHERE event_type NOT IN ('click','view') GROUP BY event_type""",
)
def u04(v: Views) -> DataFrame:
    return guards.values_outside(v.table("events"), "event_type", ("click", "view"))


# ---- scalar functions --------------------------------------------------------------------------


@query(
    "fn01_to_fn10_scalars",
    "clips",
    """SELECT clip_no, t, round(sqrt(near*near + far*far), 6) + 0e0 AS magnitude, round(near*near + far*far, 6) + 0e0 AS power,
      round(near*far + far*near, 6) + 0e0 AS cross_re, round(far*far - near*near, 6) + 0e0 AS cross_im,
      round(atan2(far, near), 6) + 0e0 AS phase, round(sin(atan2(far, near)), 6) + 0e0 AS phase_sin, round(cos(atan2(far, near)), 6) + 0e0 AS phase_cos,
      round(ln((abs(near) + 1e-8) / (abs(far) + 1e-8)), 6) + 0e0 AS log_ratio,
      round(greatest(-12e0, least(12e0, ln((near*near + 1e-8) / (far*far + 1e-8)))), 6) + 0e0 AS snr_proxy,
      round(greatest(0e0, least(0.9e0, 0.9e0 / (1e0 + exp(-greatest(-40e0, least(40e0, near)))))), 6) + 0e0 AS gate,
      round(10e0 * log10(greatest(near*near, 1e-8)), 6) + 0e0 AS db, round(ln(1e0 + abs(near)), 6) + 0e0 AS log1p,
      round(2595e0 * log10(1e0 + abs(near) / 700e0), 6) + 0e0 AS mel,
      round(700e0 * (pow(10e0, abs(near) / 2595e0) - 1e0), 6) + 0e0 AS hz, round((t % 513) * 16000e0 / 1024e0, 6) + 0e0 AS bin_hz
    FROM clips""",
)
def fn01(v: Views) -> DataFrame:
    from hushline.functions import complexes as c
    from hushline.operators.acoustic_path import log_ratio, snr_proxy

    a, b = c.Cx(F.col("near"), F.col("far")), c.Cx(F.col("far"), F.col("near"))
    swap = c.cross(a, b)
    n, f = c.Cx(F.col("near"), d(0.0)), c.Cx(F.col("far"), d(0.0))
    return rounded(
        v.clips.select(
            "clip_no", "t",
            c.magnitude(a).alias("magnitude"), c.power(a).alias("power"),
            swap.re.alias("cross_re"), swap.im.alias("cross_im"),
            c.angle(a).alias("phase"), F.sin(c.angle(a)).alias("phase_sin"), F.cos(c.angle(a)).alias("phase_cos"),
            log_ratio(n, f, num.EPS).alias("log_ratio"), snr_proxy(n, f, num.EPS).alias("snr_proxy"),
            num.clip(d(0.9) * num.sigmoid(F.col("near")), 0.0, 0.9).alias("gate"),
            num.decibels(c.power(n), num.EPS).alias("db"), F.log1p(F.abs("near")).alias("log1p"),
            num.hz_to_mel(F.abs("near")).alias("mel"), num.mel_to_hz(F.abs("near")).alias("hz"),
            num.bin_frequency(F.col("t") % 513, F.lit(16000), 1024).alias("bin_hz"),
        )
    )


@query(
    "fn11_risk_score",
    "clips",
    """SELECT clip_no, t, round(greatest(greatest(0e0, least(1e0, near / 20e0)), greatest(0e0, least(1e0, (far / 10e0) / (1e0 + greatest(far / 10e0, 0e0)))),
      greatest(0e0, least(1e0, (near / 30e0) / (1e0 + greatest(near / 30e0, 0e0))))), 6) + 0e0 AS risk FROM clips""",
)
def fn11(v: Views) -> DataFrame:
    n, f = F.col("near"), F.col("far")
    return rounded(
        v.clips.select("clip_no", "t", num.risk_score(n / d(20.0), f / d(10.0), n / d(30.0)).alias("risk"))
    )


@query(
    "fn12_view_selection",
    "cases",
    """SELECT case_id, CASE WHEN risk_score <= 0.4 AND estimated_noise_reduction_db >= 3.0 THEN 'refsub' ELSE 'near' END AS decision FROM cases""",
)
def fn12(v: Views) -> DataFrame:
    from hushline.operators.policy import view_decision

    chosen = view_decision(F.col("risk_score"), F.col("estimated_noise_reduction_db"), d(0.4), d(3.0))
    return v.cases.select("case_id", chosen.alias("decision"))


@query(
    "fn13_concatenate",
    "clips",
    """SELECT clip_no, b AS part, count(*) AS width, round(sum(near * (k + 1)), 6) + 0e0 AS weighted FROM
    (SELECT clip_no, t // 128 AS b, t % 128 AS k, near FROM clips) GROUP BY clip_no, b""",
)
def fn13(v: Views) -> DataFrame:
    packed = selection.concatenate(
        v.clips.select("clip_no", F.expr("t div 128").alias("part"), F.col("t"), "near"),
        ["clip_no", "part"], "t", "near",
    )
    weighted = F.aggregate(
        F.zip_with("near", F.sequence(F.lit(1), F.size("near")), lambda x, k: x * k), d(0.0), lambda a, x: a + x
    )
    return rounded(packed.select("clip_no", "part", F.size("near").cast("bigint").alias("width"), weighted.alias("weighted")))


@query(
    "fn17_widened_difference",
    "vectors",
    """SELECT vec_id, round(sum(CAST(b AS DOUBLE) - CAST(a AS DOUBLE)), 6) + 0e0 AS total
    FROM (SELECT vec_id, unnest(near) AS a, unnest(neighbour) AS b FROM vectors) GROUP BY vec_id""",
)
def fn17(v: Views) -> DataFrame:
    wide = v.vectors.select("vec_id", *[F.col(c).cast("array<double>").alias(c) for c in ("near", "neighbour")])
    gap = F.zip_with("neighbour", "near", lambda x, y: x - y)
    return rounded(wide.select("vec_id", F.aggregate(gap, d(0.0), lambda a, x: a + x).alias("total")))


# ---- sinks, read back --------------------------------------------------------------------------


def fresh(v: Views) -> str:
    """A new folder in the shared place the session names (a scratch folder only where it names none)."""
    return new_folder(v.spark, "tables")


@query("snk1_parquet", "manifest", "SELECT file_id, clip_no, machine_type, condition FROM manifest")
def snk1(v: Views) -> DataFrame:
    path = fresh(v)
    sinks.write_table(v.manifest, f"{path}/manifest")
    return v.spark.read.schema(v.manifest.schema).parquet(f"{path}/manifest").select(
        "file_id", "clip_no", "machine_type", "condition"
    )


@query(
    "snk2_score_csv",
    "scores_pair",
    "SELECT file_id, condition, round(score_candidate, 6) + 0e0 AS anomaly_score, 'fixture_candidate' AS model_id FROM scores_pair WHERE dataset_split = 'dev_test'",
)
def snk2(v: Views) -> DataFrame:
    path = fresh(v)
    sinks.write_scores(v.score_table("candidate"), f"{path}/scores")
    return rounded(scans.read_scores(v.spark, f"{path}/scores").select("file_id", "condition", "anomaly_score", "model_id"))


@query(
    "snk3_metrics_json",
    "scores_pair",
    f"""WITH {scored()}, {METRICS_CTE} SELECT concat(machine_type, '/', section) AS "group", round(auc_all, 6) + 0e0 AS auc_all, round(pauc_target, 6) + 0e0 AS pauc_target FROM metrics""",
)
def snk3(v: Views) -> DataFrame:
    from hushline.operators.roc import metric_table

    path = fresh(v)
    sinks.write_metrics_json(metric_table(v.score_table()), f"{path}/metrics", "scores.csv")
    schema = "struct<groups: map<string, struct<auc_all: double, pauc_target: double>>, score_file: string>"
    document = v.spark.read.text(f"{path}/metrics", wholetext=True).select(F.from_json("value", schema).alias("j"))
    return rounded(document.select(F.explode("j.groups").alias("group", "m")).select("group", "m.auc_all", "m.pauc_target"))


@query(
    "snk4_official_export",
    "scores_pair",
    """SELECT machine_type, section, concat('clip_', file_id, '.wav') AS basename, round(score_candidate, 6) + 0e0 AS value, CAST(score_candidate > 150 AS INTEGER) AS decision
    FROM scores_pair WHERE dataset_split = 'dev_test'""",
)
def snk4(v: Views) -> DataFrame:
    path = fresh(v)
    clip = F.concat(F.lit("audio/clip_"), "file_id", F.lit(".wav"))
    scores = v.score_table("candidate").withColumn("decision", (F.col("anomaly_score") > 150).cast("int"))
    rows = sinks.official_rows(scores, v.scores_pair.withColumn("relative_path", clip))
    sinks.write_official_scores(rows, path)
    keys = [*GROUP, "basename"]
    decisions = sinks.read_official_scores(v.spark, path, "decision_result").withColumnRenamed("value", "decision")
    return rounded(sinks.read_official_scores(v.spark, path).join(decisions, keys))


@query(
    "snk5_feature_table",
    "vectors",
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, machine_type, CAST(1 AS BIGINT) AS vector_count, sha256(CAST(vec_id AS VARCHAR)) AS storage_key FROM vectors""",
)
def snk5(v: Views) -> DataFrame:
    path = fresh(v)
    rows = v.vectors.select(F.col("vec_id").cast("string").alias("file_id"), "machine_type", F.col("near").alias("values"))
    sinks.write_features(rows, ["file_id", "machine_type"], path)
    return v.spark.read.parquet(f"{path}/index")


@query(
    "src4_score_directory",
    "scores_pair",
    """SELECT machine_type, section, file_id AS basename, round(score_reference, 6) + 0e0 AS anomaly_score
    FROM scores_pair WHERE dataset_split = 'dev_test'""",
)
def src4(v: Views) -> DataFrame:
    path = fresh(v)
    # One write for all groups: Spark cannot name single files, so each group's folder carries the file name.
    name = F.concat(F.lit("anomaly_score_DCASE2026T2"), "machine_type", F.lit("_"), "section", F.lit("_test_seed1.csv"))
    lines = v.score_table().select(name.alias("file"), F.concat_ws(",", "file_id", F.col("anomaly_score").cast("string")).alias("value"))
    lines.write.partitionBy("file").text(path)
    return rounded(score_files.read_score_directories(v.spark, path))


@query(
    "q06_checksum_audit",
    "scores_pair",
    """WITH m AS (SELECT DISTINCT machine_type, dense_rank() OVER (ORDER BY machine_type) AS i FROM scores_pair WHERE dataset_split = 'dev_test')
    SELECT status, CAST(count(*) AS BIGINT) AS machines FROM (
      SELECT CASE WHEN i = 1 THEN 'mismatch' WHEN i = 2 THEN 'unexpected' ELSE 'ok' END AS status FROM m
      UNION ALL SELECT 'missing') GROUP BY status""",
)
def q06(v: Views) -> DataFrame:
    """One machine's files were altered, one machine's files were never listed, one listed machine has no files."""
    path = fresh(v)
    v.score_table().select("machine_type", "file_id", "anomaly_score").write.partitionBy("machine_type").csv(f"{path}/scores")
    digests = stored(score_files.file_digests(v.spark, f"{path}/scores", "*.csv", with_path=True))
    machine = F.regexp_extract("file_name", "machine_type=([^/]+)/", 1)
    ranked = digests.select(machine.alias("machine")).distinct().withColumn("i", F.dense_rank().over(Window.orderBy("machine")))
    listed = digests.withColumn("machine", machine).join(ranked, "machine").where("i <> 2")
    listed = listed.select("file_name", F.when(F.col("i") == 1, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"))
    absent = v.spark.range(1).select(F.lit("machine_type=absent/part.csv").alias("file_name"), F.lit("0").alias("digest"))
    audit = score_files.checksum_audit(digests, listed.unionByName(absent))
    return audit.withColumn("machine", machine).groupBy("status").agg(F.countDistinct("machine").alias("machines"))
