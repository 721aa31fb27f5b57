"""Queries over score tables: ROC metrics, summaries, ensembles, correlations, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.views import Views
from hushline.functions.numeric import d, r6
from hushline.operators import bootstrap, correlation, joins, roc, summaries
from hushline.operators.ordered import running_sums
from hushline.schemas import GROUP, IDENTITY
from hushline.session import stored


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round the named columns (all double columns when none are named)."""
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.select(*[r6(F.col(c), places).alias(c) if c in chosen else F.col(c) for c in df.columns])


def scored(which: str = "reference", split: str = "dev_test") -> str:
    return f"""s AS (SELECT file_id, machine_type, section, domain, condition, score_{which} AS anomaly_score
  FROM scores_pair WHERE dataset_split = '{split}')"""


def roc_sql(source: str, keys: str, score: str, weight: str = "1") -> str:
    """CTEs ``cells``, ``cum``, ``seg`` and ``areas`` over ``source``: textbook trapezoids with lag()."""
    return f"""cells AS (SELECT {keys}, {score} AS score,
    sum(CASE WHEN condition = 'anomaly' THEN {weight} ELSE 0 END) AS pos,
    sum(CASE WHEN condition = 'anomaly' THEN 0 ELSE {weight} END) AS neg
  FROM {source} GROUP BY {keys}, {score}),
cum AS (SELECT {keys}, score,
    sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) / CAST(nullif(sum(pos) OVER (PARTITION BY {keys}), 0) AS DOUBLE) AS tpr,
    sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC) / CAST(nullif(sum(neg) OVER (PARTITION BY {keys}), 0) AS DOUBLE) AS fpr
  FROM cells),
seg AS (SELECT *, coalesce(lag(fpr) OVER (PARTITION BY {keys} ORDER BY score DESC), 0e0) AS x0,
    coalesce(lag(tpr) OVER (PARTITION BY {keys} ORDER BY score DESC), 0e0) AS y0 FROM cum),
areas AS (SELECT {keys}, sum((fpr - x0) * (tpr + y0) / 2e0) AS auc,
    0.5e0 * (1e0 + (sum(CASE WHEN fpr <= 0.1e0 THEN (fpr - x0) * (tpr + y0) / 2e0
        WHEN x0 <= 0.1e0 THEN (0.1e0 - x0) * (y0 + y0 + (tpr - y0) * (0.1e0 - x0) / (fpr - x0)) / 2e0
        ELSE CASE WHEN tpr IS NULL THEN NULL ELSE 0e0 END END) - 0.005e0) / (0.1e0 - 0.005e0)) AS pauc
  FROM seg GROUP BY {keys})"""


METRICS_CTE = (
    """scoped AS (SELECT *, 'all' AS scope FROM s UNION ALL SELECT *, domain AS scope FROM s),
"""
    + roc_sql("scoped", "machine_type, section, scope", "anomaly_score")
    + """,
metrics AS (SELECT machine_type, section,
    max(CASE WHEN scope='all' THEN auc END) AS auc_all, max(CASE WHEN scope='source' THEN auc END) AS auc_source,
    max(CASE WHEN scope='target' THEN auc END) AS auc_target, max(CASE WHEN scope='all' THEN pauc END) AS pauc_all,
    max(CASE WHEN scope='source' THEN pauc END) AS pauc_source, max(CASE WHEN scope='target' THEN pauc END) AS pauc_target
  FROM areas GROUP BY machine_type, section)"""
)


def round_all(names: str, keys: str = "", places: int = 6) -> str:
    """Select list rounding each of the space-separated names."""
    out = [keys] if keys else []
    out += [f"round({n}, {places}) + 0e0 AS {n}" for n in names.split()]
    return ", ".join(out)


@query(
    "a06_roc_curve",
    "scores_pair",
    f"WITH {scored()}, {roc_sql('s', 'machine_type, section', 'anomaly_score')}, "
    """pts AS (SELECT machine_type, section, score, fpr, tpr FROM cum
      UNION ALL SELECT DISTINCT machine_type, section, NULL, 0e0, 0e0 FROM s)
    SELECT machine_type, section, score, round(fpr, 6) + 0e0 AS fpr, round(tpr, 6) + 0e0 AS tpr FROM pts""",
)
def a06(v: Views) -> DataFrame:
    return rounded(roc.roc_curve(v.score_table(), GROUP), "fpr", "tpr")


@query(
    "a07_roc_auc",
    "scores_pair",
    f"WITH {scored('candidate')}, {roc_sql('s', 'machine_type, section', 'anomaly_score')} "
    "SELECT machine_type, section, round(auc, 6) + 0e0 AS auc FROM areas",
)
def a07(v: Views) -> DataFrame:
    return rounded(roc.roc_areas(v.score_table("candidate"), GROUP).drop("pauc"))


@query(
    "a08_partial_auc",
    "scores_pair",
    f"WITH {scored('candidate')}, {roc_sql('s', 'machine_type, section', 'anomaly_score')} "
    "SELECT machine_type, section, round(pauc, 6) + 0e0 AS pauc FROM areas",
)
def a08(v: Views) -> DataFrame:
    return rounded(roc.roc_areas(v.score_table("candidate"), GROUP).drop("auc"))


@query(
    "a09_metric_table",
    "scores_pair",
    f"WITH {scored()}, {METRICS_CTE} SELECT "
    + round_all("auc_all auc_source auc_target pauc_all pauc_source pauc_target", "machine_type, section")
    + " FROM metrics",
)
def a09(v: Views) -> DataFrame:
    return rounded(roc.metric_table(v.score_table()))


SUMMARY_SQL = """avg(auc_all) AS mean_auc_all, avg(pauc_all) AS mean_pauc_all_max_fpr_0_1,
  avg(auc_source) AS mean_auc_source, avg(auc_target) AS mean_auc_target"""
SUMMARY_NAMES = "mean_auc_all mean_pauc_all_max_fpr_0_1 mean_auc_source mean_auc_target"


@query(
    "a10_macro_summary",
    "scores_pair",
    f"WITH {scored('candidate')}, {METRICS_CTE} SELECT {round_all(SUMMARY_NAMES)} FROM (SELECT {SUMMARY_SQL} FROM metrics)",
)
def a10(v: Views) -> DataFrame:
    return rounded(summaries.macro_summary(roc.metric_table(v.score_table("candidate"))))


@query(
    "a11_category_summary",
    "scores_pair",
    f"""WITH {scored()}, {METRICS_CTE}, c AS (SELECT *, 'all' AS category FROM metrics
      UNION ALL SELECT *, CASE WHEN machine_type LIKE '%Emu' THEN 'emulated' ELSE 'real' END FROM metrics)
    SELECT {round_all(SUMMARY_NAMES, 'category')} FROM (SELECT category, {SUMMARY_SQL} FROM c GROUP BY category)""",
)
def a11(v: Views) -> DataFrame:
    return rounded(summaries.category_summary(roc.metric_table(v.score_table())))


@query(
    "a12_seed_ensemble",
    "scores_pair",
    """SELECT file_id, machine_type, section, domain, condition,
      round((score_reference + score_candidate + (score_reference + 2e0 * score_candidate)) / 3e0, 6) + 0e0 AS anomaly_score,
      'three_seed_ensemble' AS model_id, 'run_a' AS experiment_id FROM scores_pair WHERE dataset_split = 'dev_test'""",
)
def a12(v: Views) -> DataFrame:
    test = v.scores_pair.where(F.col("dataset_split") == "dev_test")
    a, b = F.col("score_reference"), F.col("score_candidate")
    seeds = test.select(*IDENTITY, F.posexplode(F.array(a, b, a + d(2.0) * b)).alias("model_id", "anomaly_score"))
    return rounded(summaries.seed_ensemble(seeds, 3, "three_seed_ensemble", "run_a"))


@query(
    "a17_detection_threshold",
    "scores_pair",
    """SELECT machine_type, section, round(quantile_cont(score_candidate, 0.99), 6) + 0e0 AS threshold
    FROM scores_pair WHERE dataset_split = 'dev_train' GROUP BY machine_type, section""",
)
def a17(v: Views) -> DataFrame:
    return rounded(summaries.detection_thresholds(v.score_table("candidate", "dev_train"), GROUP))


def systems(v: Views) -> tuple[DataFrame, DataFrame]:
    """Three systems over the score pair; section_00 groups decided for the second view."""
    test = v.scores_pair.where(F.col("dataset_split") == "dev_test")
    rule = F.when(F.col("section") == "section_00", "refsub").otherwise("near")
    decisions = v.scores_pair.select(*GROUP).distinct().withColumn("decision", rule)
    return joins.system_scores(test, decisions, "score_reference", "score_candidate"), decisions


SYSTEMS_SQL = f"""s0 AS (SELECT *, CASE WHEN section = 'section_00' THEN 'refsub' ELSE 'near' END AS decision FROM scores_pair WHERE dataset_split = 'dev_test'),
s AS (SELECT 'near' AS system, machine_type, section, domain, condition, score_reference AS anomaly_score FROM s0
  UNION ALL SELECT 'unconditional_refsub', machine_type, section, domain, condition, score_candidate FROM s0
  UNION ALL SELECT 'safe_ref', machine_type, section, domain, condition, CASE WHEN decision = 'refsub' THEN score_candidate ELSE score_reference END FROM s0),
scoped AS (SELECT *, 'all' AS scope FROM s UNION ALL SELECT *, domain AS scope FROM s),
{roc_sql('scoped', 'system, machine_type, section, scope', 'anomaly_score')},
picked AS (SELECT system, machine_type, section, scope,
    CASE WHEN scope = 'all' THEN pauc ELSE auc END AS x, auc, pauc FROM areas),
grp AS (SELECT system, machine_type, section, count(*) / sum(1e0 / greatest(x, 2.220446049250313e-16)) AS group_score FROM picked GROUP BY ALL),
off AS (SELECT system, count(*) / sum(1e0 / greatest(x, 2.220446049250313e-16)) AS official_score,
    avg(CASE WHEN scope = 'all' THEN auc END) AS mean_auc_all, avg(CASE WHEN scope = 'all' THEN pauc END) AS mean_pauc_all_max_fpr_0_1
  FROM picked GROUP BY system)"""


@query(
    "a18_official_score",
    "scores_pair",
    f"WITH {SYSTEMS_SQL} SELECT "
    + round_all("official_score mean_auc_all mean_pauc_all_max_fpr_0_1", "system")
    + " FROM off",
)
def a18(v: Views) -> DataFrame:
    fan, _ = systems(v)
    return rounded(summaries.development_summary(roc.metric_table(fan, ["system"])))


@query(
    "a18_group_scores",
    "scores_pair",
    f"WITH {SYSTEMS_SQL} SELECT system, machine_type, section, round(group_score, 6) + 0e0 AS group_score FROM grp",
)
def a18_groups(v: Views) -> DataFrame:
    fan, _ = systems(v)
    return rounded(summaries.group_official_scores(roc.metric_table(fan, ["system"])))


@query(
    "a19_development_gate",
    "scores_pair",
    f"""WITH {SYSTEMS_SQL},
    g AS (SELECT machine_type, section, max(CASE WHEN system='near' THEN group_score END) AS near,
        max(CASE WHEN system='unconditional_refsub' THEN group_score END) AS unc, max(CASE WHEN system='safe_ref' THEN group_score END) AS safe FROM grp GROUP BY ALL),
    h AS (SELECT count(*) FILTER (unc - near < -0.005e0) AS u, count(*) FILTER (safe - near < -0.005e0) AS s, min(safe - near) AS m FROM g),
    o AS (SELECT max(CASE WHEN system='near' THEN official_score END) AS near, max(CASE WHEN system='unconditional_refsub' THEN official_score END) AS unc,
        max(CASE WHEN system='safe_ref' THEN official_score END) AS safe FROM off),
    dd AS (SELECT count(*) FILTER (section = 'section_00') AS a, count(*) FILTER (section <> 'section_00') AS r FROM (SELECT DISTINCT machine_type, section FROM scores_pair)),
    x AS (SELECT o.near AS near, o.unc AS unc, o.safe AS safe, u, s, m, a, r, CASE WHEN u > 0 THEN (u - s) / CAST(u AS DOUBLE) ELSE 0e0 END AS hr FROM o, h, dd)
    SELECT round(near, 6) + 0e0 AS near_official_score, round(unc, 6) + 0e0 AS unconditional_official_score, round(safe, 6) + 0e0 AS safe_ref_official_score,
      round(safe - near, 6) + 0e0 AS safe_ref_delta, u AS unconditional_harm_events, s AS safe_ref_harm_events, round(hr, 6) + 0e0 AS harm_reduction,
      round(m, 6) + 0e0 AS minimum_machine_delta, a AS accepted_groups, r AS rejected_groups,
      safe >= near - 0.005e0 AND hr >= 0.5e0 AND m >= -0.01e0 AND a >= 1 AND r >= 1 AS passed FROM x""",
)
def a19(v: Views) -> DataFrame:
    fan, decisions = systems(v)
    return rounded(summaries.development_gate(roc.metric_table(fan, ["system"]), decisions))


def per_clip(v: Views) -> DataFrame:
    """Score pair per test clip with displacement built from the line items of each order."""
    lines = v.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file_id")).agg(
        F.avg("l_quantity").alias("residual_minus_near"), F.avg(F.abs("l_discount")).alias("shift_l1")
    )
    test = v.scores_pair.where(F.col("dataset_split") == "dev_test").join(lines, "file_id")
    return correlation.with_score_delta(test, F.col("score_reference"), F.col("score_candidate"))


PER_CLIP = """pc AS (SELECT s.*, score_candidate - score_reference AS score_delta, abs(score_candidate - score_reference) AS absolute_score_delta,
    residual_minus_near, shift_l1 FROM scores_pair s JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS file_id, avg(l_quantity) AS residual_minus_near,
      avg(abs(l_discount)) AS shift_l1 FROM lineitem GROUP BY l_orderkey) l USING (file_id) WHERE dataset_split = 'dev_test')"""


def spearman_sql(source: str, keys: str, x: str, y: str) -> str:
    """CTEs ``ranked`` and ``rho`` from rank() plus half the tie count, then corr()."""
    part = f"PARTITION BY {keys}" if keys else ""
    also = f"{keys}, " if keys else ""
    return f"""ranked AS (SELECT {also}rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {also}{x}) - 1) / 2e0 AS rx,
      rank() OVER ({part} ORDER BY {y}) + (count(*) OVER (PARTITION BY {also}{y}) - 1) / 2e0 AS ry FROM {source}),
    rho AS (SELECT {also}count(*) AS clips, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS spearman_rho FROM ranked {'GROUP BY ' + keys if keys else ''})"""


@query(
    "w07_average_rank",
    "scores_pair",
    """SELECT DISTINCT machine_type, section, score_reference, round(rank() OVER (PARTITION BY machine_type, section ORDER BY score_reference)
      + (count(*) OVER (PARTITION BY machine_type, section, score_reference) - 1) / 2e0, 6) + 0e0 AS rank,
      count(*) OVER (PARTITION BY machine_type, section) AS "rows" FROM scores_pair""",
)
def w07(v: Views) -> DataFrame:
    return rounded(correlation.average_ranks(v.scores_pair, GROUP, "score_reference"))


@query(
    "w02_cumulative_counts",
    "scores_pair",
    """WITH c AS (SELECT machine_type, section, score_candidate AS score, count(*) FILTER (condition = 'anomaly') AS pos, count(*) FILTER (condition <> 'anomaly') AS neg
      FROM scores_pair GROUP BY ALL)
    SELECT machine_type, section, score, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg FROM c
    WINDOW w AS (PARTITION BY machine_type, section ORDER BY score DESC)""",
)
def w02(v: Views) -> DataFrame:
    cells = roc.score_cells(v.scores_pair, GROUP, "score_candidate")
    sums = {"pos": F.col("pos"), "neg": F.col("neg")}
    run = running_sums(cells, GROUP, "score", sums, descending=True)
    return run.select(*GROUP, "score", *[(F.col(f"{c}_before") + F.col(c)).alias(f"cum_{c}") for c in sums])


CORRELATION_SQL = f"""WITH {PER_CLIP},
    o AS (SELECT file_id, machine_type, section, residual_minus_near, 'score_delta' AS outcome, score_delta AS y FROM pc
      UNION ALL SELECT file_id, machine_type, section, residual_minus_near, 'absolute_score_delta', absolute_score_delta FROM pc),
    g AS (SELECT 'all' AS "group", * FROM o UNION ALL SELECT concat(machine_type,'/',section), * FROM o),
    {spearman_sql('g', '"group", outcome', 'residual_minus_near', 'y')}
    SELECT "group", outcome, clips, round(spearman_rho, 6) + 0e0 AS spearman_rho FROM rho"""


@query("a24_spearman", "scores_pair", CORRELATION_SQL)
def a24(v: Views) -> DataFrame:
    return rounded(correlation.correlation_table(stored(per_clip(v))).drop("two_sided_p_value"))


@query("a24_spearman_p_values")
def a24_p(v: Views) -> DataFrame:
    return rounded(correlation.correlation_table(stored(per_clip(v))))


STRATA_SQL = """st AS (SELECT machine_type, section, domain, condition, count(*) AS clips, avg(score_delta) AS score_delta_mean,
    avg(residual_minus_near) AS residual_minus_near_mean, avg(shift_l1) AS shift_l1_mean, quantile_cont(score_delta, 0.5) AS score_delta_median FROM pc GROUP BY ALL)"""
STRATA_NAMES = round_all(
    "score_delta_mean residual_minus_near_mean shift_l1_mean score_delta_median",
    "machine_type, section, domain, condition, clips",
    # Means of values with three decimals over 240 or 320 rows can tie at the seventh digit.
    places=9,
)


@query("a25_strata_summary", "scores_pair", f"WITH {PER_CLIP}, {STRATA_SQL} SELECT {STRATA_NAMES} FROM st")
def a25(v: Views) -> DataFrame:
    return rounded(correlation.strata_summary(per_clip(v)), places=9)


@query(
    "a26_feature_displacement",
    "dims",
    "SELECT vec_id, "
    + round_all("near_mean residual_mean residual_minus_near shift_l1")
    + """ FROM (SELECT vec_id, avg(near) AS near_mean, avg(residual) AS residual_mean, avg(residual - near) AS residual_minus_near,
      avg(abs(residual - near)) AS shift_l1 FROM dims GROUP BY vec_id)""",
)
def a26(v: Views) -> DataFrame:
    return rounded(correlation.displacement(v.vector_pairs, ["vec_id"]))


@query(
    "a27_score_delta",
    "scores_pair",
    f"WITH {PER_CLIP} SELECT file_id, round(score_delta, 6) + 0e0 AS score_delta, round(absolute_score_delta, 6) + 0e0 AS absolute_score_delta FROM pc",
)
def a27(v: Views) -> DataFrame:
    return rounded(per_clip(v).select("file_id", "score_delta", "absolute_score_delta"))


@query(
    "a32_worst_strata",
    "scores_pair",
    f"WITH {PER_CLIP}, {STRATA_SQL} SELECT {STRATA_NAMES} FROM (SELECT * FROM st ORDER BY score_delta_mean, machine_type, section, domain, condition LIMIT 5)",
)
def a32(v: Views) -> DataFrame:
    return rounded(correlation.worst_strata(correlation.strata_summary(per_clip(v))), places=9)


@query(
    "j11_aligned_vectors",
    "dims",
    "SELECT vec_id, machine_type, round(sum(residual - near), 6) + 0e0 AS gap, round(max(abs(residual - near)), 6) + 0e0 AS widest FROM dims GROUP BY vec_id, machine_type",
)
def j11(v: Views) -> DataFrame:
    keys = ["vec_id", "machine_type"]
    both = v.vector_pairs
    aligned = correlation.aligned_vectors(
        both.select(*keys, F.col("near").alias("values")), both.select(*keys, F.col("residual").alias("values")), keys
    )
    gap = F.zip_with("residual", "near", lambda r, n: r - n)
    total = F.aggregate(gap, d(0.0), lambda a, x: a + x)
    return rounded(
        aligned.select(*keys, total.alias("gap"), F.array_max(F.transform(gap, F.abs)).alias("widest"))
    )


@query(
    "a33_latency_summary",
    sql="""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT event_type, avg(value) AS mean, max(CASE WHEN i = ceil(0.5e0 * (n - 1)) THEN value END) AS p50,
      max(CASE WHEN i = ceil(0.95e0 * (n - 1)) THEN value END) AS p95, max(CASE WHEN i = ceil(0.99e0 * (n - 1)) THEN value END) AS p99 FROM n GROUP BY event_type)
    SELECT event_type, round(mean, 6) + 0e0 AS mean, round(p50, 6) + 0e0 AS p50, round(p95, 6) + 0e0 AS p95, round(p99, 6) + 0e0 AS p99,
      p50 <= p95 AND p95 <= p99 AS ordered FROM p""",
)
def a33(v: Views) -> DataFrame:
    return rounded(summaries.latency_summary(v.table("events"), ["event_type"], "value"))


BOOTSTRAP_ITERATIONS = 2000


@query(
    "a31_paired_bootstrap",
    "scores_pair",
    f"""WITH b AS (SELECT machine_type, section, condition, score_reference, score_candidate,
        row_number() OVER (PARTITION BY machine_type, section, condition ORDER BY md5(file_id)) - 1 AS pos,
        count(*) OVER (PARTITION BY machine_type, section, condition) AS n FROM scores_pair WHERE dataset_split = 'dev_test'),
    draws AS (SELECT iteration, machine_type, section, condition,
        CAST(('0x' || substr(md5(concat_ws('|', '2026', CAST(iteration AS VARCHAR), machine_type, section, condition, CAST(pos AS VARCHAR))), 1, 8)) AS BIGINT) % n AS pos
      FROM b, unnest(range(1, {BOOTSTRAP_ITERATIONS + 1})) u(iteration)),
    w AS (SELECT iteration, machine_type, section, condition, pos, count(*) AS weight FROM draws GROUP BY ALL),
    j AS (SELECT w.*, score_reference, score_candidate FROM w JOIN b USING (machine_type, section, condition, pos)),
    sides AS (SELECT iteration, machine_type, section, condition, weight, 'reference' AS side, score_reference AS x FROM j
      UNION ALL SELECT iteration, machine_type, section, condition, weight, 'candidate', score_candidate FROM j),
    {roc_sql('sides', 'iteration, side, machine_type, section', 'x', 'weight')},
    m AS (SELECT iteration, side, avg(auc) AS auc, avg(pauc) AS pauc FROM areas GROUP BY iteration, side),
    dl AS (SELECT iteration, max(CASE WHEN side='candidate' THEN auc END) - max(CASE WHEN side='reference' THEN auc END) AS auc_delta,
      max(CASE WHEN side='candidate' THEN pauc END) - max(CASE WHEN side='reference' THEN pauc END) AS pauc_delta FROM m GROUP BY iteration),
    l AS (SELECT 'auc_delta' AS metric, auc_delta AS delta FROM dl UNION ALL SELECT 'pauc_delta', pauc_delta FROM dl)
    SELECT metric, count(*) AS iterations, round(avg(delta), 6) + 0e0 AS mean, round(quantile_cont(delta, 0.025), 6) + 0e0 AS ci95_low,
      round(quantile_cont(delta, 0.975), 6) + 0e0 AS ci95_high FROM l GROUP BY metric""",
)
def a31(v: Views) -> DataFrame:
    paired = joins.paired_scores(v.score_table(), v.score_table("candidate"))
    return rounded(bootstrap.paired_bootstrap(paired, BOOTSTRAP_ITERATIONS, 2026))
