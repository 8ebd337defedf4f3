"""Model quality: sweeps, operating points, reports, trials, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.probabilities import argmax, argmax_label, margin, runner_up, top1
from flowlens.operators import evaluation as ev
from flowlens.operators import multiclass as mc
from flowlens.operators import trials as tr
from flowlens.operators.ordering import numeric_profile
from flowlens.operators.scoring import ScoringConfig, binary_columns, family_columns
from flowlens.plans import bindings as b
from flowlens.plans.catalog.registry import Registry, rounded
from flowlens.sources.tables import read_table
from flowlens.sources.training_logs import benchmark_summary, epoch_timeline, progress_rows

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks
METRICS = ("accuracy", "precision", "recall", "fpr", "f1")


def ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN ({bottom}) = 0 THEN 0 ELSE CAST({top} AS DOUBLE) / ({bottom}) END)"


def metric_sql(digits: int = 8) -> str:
    """accuracy .. f1 from tp, fp, tn, fn as rounded SQL columns."""
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    return (
        f"round({ratio('tp + tn', 'greatest(1, tp + fp + tn + fn)')}, {digits}) AS accuracy, round({p}, {digits}) AS precision, "
        f"round({r}, {digits}) AS recall, round({ratio('fp', 'fp + tn')}, {digits}) AS fpr, "
        f"round({ratio(f'2 * {p} * {r}', f'{p} + {r}')}, {digits}) AS f1"
    )


def counts_sql(hit: str, truth: str = "y") -> str:
    return (
        f"count(*) FILTER (WHERE {hit} AND {truth} = 1) AS tp, count(*) FILTER (WHERE {hit} AND {truth} = 0) AS fp, "
        f"count(*) FILTER (WHERE NOT ({hit}) AND {truth} = 0) AS tn, count(*) FILTER (WHERE NOT ({hit}) AND {truth} = 1) AS fn"
    )


@_r.query(f"""WITH {b.SCORED} SELECT split, {counts_sql("score >= CAST(0.9 AS FLOAT)")} FROM scored GROUP BY 1""")
def confusion_at_threshold(spark, sf):
    return ev.confusion_at_threshold(b.scored_events(spark, sf), ["split"], "y", "score", 0.9)


@_r.query(f"""WITH {b.SCORED}, c AS (SELECT split, model, {counts_sql("score >= CAST(0.5 AS FLOAT)")} FROM scored GROUP BY 1, 2)
SELECT split, model, tp, fp, tn, fn, {metric_sql()}, CAST(0.5 AS DOUBLE) AS threshold FROM c""")
def metrics_at_threshold(spark, sf):
    return rounded(ev.evaluate_at_threshold(b.scored_events(spark, sf), ["split", "model"], "y", "score", 0.5), 8, *METRICS)


@_r.query(f"""WITH {b.SCORED}, c AS (SELECT split, {counts_sql("score >= CAST(0.9 AS FLOAT)")}, count(*) AS rows, avg(CAST(score AS DOUBLE)) AS m FROM scored GROUP BY 1)
SELECT split, tp, fp, tn, fn, rows, round(m, 6) AS mean_score, {metric_sql()}, round({ratio('tn', 'tn + fp')}, 8) AS specificity,
       round({ratio('tp', 'tp + fn')}, 8) AS tpr, round(({ratio('tp', 'tp + fn')} + {ratio('tn', 'tn + fp')}) / 2, 8) AS balanced_accuracy FROM c""")
def split_evaluation(spark, sf):
    rows = b.scored_events(spark, sf).withColumns({
        "hit": F.col("score") >= F.lit(0.9).cast("float"), "score": F.col("score").cast("double"),
    })
    report = ev.evaluate_splits(rows, ["split"], "y", "hit", "score")
    return rounded(rounded(report, 8, *METRICS, "specificity", "tpr", "balanced_accuracy"), 6, "mean_score")


_SWEEP = f"""{b.SCORED}, grid AS (SELECT round(i / CAST(400 AS DOUBLE), 10) AS threshold FROM range(0, 401) r(i)), sw0 AS (
  SELECT model, threshold, {counts_sql("CAST(score AS DOUBLE) >= threshold")} FROM scored, grid GROUP BY 1, 2), sw AS (
  SELECT model, threshold, tp, fp, tn, fn, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall,
         {ratio('fp', 'fp + tn')} AS fpr FROM sw0), sweep AS (
  SELECT *, recall AS tpr, {ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM sw)"""
_SWEEP_COLUMNS = ("precision", "recall", "tpr", "fpr", "f1")


def _sweep(spark, sf):
    return ev.threshold_sweep(b.scored_events(spark, sf), ["model"], "y", "score")


@_r.query(f"""WITH {_SWEEP}
SELECT model, threshold, tp, fp, tn, fn, round(precision, 8) AS precision, round(recall, 8) AS recall, round(tpr, 8) AS tpr,
       round(fpr, 8) AS fpr, round(f1, 8) AS f1 FROM sweep""")
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf), 8, *_SWEEP_COLUMNS)


@_r.query(f"""WITH {_SWEEP}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY threshold) - 1 AS i FROM sweep)
SELECT model, threshold, tp, fp FROM n WHERE i IN (SELECT CAST(floor(k * (400 / CAST(199 AS DOUBLE))) AS BIGINT) FROM range(0, 199) r(k)) OR i = 400""")
def sweep_downsampled(spark, sf):
    return ev.downsample(_sweep(spark, sf), ["model"], "threshold").select("model", "threshold", "tp", "fp")


def _choice_sql(order_good: str, order_poor: str) -> str:
    caps = "(VALUES (CAST(0.005 AS DOUBLE)), (0.01), (0.02), (0.05), (0.6)) c(fpr_cap)"
    return f"""WITH {_SWEEP}, el AS (SELECT s.*, c.fpr_cap, s.fpr <= c.fpr_cap AS fits FROM sweep s, {caps}), rk AS (
  SELECT *, row_number() OVER (PARTITION BY model, fpr_cap ORDER BY fits DESC, {order_good}, {order_poor}) AS rn FROM el)
SELECT model, fpr_cap, threshold, tp, fp, tn, fn, round(f1, 8) AS f1 FROM rk WHERE rn = 1"""


_CAPS = (0.005, 0.01, 0.02, 0.05, 0.6)


@_r.query(_choice_sql(
    "CASE WHEN fits THEN f1 END DESC, CASE WHEN fits THEN recall END DESC, CASE WHEN fits THEN fpr END, CASE WHEN fits THEN threshold END DESC",
    "fpr, f1 DESC, recall DESC, threshold DESC",
))
def fpr_cap_choice(spark, sf):
    points = ev.choose_thresholds(_sweep(spark, sf), ["model"], _CAPS)
    return rounded(points.select("model", "fpr_cap", "threshold", "tp", "fp", "tn", "fn", "f1"), 8, "f1")


@_r.query(_choice_sql(
    "CASE WHEN fits THEN f1 END DESC, CASE WHEN fits THEN recall END DESC, CASE WHEN fits THEN threshold END",
    "fpr, threshold",
))
def fpr_cap_choice_lowest(spark, sf):
    points = ev.choose_thresholds(_sweep(spark, sf), ["model"], _CAPS, "low")
    return rounded(points.select("model", "fpr_cap", "threshold", "tp", "fp", "tn", "fn", "f1"), 8, "f1")


@_r.query(f"""WITH {b.SCORED}, d AS (
  SELECT model, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY 1, 2), c AS (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
  FROM d WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(sum(neg * (cp - pos + pos / CAST(2 AS DOUBLE))) / (CAST(max(p) AS DOUBLE) * max(n)), 8) AS roc_auc,
       round(sum(pos * (CAST(cp AS DOUBLE) / (cp + cn))) / max(p), 8) AS average_precision FROM c GROUP BY 1""")
def roc_auc_and_average_precision(spark, sf):
    return rounded(ev.curve_metrics(b.scored_events(spark, sf), ["model"], "y", "score"), 8, "roc_auc", "average_precision")


def _table_sql() -> str:
    points = " UNION ALL ".join(
        [f"SELECT model, 'default_0.5' AS threshold_type, CAST(0.5 AS DOUBLE) AS threshold FROM m"]
        + [f"SELECT model, 'tuned_fpr_cap_{c:.3f}', threshold FROM pick WHERE fpr_cap = {c}" for c in (0.005, 0.01, 0.02, 0.05)]
    )
    val = _SWEEP.replace("FROM scored, grid", "FROM scored, grid WHERE split = 'val'")
    return f"""WITH {val}, pick AS (
  SELECT model, fpr_cap, threshold FROM (
    SELECT s.*, c.fpr_cap, row_number() OVER (PARTITION BY model, fpr_cap ORDER BY fpr <= fpr_cap DESC,
      CASE WHEN fpr <= fpr_cap THEN f1 END DESC, CASE WHEN fpr <= fpr_cap THEN recall END DESC, fpr, f1 DESC, recall DESC, threshold DESC) AS rn
    FROM sweep s, (VALUES (CAST(0.005 AS DOUBLE)), (0.01), (0.02), (0.05)) c(fpr_cap)) WHERE rn = 1), m AS (SELECT DISTINCT model FROM scored), th AS ({points}), c AS (
  SELECT s.model, s.split, t.threshold_type, t.threshold, {counts_sql("s.score >= CAST(t.threshold AS FLOAT)")}
  FROM scored s JOIN th t USING (model) GROUP BY ALL)
SELECT model, split, threshold_type, threshold_type = 'tuned_fpr_cap_0.020' AS is_recommended, threshold, tp, fp, tn, fn, {metric_sql()} FROM c"""


@_r.query(_table_sql())
def threshold_evaluation_table(spark, sf):
    table = ev.threshold_evaluation_table(b.scored_events(spark, sf), "model", "split", "y", "score")
    return rounded(table, 8, *METRICS)


_PROFILE_SQL = """count(*) AS count, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, min({x}) AS min,
  round(quantile_cont({x}, 0.1), 6) AS p10, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
  round(quantile_cont({x}, 0.75), 6) AS p75, round(quantile_cont({x}, 0.9), 6) AS p90, max({x}) AS max"""
_PROFILE = ("mean", "std", "p10", "p25", "p50", "p75", "p90")


@_r.query(f"SELECT event_type, {_PROFILE_SQL.format(x='value')} FROM events GROUP BY 1")
def numeric_profile_by_type(spark, sf):
    return rounded(numeric_profile(read_table(spark, sf, "events"), ["event_type"], "value"), 6, *_PROFILE)


@_r.query(f"SELECT {_PROFILE_SQL.format(x='l_extendedprice')} FROM lineitem")
def numeric_profile_overall(spark, sf):
    return rounded(numeric_profile(read_table(spark, sf, "lineitem"), [], "l_extendedprice"), 6, *_PROFILE)


CLASSES = tuple(f"class_{i}" for i in range(10))
FAMILY_LABELS = ("DDoS", "DoS", "Mirai", "Spoofing", "Web-Based")


def predictions(spark, sf):
    """Embeddings as class scores: each class, and each family, has the largest of its share of all values."""
    values = F.col("embedding").cast("array<double>")

    def largest(parts: int):
        return F.transform(
            F.sequence(F.lit(0), F.lit(parts - 1)),
            lambda c: F.array_max(F.filter(values, lambda x, at: at % parts == c)),
        )

    scores = largest(10)
    return read_table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("true_label"),
        scores.alias("scores"),
        argmax_label(scores, CLASSES).alias("pred_label"),
        top1(scores).alias("top1"),
        margin(scores).alias("margin"),
        ((F.array_max(values) + F.array_min(values) + 1.0) / 2.0).alias("attack_score"),
        largest(5).alias("family_scores"),
    )


_PRED = """pr AS (
  SELECT vec_id, 'class_' || label AS true_label, list_transform(range(0, 10), lambda c: list_max(list_filter(v, lambda x, p: (p - 1) % 10 = c))) AS s,
         (list_max(v) + list_min(v) + 1.0::DOUBLE) / 2.0::DOUBLE AS attack_score, list_transform(range(0, 5), lambda c: list_max(list_filter(v, lambda x, p: (p - 1) % 5 = c))) AS f
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), pred AS (
  SELECT *, 'class_' || (list_position(s, list_max(s)) - 1) AS pred_label, list_max(s) AS top1, list_max(s) - list_reverse_sort(s)[2] AS margin,
         list_max(f) AS f1, list_max(f) - list_reverse_sort(f)[2] AS fm, ['DDoS', 'DoS', 'Mirai', 'Spoofing', 'Web-Based'][list_position(f, list_max(f))] AS fam
  FROM pr)"""


@_r.query(f"""WITH {_PRED}
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS predicted, top1, list_reverse_sort(s)[2] AS runner_up, round(margin, 8) AS margin FROM pred""")
def top1_margin(spark, sf):
    scores = F.col("scores")
    return predictions(spark, sf).select(
        "vec_id", argmax(scores).alias("predicted"), "top1", runner_up(scores).alias("runner_up"), F.round("margin", 8).alias("margin")
    )


_MATRIX = f"""{_PRED}, lab AS (SELECT 'class_' || i AS l FROM range(0, 10) r(i)), cm AS (
  SELECT t.l AS true_label, p.l AS pred_label, count(x.vec_id) AS n FROM lab t CROSS JOIN lab p
  LEFT JOIN pred x ON x.true_label = t.l AND x.pred_label = p.l {{extra}} GROUP BY 1, 2), rep0 AS (
  SELECT l AS label, CAST(sum(CASE WHEN true_label = l THEN n ELSE 0 END) AS BIGINT) AS support, sum(CASE WHEN pred_label = l THEN n ELSE 0 END) AS pc,
         CAST(sum(CASE WHEN true_label = l AND pred_label = l THEN n ELSE 0 END) AS BIGINT) AS hits FROM cm, lab GROUP BY 1), rep1 AS (
  SELECT *, {ratio('hits', 'pc')} AS precision, {ratio('hits', 'support')} AS recall FROM rep0), rep AS (
  SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM rep1)"""


@_r.query(f"WITH {_MATRIX.format(extra='')} SELECT true_label, pred_label, n FROM cm")
def confusion_matrix(spark, sf):
    return mc.confusion_matrix(predictions(spark, sf), "true_label", "pred_label", CLASSES)


@_r.query(f"WITH {_MATRIX.format(extra='')} SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support, hits FROM rep")
def multiclass_report(spark, sf):
    report = mc.class_report(mc.confusion_matrix(predictions(spark, sf), "true_label", "pred_label", CLASSES))
    return rounded(report, 8, "precision", "recall", "f1")


@_r.query(f"""WITH {_MATRIX.format(extra='')}
SELECT CAST(sum(support) AS BIGINT) AS rows, round(CAST(sum(hits) AS DOUBLE) / sum(support), 8) AS accuracy, round(avg(precision), 8) AS macro_precision,
       round(avg(recall), 8) AS macro_recall, round(avg(f1), 8) AS macro_f1, round(sum(f1 * support) / sum(support), 8) AS weighted_f1 FROM rep""")
def multiclass_overall(spark, sf):
    report = mc.class_report(mc.confusion_matrix(predictions(spark, sf), "true_label", "pred_label", CLASSES))
    return rounded(mc.overall_report(report), 8, "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


CONFIG = ScoringConfig(threshold=0.5, family_labels=FAMILY_LABELS, top1_threshold=0.1, margin_threshold=0.03)


@_r.query(f"""WITH {_PRED}, b AS (SELECT *, attack_score >= 0.5 AS hit, f1 >= CAST(0.1 AS DOUBLE) AND fm >= CAST(0.03 AS DOUBLE) AS sure FROM pred)
SELECT vec_id, attack_score, CASE WHEN hit THEN 'Attack' ELSE 'Benign' END AS predicted_label, hit AS is_alert, CAST(0.5 AS DOUBLE) AS threshold,
       CASE WHEN hit AND sure THEN fam END AS attack_family, CASE WHEN hit THEN f1 END AS attack_family_confidence,
       CASE WHEN hit THEN round(fm, 8) END AS attack_family_margin, CASE WHEN NOT hit THEN 'benign' WHEN sure THEN 'known' ELSE 'unknown' END AS family_status FROM b""")
def two_stage_status(spark, sf):
    rows = predictions(spark, sf).withColumns(binary_columns(F.col("attack_score"), CONFIG))
    named = rows.withColumns(family_columns(F.col("is_alert"), F.col("family_scores"), CONFIG))
    return rounded(named.select(
        "vec_id", "attack_score", "predicted_label", "is_alert", "threshold", "attack_family",
        "attack_family_confidence", "attack_family_margin", "family_status",
    ), 8, "attack_family_margin")


@_r.query(f"""WITH {_PRED}
SELECT true_label, count(*) AS rows, count(*) FILTER (WHERE attack_score >= 0.5) AS stage1_alert_rows, count(*) FILTER (WHERE attack_score >= 0.5) AS stage2_scored_rows,
       round(CAST(count(*) FILTER (WHERE attack_score >= 0.5) AS DOUBLE) / count(*), 8) AS stage1_alert_rate, count(*) FILTER (WHERE attack_score >= 0.5) = 0 AS zero_pass_through
FROM pred GROUP BY 1""")
def gated_summary(spark, sf):
    rows = predictions(spark, sf).withColumn("is_alert", F.col("attack_score") >= 0.5)
    return rounded(mc.gated_summary(rows, ["true_label"], "is_alert", "pred_label"), 8, "stage1_alert_rate")


@_r.query(f"""WITH {_MATRIX.format(extra='AND x.attack_score >= 0.5')}
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support, hits FROM rep""")
def gated_class_report(spark, sf):
    rows = predictions(spark, sf).withColumn("is_alert", F.col("attack_score") >= 0.5)
    return rounded(mc.gated_class_report(rows, "is_alert", "true_label", "pred_label", CLASSES), 8, "precision", "recall", "f1")


@_r.query(f"""WITH {_MATRIX.format(extra='')}, g AS (
  SELECT l AS label, {ratio('2 * h', 't + c')} AS gf FROM (
    SELECT l, sum(CASE WHEN true_label = l THEN 1 ELSE 0 END) AS t, sum(CASE WHEN pred_label = l THEN 1 ELSE 0 END) AS c,
           sum(CASE WHEN true_label = l AND pred_label = l THEN 1 ELSE 0 END) AS h FROM pred, lab WHERE attack_score >= 0.5 GROUP BY 1))
SELECT label, round(f1, 8) AS oracle_f1, round(gf, 8) AS gated_f1, round(f1 - gf, 8) AS gap FROM rep JOIN g USING (label)""")
def oracle_gated_gap(spark, sf):
    rows = predictions(spark, sf).withColumn("is_alert", F.col("attack_score") >= 0.5)
    full = mc.class_report(mc.confusion_matrix(rows, "true_label", "pred_label", CLASSES))
    gated = mc.gated_class_report(rows, "is_alert", "true_label", "pred_label", CLASSES)
    return rounded(mc.oracle_gap(full, gated, ["label"], "f1"), 8, "oracle_f1", "gated_f1", "gap")


@_r.query(f"WITH {_PRED} SELECT true_label, pred_label, count(*) AS n FROM pred GROUP BY GROUPING SETS ((true_label, pred_label), (pred_label))")
def ood_predicted_families(spark, sf):
    return mc.ood_prediction_counts(predictions(spark, sf), "true_label", "pred_label")


@_r.query(f"""WITH {_PRED}
SELECT true_label, count(*) AS rows, count(pred_label) AS predicted_rows, false AS zero_pass_through,
       count(*) AS top1_count, round(avg(top1), 6) AS top1_mean, round(quantile_cont(top1, 0.5), 6) AS top1_p50, round(quantile_cont(top1, 0.9), 6) AS top1_p90,
       round(avg(margin), 6) AS margin_mean, round(stddev_pop(margin), 6) AS margin_std, round(quantile_cont(margin, 0.1), 6) AS margin_p10
FROM pred GROUP BY 1""")
def ood_profile(spark, sf):
    profile = mc.ood_profile(predictions(spark, sf), "true_label", "pred_label", "top1", "margin")
    chosen = profile.select(
        "true_label", "rows", "predicted_rows", "zero_pass_through", "top1_count", "top1_mean", "top1_p50", "top1_p90",
        "margin_mean", "margin_std", "margin_p10",
    )
    return rounded(chosen, 6, "top1_mean", "top1_p50", "top1_p90", "margin_mean", "margin_std", "margin_p10")


@_r.query(f"WITH {_PRED} SELECT round(avg(top1), 8) AS top1_confidence_threshold, round(avg(margin), 8) AS runner_up_margin_threshold FROM pred")
def abstention_thresholds(spark, sf):
    return rounded(mc.abstention_thresholds(predictions(spark, sf), "top1", "margin"), 8, "top1_confidence_threshold", "runner_up_margin_threshold")


@_r.query(f"""WITH {b.SCORED}, r AS (SELECT model, CASE WHEN split = 'val' THEN 'val' WHEN split = 'ood_attack_holdout' THEN 'ood' END AS part, score, y FROM scored), grid AS (
  SELECT round(i / CAST(100 AS DOUBLE), 10) AS threshold FROM range(0, 101) g(i)), sw0 AS (
  SELECT model, part, threshold, {counts_sql("CAST(score AS DOUBLE) >= threshold")} FROM r, grid WHERE part IS NOT NULL GROUP BY 1, 2, 3), sw AS (
  SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r, {ratio('fp', 'fp + tn')} AS fpr FROM sw0), swf AS (
  SELECT *, {ratio('2 * p * r', 'p + r')} AS f1 FROM sw), pick AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, part ORDER BY fpr <= 0.02 DESC, CASE WHEN fpr <= 0.02 THEN f1 END DESC,
    CASE WHEN fpr <= 0.02 THEN r END DESC, fpr, f1 DESC, r DESC, threshold DESC) AS rn FROM swf) WHERE rn = 1), att AS (
  SELECT r.model, r.part, pick.threshold, {counts_sql("r.score >= CAST(pick.threshold AS FLOAT)", "r.y")} FROM r JOIN pick USING (model, part) GROUP BY 1, 2, 3), df AS (
  SELECT model, part, {counts_sql("score >= CAST(0.5 AS FLOAT)")} FROM r WHERE part IS NOT NULL GROUP BY 1, 2)
SELECT v.model, v.threshold AS val_threshold, round({ratio('v.fp', 'v.fp + v.tn')}, 8) AS val_fpr, round({ratio('2 * v.tp', '2 * v.tp + v.fp + v.fn')}, 8) AS val_f1,
       round({ratio('o.tp', 'o.tp + o.fn')}, 8) AS ood_recall, round({ratio('d.fp', 'd.fp + d.tn')}, 8) AS default_fpr, round({ratio('e.tp', 'e.tp + e.fn')}, 8) AS default_ood_recall
FROM att v JOIN att o ON o.model = v.model AND o.part = 'ood' JOIN df d ON d.model = v.model AND d.part = 'val' JOIN df e ON e.model = v.model AND e.part = 'ood'
WHERE v.part = 'val'""")
def trial_metrics(spark, sf):
    rows = b.scored_events(spark, sf).withColumn(
        "part", F.when(F.col("split") == "val", "val").when(F.col("split") == "ood_attack_holdout", "ood")
    )
    wide = tr.trial_metrics(rows, "model", "part", "y", "score", (0.02,), ev.threshold_grid(101))
    return wide.select(
        "model", F.col("`val_threshold_at_cap_0.020`").alias("val_threshold"),
        F.round("`val_fpr_at_tuned_cap_0.020`", 8).alias("val_fpr"), F.round("`val_f1_at_tuned_cap_0.020`", 8).alias("val_f1"),
        F.round("`ood_recall_at_tuned_cap_0.020`", 8).alias("ood_recall"),
        F.round("`val_fpr_at_default_0.5`", 8).alias("default_fpr"), F.round("`ood_recall_at_default_0.5`", 8).alias("default_ood_recall"),
    )


_PLAN = {"Brand#1": 2, "Brand#2": 1, "Brand#3": 1}


def part_trials(spark, sf):
    """Parts as tuning trials: a brand is a model, a type one trial of it."""
    price = F.avg("p_retailprice")
    return read_table(spark, sf, "part").groupBy(
        F.col("p_brand").alias("model_name"), F.concat("p_brand", F.lit("/"), "p_type").alias("trial_id")
    ).agg(
        F.round(F.avg("p_size") / 1250.0, 4).alias("val_fpr_at_default_0.5"),
        F.round(price / 2000.0, 3).alias("val_f1_at_tuned_cap_0.010"),
        F.round(F.max("p_size") / 100.0, 2).alias("ood_recall_at_tuned_cap_0.020"),
        F.count(F.lit(1)).cast("double").alias("train_seconds"),
    )


_TRIALS = """t AS (
  SELECT p_brand AS model_name, p_brand || '/' || p_type AS trial_id, round(avg(p_size) / CAST(1250 AS DOUBLE), 4) AS fpr, round(avg(p_retailprice) / CAST(2000 AS DOUBLE), 3) AS f1,
         round(max(p_size) / CAST(100 AS DOUBLE), 2) AS ood, CAST(count(*) AS DOUBLE) AS s FROM part GROUP BY 1, 2), rk AS (
  SELECT *, fpr <= 0.02 AS passes_gate, CAST(row_number() OVER (PARTITION BY model_name ORDER BY (fpr <= 0.02) DESC, f1 DESC, fpr, ood DESC, s, trial_id) AS INTEGER) AS trial_rank FROM t)"""


@_r.query(f"WITH {_TRIALS} SELECT model_name, trial_id, passes_gate, trial_rank FROM rk")
def trial_ranking(spark, sf):
    return tr.rank_trials(part_trials(spark, sf)).select("model_name", "trial_id", "passes_gate", "trial_rank")


@_r.query(f"WITH {_TRIALS} SELECT model_name, trial_id, trial_rank FROM rk WHERE trial_rank <= CASE model_name WHEN 'Brand#1' THEN 2 WHEN 'Brand#2' THEN 1 WHEN 'Brand#3' THEN 1 ELSE 0 END")
def promoted_trials(spark, sf):
    return tr.promoted_trials(part_trials(spark, sf), _PLAN).select("model_name", "trial_id", "trial_rank")


def order_curves(spark, sf):
    """Orders as learning curves: a priority is a model, a month a stage."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return read_table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("model"), month.alias("stage_index")
    ).agg(
        F.round(F.avg("o_totalprice") / 500000.0, 3).alias("train_f1"),
        F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 3).alias("val_f1"),
    )


_CURVES = """c AS (
  SELECT o_orderpriority AS model, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS stage, round(avg(o_totalprice) / CAST(500000 AS DOUBLE), 3) AS tr,
         round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*), 3) AS va FROM orders GROUP BY 1, 2), cs AS (
  SELECT model, count(*) AS curve_points, arg_min(tr, stage) AS train_f1_start, arg_min(va, stage) AS val_f1_start, arg_max(tr, stage) AS train_f1_end,
         arg_max(va, stage) AS val_f1_end, max(va) AS best_val_f1 FROM c GROUP BY 1), s AS (
  SELECT cs.*, round(train_f1_end - val_f1_end, 6) AS generalization_gap_end, round(val_f1_end - val_f1_start, 6) AS val_gain, round(train_f1_end - train_f1_start, 6) AS train_gain,
         (SELECT min(stage) FROM c WHERE c.model = cs.model AND c.va = cs.best_val_f1) AS best_stage_index FROM cs)"""


@_r.query(f"WITH {_CURVES} SELECT * FROM s")
def learning_curve_summary(spark, sf):
    return rounded(tr.learning_curve_summary(order_curves(spark, sf)), 6, "generalization_gap_end", "val_gain", "train_gain")


@_r.query(f"""WITH {_CURVES}, m AS (SELECT o_orderpriority AS model, round(avg(o_totalprice), 4) AS test_metric FROM orders GROUP BY 1)
SELECT model, curve_points, best_stage_index, test_metric FROM s JOIN m USING (model)""")
def learning_curve_with_metrics(spark, sf):
    metrics = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("test_metric")
    )
    return tr.curve_with_summary(order_curves(spark, sf), metrics).select("model", "curve_points", "best_stage_index", "test_metric")


@_r.query("""SELECT c_mktsegment AS model_key, 'Segment ' || c_mktsegment AS model_label, round(sum(c_acctbal) / 1000, 4) AS train_seconds, round(avg(c_acctbal), 4) AS val_f1,
  round(max(c_acctbal), 4) AS test_f1, round(min(c_acctbal), 4) AS test_recall, CAST(count(*) AS DOUBLE) AS test_precision, round(avg(c_nationkey), 4) AS test_fpr,
  CAST(max(c_nationkey) AS DOUBLE) AS ood_recall FROM customer GROUP BY 1""")
def benchmark_leaderboard(spark, sf):
    balance = F.col("c_acctbal")
    rows = read_table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("model_key")).agg(
        F.round(F.sum(balance) / 1000, 4).alias("train_seconds"), F.round(F.avg(balance), 4).alias("val_f1"),
        F.round(F.max(balance), 4).alias("test_f1"), F.round(F.min(balance), 4).alias("test_recall"),
        F.count(F.lit(1)).alias("test_precision"), F.round(F.avg("c_nationkey"), 4).alias("test_fpr"), F.max("c_nationkey").alias("ood_recall"),
    )
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return benchmark_summary(rows, {s: f"Segment {s}" for s in segments})


def _log_events(spark, sf):
    line = F.when(
        F.col("event_type") == "click",
        F.concat(F.col("event_id").cast("string"), F.lit(":\tlearn: 0."), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit(" test: 0.5 best")),
    ).when(F.col("event_type") == "view", F.concat(F.lit(" MLP epoch "), F.col("k").cast("string"))).otherwise("starting")
    return b.events(spark, sf).select(F.col("value").alias("time"), line.alias("data"))


@_r.query(f"""WITH {b.EVENTS} SELECT CAST(event_id AS INTEGER) AS iteration, CAST('0.' || lpad(CAST(k AS VARCHAR), 2, '0') AS DOUBLE) AS learn_f1,
  CAST(0.5 AS DOUBLE) AS val_f1, value AS wall_time_seconds FROM ev WHERE event_type = 'click'""")
def training_log_progress(spark, sf):
    return progress_rows(_log_events(spark, sf))


@_r.query(f"WITH {b.EVENTS} SELECT 'MLP' AS model, 'MLP epoch ' || k AS event, value AS wall_time_seconds FROM ev WHERE event_type = 'view'")
def training_log_timeline(spark, sf):
    return epoch_timeline(_log_events(spark, sf), "MLP", "MLP epoch")
