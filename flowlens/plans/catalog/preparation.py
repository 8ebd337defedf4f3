"""Cleaning, file rules, splits, duplicates and label views."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.metadata import binary_label, is_known_bad, is_known_family, path_labels
from flowlens.operators import cleaning, dedupe, reporting, splits, views
from flowlens.operators.multiclass import with_label_index
from flowlens.plans import bindings as b
from flowlens.plans.catalog.registry import Registry, rounded
from flowlens.schemas import KNOWN_ATTACK_FAMILIES, SPLITS
from flowlens.sources.flow_csv import header_reasons
from flowlens.sources.tables import read_table

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks
MEASURES = ["value_text", "k_text"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "unit"]


@_r.query(f"""WITH {b.TEXT_EVENTS}
SELECT event_type, count(*) AS raw_rows,
       count(*) FILTER (WHERE value_text IS NOT NULL AND k_text IS NOT NULL) AS clean_rows_pre_dedupe,
       count(*) FILTER (WHERE value_text IS NULL OR k_text IS NULL) AS dropped_rows_nan_inf
FROM num GROUP BY 1""")
def clean_numeric_manifest(spark, sf):
    return cleaning.cleaning_manifest(b.text_events(spark, sf), MEASURES, ["event_type"])


@_r.query(f"""WITH {b.TEXT_EVENTS}
SELECT event_id, value_text AS value, k_text AS k FROM num WHERE value_text IS NOT NULL AND k_text IS NOT NULL""")
def clean_numeric_rows(spark, sf):
    rows = cleaning.sanitize_numeric(b.text_events(spark, sf), MEASURES)
    return rows.select("event_id", F.col("value_text").alias("value"), F.col("k_text").alias("k"))


def _line_features(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return lines.withColumn("unit", F.col("l_linenumber") - F.col("l_linenumber") + 1).withColumn(
        "split", F.when(F.year("l_shipdate") < 2000, "train").otherwise("test")
    )


@_r.query("""
SELECT 'l_quantity' AS feature, min(l_quantity) AS min_value, max(l_quantity) AS max_value, min(l_quantity) = max(l_quantity) AS is_constant FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), min(l_extendedprice) = max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount), min(l_discount) = max(l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), min(l_tax) = max(l_tax) FROM lineitem
UNION ALL SELECT 'unit', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), true""")
def zero_variance_report(spark, sf):
    return cleaning.variance_report(_line_features(spark, sf), LINE_MEASURES)


@_r.query("""SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  CASE WHEN year(l_shipdate) < 2000 THEN 'train' ELSE 'test' END AS split FROM lineitem""")
def zero_variance_pruned(spark, sf):
    rows = cleaning.drop_leakage(_line_features(spark, sf), ("l_orderkey", "l_partkey", "l_suppkey"))
    pruned, kept, _ = cleaning.prune_zero_variance(rows, LINE_MEASURES, "split")
    out = cleaning.ordered_output(pruned, kept, ["split"])
    cleaning.assert_no_forbidden(out)
    return out


@_r.query(f"""WITH {b.TEXT_EVENTS}
SELECT 'value_text' AS feature, count(*) FILTER (WHERE value_text IS NULL) AS violations FROM num
UNION ALL SELECT 'k_text', count(*) FILTER (WHERE k_text IS NULL) FROM num""")
def non_finite_violations(spark, sf):
    coerced = cleaning.coerce_numeric(b.text_events(spark, sf), MEASURES)
    return cleaning.non_finite_counts(coerced, MEASURES)


@_r.query("""SELECT CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_tax AS FLOAT) AS l_tax FROM lineitem""")
def aligned_features(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return cleaning.align_features(lines, ["l_quantity", "l_tax"])


@_r.query(f"""WITH {b.DOC_FILES}
SELECT source_file, fam AS attack_family, coalesce(mid, fam) AS attack_scenario,
       CASE WHEN fam = 'Benign' THEN 'Benign' ELSE 'Attack' END AS derived_label_binary,
       CASE WHEN fam = 'Benign' THEN 0 ELSE 1 END AS label,
       coalesce(fam || '/' || mid = 'DoS/DoS-TCP_Flood', false) AS known_bad, count(*) AS row_count
FROM files WHERE fam <> 'Other' GROUP BY ALL""")
def path_label_rows(spark, sf):
    docs = b.document_files(spark, sf)
    labelled = docs.withColumns(path_labels(F.col("source_file")))
    named = labelled.filter(is_known_family(F.col("attack_family"))).withColumns({
        "known_bad": is_known_bad(F.col("source_file")),
        "label": binary_label(F.col("derived_label_binary")),
    })
    return named.groupBy(
        "source_file", "attack_family", "attack_scenario", "derived_label_binary", "label", "known_bad"
    ).agg(F.count(F.lit(1)).alias("row_count"))


def _checked_files(spark, sf):
    files = b.document_files(spark, sf).groupBy("source_file", "source").agg(F.count(F.lit(1)).alias("doc_rows"))
    files = files.withColumns(path_labels(F.col("source_file")))
    last = F.when(F.col("source") == "src4", 83).otherwise(84)
    prefix = F.when(F.col("source") == "src6", "g").otherwise("f")
    first = F.when(F.col("source") == "src5", "FlowID").otherwise("Flow ID")
    names = F.transform(F.sequence(F.lit(2), last), lambda i: F.concat(prefix, i.cast("string")))
    headed = files.withColumns({
        "header": F.when(F.col("source") != "src7", F.concat(F.array(first), names)),
        "read_error": F.when(F.col("source") == "src7", "ParserError"),
    })
    return header_reasons(headed)


_FILE_REASON = f"""{b.DOC_FILES}, reasons AS (
  SELECT source_file, fam,
         CASE WHEN source = 'src7' THEN 'read_header_failed:ParserError'
              WHEN source = 'src4' THEN 'unexpected_column_count:83'
              WHEN source = 'src5' THEN 'unexpected_first_column:FlowID'
              WHEN coalesce(fam || '/' || mid = 'DoS/DoS-TCP_Flood', false) THEN 'known_bad_file'
              WHEN source = 'src6' THEN 'feature_schema_mismatch' END AS quarantine_reason
  FROM files GROUP BY ALL)"""


@_r.query(f"""WITH {_FILE_REASON}
SELECT source_file, coalesce(quarantine_reason, 'valid') AS outcome FROM reasons""")
def file_quarantine(spark, sf):
    return _checked_files(spark, sf).select(
        "source_file", F.coalesce("quarantine_reason", F.lit("valid")).alias("outcome")
    )


@_r.query(f"""WITH {_FILE_REASON}
SELECT f.fam AS attack_family, count(*) AS row_count FROM files f
WHERE f.source_file NOT IN (SELECT source_file FROM reasons WHERE quarantine_reason IS NOT NULL) GROUP BY 1""")
def rows_of_valid_files(spark, sf):
    rows = b.document_files(spark, sf)
    bad = _checked_files(spark, sf).filter(F.col("quarantine_reason").isNotNull()).select("source_file")
    kept = rows.join(bad, "source_file", "left_anti").withColumns(path_labels(F.col("source_file")))
    return kept.groupBy("attack_family").agg(F.count(F.lit(1)).alias("row_count"))


@_r.query("""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def dedupe_keep_first(spark, sf):
    docs = read_table(spark, sf, "documents")
    return dedupe.first_copies(docs, ["text"], "doc_id").select("doc_id", "copies")


def _dedupe_input(spark, sf):
    return b.scored_events(spark, sf).select("event_id", "user_id", "event_type", F.floor(F.col("value") / 20).alias("slot"), "split", "model")


_DEDUPE = f"""WITH {b.SCORED}, r AS (
  SELECT event_id, user_id, event_type, CAST(floor(value / 20) AS BIGINT) AS slot, split, model,
         row_number() OVER (PARTITION BY user_id, event_type, floor(value / 20) {{part}} ORDER BY event_id) AS rn FROM scored)
SELECT event_id, user_id, event_type, slot, split, model FROM r WHERE rn = 1"""


@_r.query(_DEDUPE.format(part=", split"))
def dedupe_rows_within_split(spark, sf):
    return dedupe.keep_first(_dedupe_input(spark, sf), ["user_id", "event_type", "slot"], ["event_id"], across=["split"])


@_r.query(_DEDUPE.format(part=""))
def dedupe_rows_across_splits(spark, sf):
    return dedupe.keep_first(_dedupe_input(spark, sf), ["user_id", "event_type", "slot"], ["event_id"])


@_r.query("""SELECT source, count(*) AS rows, count(DISTINCT text) AS distinct_rows,
       count(*) - count(DISTINCT text) AS duplicate_rows FROM documents GROUP BY 1""")
def dedupe_accounting(spark, sf):
    return dedupe.duplicate_accounting(read_table(spark, sf, "documents"), ["text"], ["source"])


_OOD = ("es",)
_TARGETS = f"""{b.DOC_MANIFEST}, tot AS (
  SELECT attack_family, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_rows,
         attack_family = 'es' OR count(*) < 3 AS is_held_out FROM manifest GROUP BY 1), tg AS (
  SELECT *, CASE WHEN is_held_out THEN 0 ELSE CAST(round_even(total_rows * CAST(0.15 AS DOUBLE), 0) AS BIGINT) END AS val_target,
         CASE WHEN is_held_out THEN 0 ELSE CAST(round_even(total_rows * CAST(0.15 AS DOUBLE), 0) AS BIGINT) END AS test_target FROM tot), tgt AS (
  SELECT *, CASE WHEN is_held_out THEN 0 ELSE total_rows - val_target - test_target END AS train_target,
         CASE WHEN is_held_out THEN total_rows ELSE 0 END AS ood_target FROM tg)"""


@_r.query(f"""WITH {_TARGETS}
SELECT attack_family, files, total_rows, is_held_out, val_target, test_target, train_target, ood_target FROM tgt""")
def split_targets(spark, sf):
    return splits.split_targets(b.document_manifest(spark, sf), _OOD)


_ASSIGN = f"""{_TARGETS}, o AS (
  SELECT m.attack_family, m.source_file, m.n, t.train_target, t.val_target, t.test_target,
         row_number() OVER (PARTITION BY m.attack_family ORDER BY m.n DESC, md5('42|' || m.source_file), m.source_file) AS pos
  FROM manifest m JOIN tgt t USING (attack_family) WHERE NOT t.is_held_out), fold AS (
  SELECT attack_family, CAST(0 AS BIGINT) AS pos, '' AS source_file, '' AS split, CAST(0 AS BIGINT) AS tr, CAST(0 AS BIGINT) AS va, CAST(0 AS BIGINT) AS te
  FROM o WHERE pos = 1
  UNION ALL
  SELECT attack_family, pos, source_file, split, tr + CASE WHEN split = 'train' THEN n ELSE 0 END,
         va + CASE WHEN split = 'val' THEN n ELSE 0 END, te + CASE WHEN split = 'test' THEN n ELSE 0 END
  FROM (SELECT f.attack_family, o.pos, o.source_file, f.tr, f.va, f.te, o.n,
               CASE o.pos WHEN 1 THEN 'train' WHEN 2 THEN 'val' WHEN 3 THEN 'test' ELSE
                 list_min([
                   {{'r': CASE WHEN o.test_target = 0 THEN 1e300 ELSE f.te / o.test_target END, 'g': abs(f.te + o.n - o.test_target), 's': 'test'}},
                   {{'r': CASE WHEN o.train_target = 0 THEN 1e300 ELSE f.tr / o.train_target END, 'g': abs(f.tr + o.n - o.train_target), 's': 'train'}},
                   {{'r': CASE WHEN o.val_target = 0 THEN 1e300 ELSE f.va / o.val_target END, 'g': abs(f.va + o.n - o.val_target), 's': 'val'}}]).s END AS split
        FROM fold f JOIN o ON o.attack_family = f.attack_family AND o.pos = f.pos + 1) x), assigned AS (
  SELECT source_file, split FROM fold WHERE pos > 0
  UNION ALL SELECT m.source_file, 'ood_attack_holdout' FROM manifest m JOIN tgt t USING (attack_family) WHERE t.is_held_out)"""


@_r.query(f"WITH RECURSIVE {_ASSIGN} SELECT source_file, split FROM assigned")
def split_assignment(spark, sf):
    return splits.assign_splits(b.document_manifest(spark, sf), 42, _OOD)


def _stamped(spark, sf):
    rows = read_table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("attack_family"), F.concat("lang", F.lit("/"), "source").alias("source_file")
    )
    return splits.stamp_splits(rows, splits.assign_splits(b.document_manifest(spark, sf), 42, _OOD))


@_r.query(f"""WITH RECURSIVE {_ASSIGN}
SELECT d.lang AS attack_family, a.split, count(*) AS rows
FROM documents d JOIN assigned a ON a.source_file = d.lang || '/' || d.source GROUP BY 1, 2""")
def split_stamped_rows(spark, sf):
    return views.label_distribution(_stamped(spark, sf), "attack_family")


@_r.query("""SELECT * FROM (VALUES ('train', 'val', 0::BIGINT), ('train', 'test', 0::BIGINT), ('train', 'ood_attack_holdout', 0::BIGINT),
  ('val', 'test', 0::BIGINT), ('val', 'ood_attack_holdout', 0::BIGINT), ('test', 'ood_attack_holdout', 0::BIGINT))
  t(left_split, right_split, shared_files)""")
def split_disjointness(spark, sf):
    return splits.split_intersections(_stamped(spark, sf), SPLITS)


@_r.query(f"""WITH {b.SCORED}
SELECT CAST(user_id AS VARCHAR) AS source_file, min(split) AS first_split, max(split) AS last_split
FROM scored GROUP BY 1 HAVING min(split) <> max(split)""")
def split_overlaps(spark, sf):
    rows = b.scored_events(spark, sf).select(F.col("user_id").cast("string").alias("source_file"), "split")
    return splits.overlapping_files(rows)


@_r.query("""SELECT d.lang AS split, l.quality AS quality, count(*) AS rows
FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def label_distribution(spark, sf):
    rows = read_table(spark, sf, "labels").join(
        read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split")), "doc_id"
    )
    return views.label_distribution(rows, "quality")


_VIEW = f"""WITH {b.SCORED}, kept AS (
  SELECT split, family FROM scored WHERE CASE WHEN split = 'ood_attack_holdout' THEN family IN ('BruteForce', 'Recon')
    ELSE family IN ({{labels}}) END)
SELECT split, family, count(*) AS rows, '{{view}}' AS view FROM kept GROUP BY ROLLUP (split, family)"""


@_r.query(_VIEW.format(view="attack_only", labels="'DDoS', 'DoS', 'Mirai', 'Spoofing', 'Web-Based'"))
def attack_only_view(spark, sf):
    return views.view_report(b.scored_events(spark, sf), views.ATTACK_ONLY, "family")


@_r.query(_VIEW.format(view="direct_multiclass", labels="'Benign', 'DDoS', 'DoS', 'Mirai', 'Spoofing', 'Web-Based'"))
def multiclass_view(spark, sf):
    return views.view_report(b.scored_events(spark, sf), views.DIRECT_MULTICLASS, "family")


@_r.query(f"""WITH {b.SCORED}, placed AS (SELECT * REPLACE (CASE WHEN family = 'BruteForce' THEN 'ood_attack_holdout' WHEN split = 'ood_attack_holdout' THEN 'train' ELSE split END AS split) FROM scored)
SELECT event_id, user_id, event_type, k, value, y, split, model, family FROM placed WHERE family <> 'Benign'""")
def derived_view_rows(spark, sf):
    """All rows, with the held-out family in the held-out split alone, as the guard of the view wants it."""
    held = F.when(F.col("family") == "BruteForce", "ood_attack_holdout").when(F.col("split") == "ood_attack_holdout", "train")
    placed = b.scored_events(spark, sf).withColumn("split", held.otherwise(F.col("split"))).drop("score")
    return views.derive_view(placed, views.ATTACK_ONLY, "family")


@_r.query(f"""WITH {b.SCORED}
SELECT split, family, count(*) AS rows FROM scored
WHERE (split = 'ood_attack_holdout') <> (family = 'BruteForce') GROUP BY 1, 2""")
def unexpected_labels(spark, sf):
    return views.unexpected_labels(b.scored_events(spark, sf), views.ATTACK_ONLY, "family")


@_r.query(f"""WITH {b.SCORED}
SELECT event_id, CAST(list_position(['DDoS', 'DoS', 'Mirai', 'Spoofing', 'Web-Based'], family) - 1 AS INTEGER) AS label_index
FROM scored WHERE family IN ('DDoS', 'DoS', 'Mirai', 'Spoofing', 'Web-Based')""")
def family_label_index(spark, sf):
    return with_label_index(b.scored_events(spark, sf), "family", KNOWN_ATTACK_FAMILIES).select("event_id", "label_index")


@_r.query(f"""WITH {b.TEXT_EVENTS}, clean AS (SELECT * FROM num WHERE value_text IS NOT NULL AND k_text IS NOT NULL)
SELECT (SELECT count(*) FROM num) AS raw_rows, (SELECT count(*) FROM clean) AS clean_rows,
       (SELECT count(*) FROM num) - (SELECT count(*) FROM clean) AS dropped_rows,
       (SELECT count(DISTINCT event_type) FROM num) AS files,
       (SELECT count(*) FROM (SELECT DISTINCT event_type, value_text, k_text FROM clean)) AS rows_after_dedupe,
       (SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT event_type, value_text, k_text FROM clean)) AS duplicate_rows""")
def preparation_rollup(spark, sf):
    rows = b.text_events(spark, sf)
    manifest = cleaning.cleaning_manifest(rows, MEASURES, ["event_type"])
    kept = dedupe.keep_first(cleaning.sanitize_numeric(rows, MEASURES), ["event_type", *MEASURES], ["event_id"])
    return reporting.pipeline_rollup(manifest, kept)


@_r.query("""SELECT l_returnflag, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem GROUP BY 1""")
def pruned_scan(spark, sf):
    from flowlens.sources.tables import read_columns

    rows = read_columns(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean_quantity")), 4, "mean_quantity")
