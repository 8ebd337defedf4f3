"""CSV tree to frozen splits and views, with faulty files."""

import csv

import pytest
from pyspark.sql import functions as F

from flowlens.operators import cleaning, dedupe, splits, views
from flowlens.plans.prepare import prepare, write_views
from flowlens.sources import flow_csv, tables

HEADER = ["Flow ID"] + [f"feature_{i}" for i in range(1, 80)] + ["Src IP", "Dst IP", "Timestamp", "Label"]


def write(path, rows, header=HEADER):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as handle:
        writer = csv.writer(handle)
        writer.writerow(header)
        writer.writerows(rows)


def row(base, second=None):
    values = [str(base + i / 10) for i in range(79)]
    values[1] = second if second is not None else values[1]
    values[2] = "5"
    return ["id", *values, "1.1.1.1", "2.2.2.2", "2024", "L"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "raw"
    for i in range(3):
        write(root / f"Benign/benign_{i}.csv", [row(i), row(i), row(i + 0.5, "inf" if i == 0 else "1")])
        write(root / f"DoS/DoS-UDP_Flood/dos_{i}.csv", [row(10 + i), row(20, "7")])
    write(root / "BruteForce/SSH/bruteforce_0.csv", [row(30), row(31, "oops")])
    write(root / "DoS/DoS-TCP_Flood/x.csv", [row(40)])
    write(root / "Mirai/short.csv", [row(1)[:-1]], HEADER[:-1])
    write(root / "Mirai/first.csv", [row(1)], ["ID", *HEADER[1:]])
    write(root / "Recon/names.csv", [row(1)], ["Flow ID", "other", *HEADER[2:]])
    (root / "Mirai/empty.csv").write_text("\n")
    write(root / "Elsewhere/y.csv", [row(1)])
    return tmp_path


def test_file_checks(spark, tree):
    files = flow_csv.discover_files(spark, str(tree / "raw"))
    assert files.filter("attack_family = 'Elsewhere'").count() == 0
    checked = flow_csv.header_reasons(flow_csv.with_headers(files))
    got = {r.source_file: r.quarantine_reason for r in flow_csv.quarantine_manifest(checked).collect()}
    assert got == {
        "DoS/DoS-TCP_Flood/x.csv": "known_bad_file", "Mirai/short.csv": "unexpected_column_count:83",
        "Mirai/first.csv": "unexpected_first_column:ID", "Recon/names.csv": "feature_schema_mismatch",
        "Mirai/empty.csv": "read_header_failed:EOFError",
    }
    scenario = {r.source_file: r.attack_scenario for r in files.collect()}
    assert scenario["DoS/DoS-UDP_Flood/dos_0.csv"] == "DoS-UDP_Flood" and scenario["Benign/benign_0.csv"] == "Benign"


def test_prepare_end_to_end(spark, tree):
    out = str(tree / "out")
    prepared = prepare(spark, str(tree / "raw"), out)
    assert prepared.dropped_features == [f for f in prepared.dropped_features if f == "feature_3"]
    rows = spark.read.parquet(prepared.splits)
    assert not set(rows.columns) & {"Flow ID", "Src IP", "Label", "is_clean", "file_no"}
    assert rows.filter("attack_family = 'BruteForce'").select("split").distinct().collect()[0][0] == "ood_attack_holdout"
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "val", "test", "ood_attack_holdout"}
    # Each Benign file loses one copy; "inf" and "oops" rows are gone; the shared DoS row stays once per split.
    counts = {r.attack_family: r["count"] for r in rows.groupBy("attack_family").count().collect()}
    assert counts == {"Benign": 5, "DoS": 6, "BruteForce": 1}
    report = spark.read.json(f"{out}/reports/cleaning").first()
    assert (report.raw_rows, report.clean_rows, report.dropped_rows, report.duplicate_rows, report.files) == (17, 15, 2, 3, 7)
    across = prepare(spark, str(tree / "raw"), str(tree / "out2"), across_splits=True)
    assert spark.read.parquet(across.splits).filter("attack_family = 'DoS'").count() == 4
    write_views(spark, prepared.splits, str(tree / "views"))
    attack = spark.read.parquet(str(tree / "views/attack_only"))
    assert attack.filter("derived_label_family = 'Benign'").count() == 0 and attack.filter("split = 'train'").count() > 0


def view_input(spark, rows):
    return spark.createDataFrame(rows, "split string, derived_label_family string")


def test_view_guards(spark):
    good = [("train", "Benign"), ("train", "DoS"), ("val", "Spoofing"), ("test", "Web-Based"), ("ood_attack_holdout", "Recon")]
    assert views.derive_view(view_input(spark, good), views.ATTACK_ONLY).count() == 4
    assert views.derive_view(view_input(spark, good), views.DIRECT_MULTICLASS).count() == 5
    with pytest.raises(ValueError, match=r"split train: \['BruteForce'\]"):
        views.derive_view(view_input(spark, [*good, ("train", "BruteForce")]), views.ATTACK_ONLY)
    with pytest.raises(ValueError, match="no rows in split val"):
        views.derive_view(view_input(spark, [*good[:2], ("val", "Benign"), *good[3:]]), views.ATTACK_ONLY)


def test_small_families_go_to_the_ood_split(spark):
    manifest = spark.createDataFrame(
        [("a", "Benign", 10), ("b", "Benign", 5)] + [(f"d{i}", "DoS", 10 - i) for i in range(6)] + [("e", "DDoS", 0), ("f", "DDoS", 0), ("g", "DDoS", 0), ("h", "DDoS", 0)],
        "source_file string, attack_family string, clean_rows_pre_dedupe long",
    )
    got = {r.source_file: r.split for r in splits.assign_splits(manifest).collect()}
    assert got["a"] == got["b"] == "ood_attack_holdout" and len(got) == 12
    assert [got[f"d{i}"] for i in range(3)] == ["train", "val", "test"]
    splits.assert_disjoint(splits.assign_splits(manifest))


def test_hot_group_of_copies(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("a"), F.col("id").alias("n"), F.col("id").cast("string").alias("tag"))
    kept = dedupe.keep_first(df, ["a"], ["n"])
    assert kept.count() == 5000 - 1667 + 1 and kept.filter("a = -1").first().tag == "0"


def test_output_assertions(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("inf"), 2.0)], "a double, b double")
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        cleaning.assert_finite(df, ["a", "b"])
    with pytest.raises(ValueError, match="forbidden"):
        cleaning.assert_no_forbidden(df.withColumnRenamed("a", "Flow ID"))


def test_alignment(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "3")], "b string, a string")
    with pytest.raises(ValueError, match="missing required"):
        cleaning.align_features(df, ["a", "zz"])
    assert cleaning.align_features(df, ["a"]).columns == ["a"]
    with pytest.raises(Exception, match="column b"):
        cleaning.align_features(df, ["a", "b"]).collect()
    assert cleaning.align_features(spark.createDataFrame([("inf",)], "a string"), ["a"]).first().a == float("inf")


def test_suffix_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for name in ("p.csv", "p.parquet"):
        tables.write_predictions(df, str(tmp_path / name))
        assert tables.read_scoring_input(spark, str(tmp_path / name), limit=5).count() == 1
    with pytest.raises(ValueError):
        tables.read_scoring_input(spark, "p.txt")


def test_cells_of_many_columns_are_numbers_as_by_columns(spark):
    """The batch rule for wide tables and the column rule agree on odd cells."""
    cells = ["1", " 2.5\t", "+3", "-.5e2", "5.", ".", "", None, "1_000", "12d", "0x1p3", "inf", "NaN", "Infinity", "1e400", "-1e999",
             "1e-400", "-0", "٣", "1 2", "\n7\x0b", "7\u0085", "7\u00a0", "0.1", "123456789012345678901234567890", "4.9e-324", "e5", "+"]
    rows = spark.createDataFrame([(c, cells[-1 - i], f"file-{i}") for i, c in enumerate(cells)], "`a b` string, c string, source_file string")
    want = cleaning.coerce_numeric(rows, ["a b", "c"], "ok").select("a b", "c", "source_file", "ok")
    got = cleaning.coerce_cells(rows, ["a b", "c"], ["source_file"], "ok")
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.filter("`a b` IS NOT NULL").count() == 11


def test_tree_gets_more_files_with_more_rows(spark, tmp_path, monkeypatch):
    """A family of many rows is not written by four tasks, and the result is the same."""
    from flowlens.plans.catalog import streams

    spark.range(600).selectExpr(
        "id event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, id % 28) ts", "id % 7 user_id",
        "if(id % 3 = 0, 'view', 'click') event_type", "id % 11 + 0.5D value", "concat('{\"k\": ', id % 5, '}') props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    counted = []
    for size in (50_000, 20):
        monkeypatch.setattr(streams, "TREE_FILE_ROWS", size)
        folder = tmp_path / f"size-{size}"
        monkeypatch.setattr(streams, "work_folder", lambda spark, purpose: str(folder))
        counted.append(sorted(map(tuple, streams.prepared_csv_tree(spark, str(tmp_path)).collect())))
    assert counted[0] == counted[1] and sum(r[2] for r in counted[0]) == 110
    assert len(list((tmp_path / "size-20/raw/DoS/scenario").glob("*.csv"))) == 20
