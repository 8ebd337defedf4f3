import json

import pytest

from flowlens.operators import adapter as ad
from flowlens.operators import contract as ct
from flowlens.sources.jsonl import parse_lines

FEATURES = ("Src Port", "Dst Port", "Protocol", "Flow Duration")
CONTRACT = ct.FeatureContract(FEATURES, {"SrcPort": "Src Port", "DstPort": "Dst Port", "FlowDuration": "Flow Duration"})
GOOD = {"SrcPort": "1234", "DstPort": 80, "Protocol": "6", "FlowDuration": "42.5"}


def run(spark, *lines):
    rows = [(i, line if isinstance(line, str) else json.dumps(line)) for i, line in enumerate(lines)]
    parsed = parse_lines(spark.createDataFrame(rows, "record_index long, value string"))
    return {r.record_index: r for r in ct.validate(parsed, CONTRACT, keep_reason="parse_reason").collect()}


def test_valid_record(spark):
    row = run(spark, {**GOOD, "collector_id": "sensor-a"})[0]
    assert row.reason is None and row.passthrough == {"collector_id": "sensor-a"}
    assert list(row.features) == [1234.0, 80.0, 6.0, 42.5]


def test_reasons_in_order(spark):
    no_duration = {k: v for k, v in GOOD.items() if k != "FlowDuration"}
    got = run(
        spark, no_duration, {**GOOD, "Protocol": "tcp"}, {**GOOD, "Src Port": 1}, '{"broken_json": true', "[1]", "7", "null",
        {**no_duration, "Src Port": 1, "Protocol": "tcp"},
    )
    assert (got[0].reason, got[0].missing_features) == (ct.MISSING, ["Flow Duration"])
    assert (got[1].reason, got[1].non_numeric_features) == (ct.NON_NUMERIC, ["Protocol"])
    assert (got[2].reason, got[2].alias_collisions) == (ct.ALIAS_COLLISION, ["Src Port"])
    assert [got[i].reason for i in (3, 4, 5, 6)] == ["invalid_json"] + ["invalid_record_type"] * 3
    assert got[7].reason == ct.ALIAS_COLLISION


@pytest.mark.parametrize("value", [None, "", " ", True, "inf", "-Infinity", "nan", "1d", "2f", "0x10", "1e999", [1], {"a": 1}, "1__0", "_1"])
def test_non_numeric_values(spark, value):
    assert run(spark, {**GOOD, "Protocol": value})[0].reason == ct.NON_NUMERIC


@pytest.mark.parametrize("value,number", [(" 6 ", 6.0), ("1_000", 1000.0), ("+.5", 0.5), ("5.", 5.0), ("1e3", 1000.0), (-0.25, -0.25)])
def test_numeric_values(spark, value, number):
    assert run(spark, {**GOOD, "Protocol": value})[0].features["Protocol"] == number


def test_json_details(spark):
    line = json.dumps(GOOD)
    got = run(spark, line + " trailing", line + " " + line, line[:-1] + ', "Protocol": 17}', "   ", "{'a': 1}", line.replace('"6"', "NaN"))
    assert got[0].reason == got[1].reason == "invalid_json"
    assert got[2].features["Protocol"] == 17.0  # the last of repeated keys counts
    assert 3 not in got and got[4].reason == "invalid_json"
    assert got[5].reason == ct.NON_NUMERIC


def test_bad_contracts():
    for aliases in ({"a": "a"}, {"a": "missing"}):
        with pytest.raises(ValueError):
            ct.FeatureContract(("a", "b"), aliases)
    with pytest.raises(ValueError):
        ct.FeatureContract((), {})
    assert len(ct.FeatureContract().features) == 72


PROFILE = ad.AdapterProfile(
    "sample", {"SrcPort": "Src Port", "DstPort": "Dst Port", "FlowDuration": "Flow Duration", "Protocol": "Protocol"},
    {"flow_id": "source_flow_id"}, ("flow_family",),
)


def adapt(spark, *records):
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    parsed = parse_lines(spark.createDataFrame(rows, "record_index long, value string"))
    return ad.adapt(parsed, PROFILE, CONTRACT, keep_reason="parse_reason")


def test_adapter_reasons(spark):
    got = {r.record_index: r for r in adapt(
        spark, {**GOOD, "flow_id": "f1", "flow_family": "x"}, {**GOOD, " ": 1}, {**GOOD, " SrcPort": 1},
        {**GOOD, "Src Port": 5, "b": 1}, {"SrcPort": 1}, {**GOOD, "Protocol": "tcp"},
    ).collect()}
    assert got[0].reason is None and got[0].metadata == {"source_flow_id": "f1"} and got[0].controlled_extras == {"flow_family": "x"}
    assert got[1].reason == ad.BLANK_KEYS and got[1].blank_source_keys == [" "]
    assert got[2].reason == ad.KEY_COLLISION and got[2].normalized_key_collisions == ["SrcPort"]
    # A canonical name that has an alias is not an accepted source key.
    assert got[3].reason == ad.UNMAPPED and got[3].unmapped_fields == ["Src Port", "b"]
    assert got[4].reason == ct.MISSING and got[5].non_numeric_features == ["Protocol"]


def test_adapter_events_redact_unless_asked(spark):
    adapted = adapt(spark, {**GOOD, "Protocol": "tcp", "flow_id": "secret"})
    hidden = json.loads(ad.adapter_quarantine_events(adapted).first().value)
    assert hidden["source_record"] == {"redacted": True, "field_count": 5} and hidden["metadata"] == {"redacted": True, "field_count": 1}
    assert hidden["metadata_redacted"] is True and hidden["controlled_extras_redacted"] is False
    shown = json.loads(ad.adapter_quarantine_events(adapted, include_source=True).first().value)
    assert shown["source_record"]["flow_id"] == "secret" and shown["metadata"] == {"source_flow_id": "secret"}


def test_shipped_profiles_fit_the_contract():
    contract = ct.FeatureContract()
    for profile in ad.PROFILES.values():
        profile.check_against(contract)
        assert len(profile.accepted_keys()) == 72 + 3 + 3
    with pytest.raises(KeyError):
        ad.require_profile("nope")
    with pytest.raises(ValueError):
        ad.AdapterProfile("p", {"a": "x", "b": "x"})
    with pytest.raises(ValueError):
        ad.AdapterProfile("p", {"a": "x"}, {"a": "y"})
    with pytest.raises(ValueError):
        ad.AdapterProfile("p", {"a": "x"}).check_against(contract)


def test_full_surface_round_trip(spark):
    """A record under the primary profile's 72 source keys validates and flattens."""
    record = {k: i for i, k in enumerate(ad.PRIMARY_PROFILE.feature_map)}
    parsed = parse_lines(spark.createDataFrame([(json.dumps({**record, "flow_id": "f"}),)], "value string"))
    adapted = ad.adapt(parsed, ad.PRIMARY_PROFILE, keep_reason="parse_reason")
    flat = ad.adapted_rows(adapted, ad.PRIMARY_PROFILE)
    row = flat.first()
    assert row["Src Port"] == 0.0 and row["source_flow_id"] == "f" and len(flat.columns) == 72 + 1 + 3 + 3
    assert ad.to_source_names(flat, ad.PRIMARY_PROFILE).columns[0] == "SrcPort"
