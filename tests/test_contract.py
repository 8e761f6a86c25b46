from dataclasses import replace

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparrowline.streaming.contract import IMPRESSION_EVENT as C
from sparrowline.streaming.contract import FieldSpec, contract_of, evolution, main, spark_type
from sparrowline.streaming.rules import enforce

GOOD = {"schema_version": "1.0.0", "impression_id": "a" * 64, "event_ts": "2025-01-01T01:00:00.000000Z", "produced_at": "2025-01-01T01:00:02.000000Z", "user_id": "5", "campaign_id": 70003, "is_click": True, "is_conversion_path": False, "cost": 0.00123}


def test_schemas_agree():
    s = C.json_schema()
    assert set(s["properties"]) == set(C.spark_schema().fieldNames()) and len(C.fields) == 25
    assert len(s["required"]) == 9 and s["additionalProperties"] is True
    assert all(f.nullable for f in C.spark_schema())
    assert s["properties"]["cat1"] == {"anyOf": [{"type": "string"}, {"type": "null"}]}


def test_good_event_and_unknown_fields():
    assert C.validate(GOOD) == [] and C.validate(GOOD | {"new": 1, "cat1": None}) == []


@pytest.mark.parametrize("change, path", [
    ({"campaign_id": "x"}, "campaign_id"), ({"cost": -0.5}, "cost"), ({"schema_version": "2.0.0"}, "schema_version"), ({"impression_id": "zz"}, "impression_id"),
    ({"event_ts": "yesterday"}, "event_ts"), ({"is_click": 1}, "is_click"), ({"click_pos": -3}, "click_pos"), ({"user_id": None}, "user_id"),
])
def test_faults_are_found(change, path):
    assert [m.split(":")[0] for m in C.validate(GOOD | change)] == [path]


def test_missing_field():
    assert C.validate({k: v for k, v in GOOD.items() if k != "user_id"}) == ["<root>: 'user_id' is a required property"]


def test_types():
    assert spark_type("decimal(18,8)").simpleString() == "decimal(18,8)"
    with pytest.raises(ValueError):
        spark_type("map")


def test_evolution_follows_versions():
    assert evolution(C, C) == (True, [])
    assert evolution(C, replace(C, fields=(*C.fields, FieldSpec("x", "int"))))[0] is False
    assert evolution(C, replace(C, version="1.0.1", fields=(*C.fields, FieldSpec("x", "int"))))[0] is True


@given(st.integers(0, 24))
def test_removing_any_field_breaks(k):
    less = replace(C, version="1.9.0", fields=C.fields[:k] + C.fields[k + 1 :])
    ok, why = evolution(C, less)
    assert not ok and f"removed:{C.fields[k].name}" in why


def test_gate_from_files(tmp_path, capsys):
    d = "contract: c\nversion: {v}\ntransport: {{topic: t, key: a}}\nfields:\n  - {{name: a, type: long, required: true}}\n{more}"
    (tmp_path / "old.yaml").write_text(d.format(v="1.0.0", more="  - {name: b, type: string}\n"))
    (tmp_path / "new.yaml").write_text(d.format(v="1.1.0", more=""))
    assert main([str(tmp_path / "old.yaml"), str(tmp_path / "new.yaml")]) == 1
    assert "BLOCKED removed:b" in capsys.readouterr().out
    assert main([str(tmp_path / "old.yaml")] * 2) == 0


def test_quality_rule_from_a_file():
    c = contract_of({"contract": "c", "version": "1.0.0", "transport": {"topic": "t", "key": "a"}, "fields": [{"name": "a", "type": "int", "constraints": {"minimum": 1}}], "quality_rules": [{"name": "not_from_future", "max_skew_seconds": 7}]})
    assert c.max_skew_seconds == 7 and c.fields[0].minimum == 1


@pytest.mark.parametrize("value, reason", [
    (None, "missing_required:schema_version"), ("", "missing_required:schema_version"), ("{}", "missing_required:schema_version"), ("null", "invalid_json"), ("[1]", "invalid_json"), ('{"cost": "x"}', "invalid_json"),
    ('{"schema_version": "1.0.0", "campaign_id": "x"}', "type_mismatch"), ('{"schema_version": "abc"}', "missing_required:impression_id"), ('{"schema_version": "2.0.0"}', "unsupported_schema_version"),
])
def test_reasons_of_odd_records(spark, value, reason):
    df = spark.createDataFrame([(value,)], "value string").selectExpr("cast(value as binary) as value")
    assert enforce(df, C).first().reject_reason == reason


def test_version_that_is_no_number_fails_its_pattern(spark):
    import json

    df = spark.createDataFrame([(json.dumps(GOOD | {"schema_version": "abc"}),), (json.dumps(GOOD),)], "value string").selectExpr("cast(value as binary) as value")
    assert [r.reject_reason for r in enforce(df, C).collect()] == ["constraint:schema_version:pattern", None]
