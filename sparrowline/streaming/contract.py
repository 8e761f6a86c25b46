"""Event contracts: one specification gives the parse schema, the ordered
rules, a JSON Schema, a validator for producers and the evolution gate."""

from __future__ import annotations

import argparse
import re
import sys
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

import yaml
from pyspark.sql import types as T

SIMPLE = {"string": T.StringType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
#: A reader of the second type reads the first.
WIDER = {"int": {"long", "double"}, "long": {"double"}, "float": {"double"}}


def spark_type(kind: str) -> T.DataType:
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    if kind not in SIMPLE:
        raise ValueError(f"unknown contract type {kind!r}")
    return SIMPLE[kind]


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    required: bool = False
    minimum: float | None = None
    pattern: str | None = None
    pii: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Contract:
    name: str
    version: str
    topic: str
    key: str
    fields: tuple[FieldSpec, ...]
    max_skew_seconds: int = 300
    slo: dict = field(default_factory=dict)

    @property
    def number(self) -> tuple[int, ...]:
        return tuple(int(x) for x in self.version.split("."))

    @property
    def major(self) -> int:
        return self.number[0]

    def spark_schema(self, corrupt: str | None = None) -> T.StructType:
        """All fields nullable: what is required is a rule."""
        s = T.StructType([T.StructField(f.name, spark_type(f.kind), True, {"pii": f.pii} if f.pii else None) for f in self.fields])
        return s.add(corrupt, T.StringType()) if corrupt else s

    def json_schema(self) -> dict[str, Any]:
        return {
            "$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"/schemas/{self.name}-{self.version}.json", "title": self.name, "type": "object",
            "properties": {f.name: _json_field(f) for f in self.fields}, "required": [f.name for f in self.fields if f.required], "additionalProperties": True,
        }

    def validate(self, event: dict) -> list[str]:
        """What a producer's event violates, as sorted `path: message`."""
        found = [f"<root>: '{f.name}' is a required property" for f in self.fields if f.required and f.name not in event]
        for f in self.fields:
            if f.name in event and (event[f.name] is not None or f.required):
                found += [f"{f.name}: {m}" for m in _value_faults(f, event[f.name])]
        return sorted(found)


def _json_field(f: FieldSpec) -> dict[str, Any]:
    kind = "number" if f.kind in ("float", "double") or f.kind.startswith("decimal") else {"string": "string", "timestamp": "string", "int": "integer", "long": "integer", "boolean": "boolean"}.get(f.kind)
    if kind is None:
        raise ValueError(f"unknown contract type {f.kind!r}")
    s: dict[str, Any] = {"type": kind}
    if f.kind == "timestamp":
        s["format"] = "date-time"
    s |= {k: v for k, v in (("minimum", f.minimum), ("pattern", f.pattern)) if v is not None}
    out = s if f.required else {"anyOf": [s, {"type": "null"}]}
    return out | ({"description": f.description} if f.description else {})


def _value_faults(f: FieldSpec, v: Any) -> list[str]:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    want = _json_field(replace(f, required=True))["type"]
    right = {"string": isinstance(v, str), "boolean": isinstance(v, bool), "number": number, "integer": number and float(v).is_integer()}[want]
    if not right:
        return [f"{v!r} is not of type '{want}'"]
    found = []
    if f.kind == "timestamp":
        try:
            ok = datetime.fromisoformat(v.replace("Z", "+00:00")).tzinfo is not None
        except ValueError:
            ok = False
        if not ok:
            found.append(f"{v!r} is not a 'date-time'")
    if f.minimum is not None and number and v < f.minimum:
        found.append(f"{v!r} is less than the minimum of {f.minimum}")
    if f.pattern is not None and isinstance(v, str) and not re.search(f.pattern, v):
        found.append(f"{v!r} does not match {f.pattern!r}")
    return found


def load_contract(path: str) -> Contract:
    with open(path, encoding="utf-8") as f:
        return contract_of(yaml.safe_load(f))


def contract_of(d: dict) -> Contract:
    rules = {r["name"]: r for r in d.get("quality_rules", [])}
    fields = tuple(FieldSpec(f["name"], f["type"], bool(f.get("required")), (c := f.get("constraints") or {}).get("minimum"), c.get("pattern"), f.get("pii"), f.get("description", "")) for f in d["fields"])
    return Contract(d["contract"], str(d["version"]), d["transport"]["topic"], d["transport"]["key"], fields, int(rules.get("not_from_future", {}).get("max_skew_seconds", 300)), d.get("slo", {}))


def breaking(old: Contract, new: Contract) -> list[str]:
    """What would break a consumer of `old` that reads `new`."""
    before, after = ({f.name: f for f in c.fields} for c in (old, new))
    found = []
    for name, a in before.items():
        b = after.get(name)
        if b is None:
            found.append(f"removed:{name}")
            continue
        if a.kind != b.kind and b.kind not in WIDER.get(a.kind, ()):
            found.append(f"retyped:{name}")
        if a.required != b.required:
            found.append(f"{'required' if b.required else 'optional'}_now:{name}")
        if b.minimum is not None and (a.minimum is None or b.minimum > a.minimum):
            found.append(f"minimum_raised:{name}")
        if b.pattern is not None and b.pattern != a.pattern:
            found.append(f"pattern_changed:{name}")
    found += [f"required_added:{n}" for n, b in after.items() if n not in before and b.required]
    return found + (["key_changed"] if old.key != new.key else [])


def evolution(old: Contract, new: Contract) -> tuple[bool, list[str]]:
    """Whether `new` may follow `old`, and why. A breaking change needs a
    higher major version and a topic of its own; any change a higher version."""
    found = breaking(old, new)
    if found:
        if new.major <= old.major:
            return False, [*found, "needs_major_version"]
        if new.topic == old.topic:
            return False, [*found, "needs_new_topic"]
        return True, found
    if (old.fields != new.fields or old.key != new.key) and new.number <= old.number:
        return False, ["needs_higher_version"]
    return True, []


def main(argv: list[str] | None = None) -> int:
    """Gate for continuous integration: exit code 1 if blocked."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("old")
    p.add_argument("new")
    a = p.parse_args(argv)
    ok, why = evolution(load_contract(a.old), load_contract(a.new))
    print("OK" if ok else "BLOCKED", *why)
    return 0 if ok else 1


# The event's fields, types and constraints.
IMPRESSION_EVENT = Contract(
    "ad_impression_event", "1.0.0", "ad.impressions.v1", "campaign_id",
    (
        FieldSpec("schema_version", "string", True, pattern=r"^1\.[0-9]+\.[0-9]+$"), FieldSpec("impression_id", "string", True, pattern="^[0-9a-f]{64}$"), FieldSpec("event_ts", "timestamp", True), FieldSpec("produced_at", "timestamp", True),
        FieldSpec("user_id", "string", True, pii="pseudonymous"), FieldSpec("campaign_id", "long", True, minimum=0), FieldSpec("is_click", "boolean", True), FieldSpec("is_conversion_path", "boolean", True),
        FieldSpec("cost", "decimal(18,8)", True, minimum=0), FieldSpec("conversion_ts", "timestamp"), FieldSpec("conversion_id", "long"), FieldSpec("is_attributed", "boolean"), FieldSpec("click_pos", "int", minimum=0),
        FieldSpec("click_nb", "int", minimum=0), FieldSpec("cpo", "decimal(18,6)"), FieldSpec("time_since_last_click_s", "long"), *(FieldSpec(f"cat{i}", "string") for i in range(1, 10)),
    ), 300, {"freshness_p95_seconds": 120, "max_dlq_rate_per_hour": 0.01, "allowed_lateness_minutes": 10},
)

if __name__ == "__main__":
    sys.exit(main())
