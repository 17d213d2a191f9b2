"""Opt-in contract checks of raw payloads: each gives the list of violated rules.

A contract is a JSON Schema of a flat record, compiled to column expressions. Not part of the default
pipeline: the pipeline itself produces surge values above the declared maximum, and synthetic ids are no
UUIDs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"

SCHEMAS = Path(__file__).resolve().parents[1] / "contracts"

# Keywords that say nothing about a value.
_NOTES = {"$schema", "$id", "$comment", "title", "description", "examples", "default", "deprecated"}
_BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
_TEXTS = ("minLength", "maxLength", "pattern", "format")
_TYPES = ("string", "integer", "number", "boolean", "null", "object", "array")


@dataclass(frozen=True)
class Rule:
    """The rules of one field: its JSON types, then keyword -> value, in the order in which they are checked."""

    types: tuple[str, ...]
    checks: tuple[tuple[str, object], ...] = ()
    required: bool = True

    @property
    def is_text(self) -> bool:
        return "string" in self.types


@dataclass(frozen=True)
class Contract:
    fields: dict[str, Rule]
    closed: bool


def compile_schema(schema: dict | str) -> Contract:
    """A contract from a JSON Schema, as text or parsed.

    A flat object: ``properties`` with ``type`` (one or several; text and numbers do not mix), ``enum`` or
    ``const``, bounds of numbers, lengths, ``pattern`` and the format ``uuid`` of texts; ``required``; and
    ``additionalProperties`` as true or false. Any other keyword is an error, as it would go unchecked.
    """
    schema = json.loads(schema) if isinstance(schema, str) else schema
    _known("the schema", schema, {"type", "properties", "required", "additionalProperties"})
    if schema.get("type") != "object":
        raise ValueError("a contract describes an object")
    closed = not schema.get("additionalProperties", True)
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    required = set(schema.get("required", ()))
    properties = schema.get("properties", {})
    if required - set(properties):
        raise ValueError(f"required without rules: {sorted(required - set(properties))}")
    return Contract({name: _rule(name, rules, name in required) for name, rules in properties.items()}, closed)


def _known(where: str, schema: dict, keywords: set[str]) -> None:
    unknown = set(schema) - keywords - _NOTES
    if unknown:
        raise ValueError(f"{where}: unknown keywords {sorted(unknown)}")


def _rule(name: str, rules: dict, required: bool) -> Rule:
    given = rules.get("type", ())
    types = (given,) if isinstance(given, str) else tuple(given)
    numeric, text = bool({"integer", "number"} & set(types)), "string" in types
    if not types or set(types) - set(_TYPES) or numeric and text:
        raise ValueError(f"{name}: unknown types {list(types)}")
    _known(name, rules, {"type", "enum", "const", *(_BOUNDS if numeric else ()), *(_TEXTS if text else ())})
    if rules.get("format", "uuid") != "uuid":
        raise ValueError(f"{name}: unknown format {rules['format']}")
    checks = [(keyword, rules[keyword]) for keyword in _BOUNDS if keyword in rules]
    if "enum" in rules or "const" in rules:
        values = tuple(rules.get("enum", [rules.get("const")]))
        kinds = (str,) if text else (int, float)
        if not (numeric or text) or any(isinstance(value, bool) or not isinstance(value, kinds) for value in values):
            raise ValueError(f"{name}: values of another type")
        checks.append(("enum", values))
    checks += [(keyword, rules[keyword]) for keyword in _TEXTS if keyword in rules]
    return Rule(types, tuple(checks), required)


def load(name: str) -> Contract:
    return compile_schema((SCHEMAS / f"{name}.json").read_text())


# The three record contracts.
RIDE_REQUEST = load("ride_request")
DRIVER_HEARTBEAT = load("driver_heartbeat")
PRICE_UPDATE = load("price_update")


def parse_document(value: Column) -> Column:
    """JSON object -> map of its fields as variants; null for anything else."""
    return F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>")


def field_readings(document: Column, name: str, rule: Rule) -> dict[str, Column]:
    """What the checks of one field need: its JSON type, and its text or number."""
    return {
        "kind": F.schema_of_variant(document[name]),
        "content": F.try_variant_get(document[name], "$", "string" if rule.is_text else "double"),
    }


def contract_violations(
    document: Column, readings: dict[str, dict[str, Column]], contract: Contract, check_format: bool
) -> Column:
    """Sorted ``field:rule`` texts, empty when the payload keeps the contract.

    ``document`` is a column of ``parse_document`` and ``readings`` are columns of
    ``field_readings``, computed once by the caller in flat columns: the optimizer inlines the
    parts of a struct.
    """
    checks = [_check(readings[name], name, rule, check_format) for name, rule in contract.fields.items()]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    if contract.closed:
        names = F.array(*[F.lit(name) for name in contract.fields]).cast("array<string>")
        unknown = F.array_except(F.map_keys(document), names)
        extra = F.when(F.size(unknown) > 0, F.transform(unknown, lambda key: F.concat(key, F.lit(":additional"))))
        found = F.concat(found, F.coalesce(extra, F.array().cast("array<string>")))
    return F.when(document.isNull(), F.array(F.lit("payload:type"))).otherwise(F.sort_array(found))


def _is_a(kind: Column, content: Column, type_name: str) -> Column:
    if type_name in ("integer", "number"):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return number & (content == F.floor(content)) if type_name == "integer" else number
    names = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    return kind.startswith(type_name.upper()) if type_name in ("object", "array") else kind == names[type_name]


def _breaks(keyword: str, wanted, content: Column) -> Column:
    if keyword == "multipleOf":
        quotient = content / F.lit(float(wanted))
        return quotient != F.floor(quotient)
    if keyword == "enum":
        return ~content.isin(*wanted)
    if keyword in ("pattern", "format"):
        return ~content.rlike(UUID_PATTERN if keyword == "format" else wanted)
    if keyword in ("minLength", "maxLength"):
        length = F.char_length(content)
        return length < F.lit(wanted) if keyword == "minLength" else length > F.lit(wanted)
    bound = F.lit(float(wanted))
    return {
        "minimum": content < bound,
        "maximum": content > bound,
        "exclusiveMinimum": content <= bound,
        "exclusiveMaximum": content >= bound,
    }[keyword]


def _check(reading: dict[str, Column], name: str, rule: Rule, check_format: bool) -> Column:
    """The broken rule of one field, or null. A field can break one rule at a time."""
    kind, content = reading["kind"], reading["content"]
    fits = F.lit(False)
    for type_name in rule.types:
        fits = fits | _is_a(kind, content, type_name)
    missing = F.lit(f"{name}:required") if rule.required else F.lit(None).cast("string")
    broken = F.when(kind.isNull(), missing).when(~F.coalesce(fits, F.lit(False)), F.lit(f"{name}:type"))
    for keyword, wanted in rule.checks:
        if keyword != "format" or check_format:
            # Rules of a type hold for values of that type: a null that is allowed has no content.
            broken = broken.when(F.coalesce(_breaks(keyword, wanted, content), F.lit(False)), F.lit(f"{name}:{keyword}"))
    return broken
