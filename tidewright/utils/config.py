"""Configuration: nested dictionaries, read, merged, validated and addressed by dotted names."""

from __future__ import annotations

import copy
import json
from typing import Any

from tidewright.sources import files

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def load(path: str) -> dict:
    """A JSON file, or a YAML one where a YAML reader is installed."""
    text = files.read_text(path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML reader is installed") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def merge(base: dict, over: dict) -> dict:
    """A new dictionary: nested ones are merged, other values replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def get(config: dict, name: str, default: Any = None) -> Any:
    for part in name.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def put(config: dict, name: str, value: Any) -> dict:
    """A copy in which the dotted name has the value; the original stays."""
    head, _, rest = name.partition(".")
    inner = put(config.get(head) if isinstance(config.get(head), dict) else {}, rest, value) if rest else value
    return {**copy.deepcopy(config), head: inner}


def errors(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What a value violates of a JSON schema's types, required names, enumerations, bounds, properties and items."""
    out = []
    kinds = schema.get("type")
    if kinds:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(value, _TYPES[k]) and not (k in ("integer", "number") and isinstance(value, bool)) for k in kinds):
            return [f"{at}: not of type {', '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of {schema['enum']}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += errors(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: {k} is unknown")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, v in enumerate(value):
            out += errors(v, schema["items"], f"{at}[{k}]")
    return out


def validate(config: dict, schema: dict) -> None:
    found = errors(config, schema)
    if found:
        raise ValueError("; ".join(found))
