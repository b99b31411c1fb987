"""JSON schemas of the agent's tools, strict: all fields required, no others."""

from __future__ import annotations

from pyspark.sql import types as T

from ..schemas import TOOLS

_NAMES = {T.StringType: "string", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.FloatType: "number", T.BooleanType: "boolean"}


def json_type(kind: T.DataType) -> dict:
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_type(kind.elementType)}
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_type(f.dataType) for f in kind.fields}, "required": kind.fieldNames(), "additionalProperties": False}
    return {"type": _NAMES[type(kind)]}


def tightened(schema: dict) -> dict:
    """A JSON schema without titles and defaults, with every field of every object required and no others allowed."""
    if isinstance(schema, list):
        return [tightened(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: {name: tightened(x) for name, x in v.items()} if k in ("properties", "$defs") else tightened(v) for k, v in schema.items() if k not in ("title", "default")}
    if "properties" in out:
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


def tool_schema(name: str) -> dict:
    return json_type(TOOLS[name])
