"""Shapes of JSON values: a subset of JSON Schema, as violations with their paths instead of an exception at the first."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = dict
_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
_KINDS: dict[str, Callable] = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": _number,
    "integer": lambda v: _number(v) and isinstance(v, int),
}
#: keyword -> (to which values it applies, whether a value meets it)
_RULES: dict[str, tuple[Callable, Callable]] = {
    "type": (lambda v: True, lambda v, want: any(_KINDS.get(k, lambda _: True)(v) for k in ([want] if isinstance(want, str) else want))),
    "const": (lambda v: True, lambda v, want: v == want),
    "enum": (lambda v: True, lambda v, want: v in want),
    "minimum": (_number, lambda v, want: v >= want),
    "maximum": (_number, lambda v, want: v <= want),
    "minLength": (_KINDS["string"], lambda v, want: len(v) >= want),
    "maxLength": (_KINDS["string"], lambda v, want: len(v) <= want),
    "minItems": (_KINDS["array"], lambda v, want: len(v) >= want),
    "maxItems": (_KINDS["array"], lambda v, want: len(v) <= want),
}


def violations(value, schema: Schema, named: dict[str, Schema] | None = None, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, keyword) of every rule that `value` breaks. A reference looks its last part up in `named`; one to nothing asks for nothing."""
    if not schema:
        return
    if "$ref" in schema:
        yield from violations(value, (named or {}).get(schema["$ref"].rsplit("/", 1)[-1], {}), named, path)
        return
    for keyword, holds in (("oneOf", lambda n: n == 1), ("anyOf", lambda n: n >= 1)):
        if keyword in schema and not holds(sum(next(violations(value, s, named, path), None) is None for s in schema[keyword])):
            yield path, keyword
    for keyword, (applies, holds) in _RULES.items():
        if schema.get(keyword) is not None and applies(value) and not holds(value, schema[keyword]) or keyword == "const" and keyword in schema and schema[keyword] is None and value is not None:
            yield path, keyword
    if isinstance(value, dict):
        yield from ((f"{path}.{name}".lstrip("."), "required") for name in schema.get("required") or () if name not in value)
        for name, inner in (schema.get("properties") or {}).items():
            if name in value:
                yield from violations(value[name], inner, named, f"{path}.{name}".lstrip("."))
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, entry in enumerate(value):
            yield from violations(entry, schema["items"], named, f"{path}[{k}]")


def broken(text: Column, schema: Schema, named: dict[str, Schema] | None = None) -> Column:
    """The rules that a column of JSON texts breaks, as an array of (path, rule); text that is no JSON breaks `json`, null breaks nothing."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("rule", T.StringType())])))
    def run(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[dict]:
            if t is None:
                return []
            try:
                value = json.loads(t)
            except ValueError:
                return [{"path": "", "rule": "json"}]
            return [{"path": p, "rule": r} for p, r in violations(value, schema, named)]

        return texts.map(of)

    return run(text)
