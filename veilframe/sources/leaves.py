"""The strings inside nested data: collect them, and put changed ones back."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def holds_strings(kind: T.DataType) -> bool:
    """Can there be a string to mask in a value of this type?"""
    if isinstance(kind, T.StructType):
        return any(holds_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return holds_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_strings(kind.valueType)
    return isinstance(kind, T.StringType)


def strings_of(kind: T.DataType, value: Column) -> Column:
    """All strings below ``value`` in document order, as one array."""
    if isinstance(kind, T.StringType):
        found = F.array(value)
    elif isinstance(kind, T.StructType):
        parts = [strings_of(f.dataType, value.getField(f.name)) for f in kind.fields]
        found = F.concat(*parts) if parts else _empty()
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x: strings_of(kind.elementType, x)))
    elif isinstance(kind, T.MapType):
        # Keys stay as they are.
        found = F.flatten(
            F.transform(F.map_values(value), lambda x: strings_of(kind.valueType, x))
        )
    else:
        found = _empty()
    return F.filter(F.coalesce(found, _empty()), lambda x: x.isNotNull())


def with_changes(kind: T.DataType, value: Column, changes: Column) -> Column:
    """``value`` with every string that ``changes`` knows replaced."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.element_at(changes, value), value)
    if isinstance(kind, T.StructType):
        fields = [
            with_changes(f.dataType, value.getField(f.name), changes).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: with_changes(kind.elementType, x, changes))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: with_changes(kind.valueType, x, changes))
    return value


# So many comparisons of a row's strings with its changes are made in the row itself.
LOOKUPS = 65_536


@F.pandas_udf(T.ArrayType(T.StringType()))
def _looked_up(strings: pd.Series, changes: pd.Series) -> pd.Series:
    def one(s, c):
        if s is None or c is None:
            return None
        known = dict(c)
        return [x if known.get(x) is None else known[x] for x in s]

    return pd.Series([one(s, c) for s, c in zip(strings, changes, strict=True)], dtype="object")


def put_in(strings: Column, changes: Column) -> Column:
    """``strings`` with each that ``changes`` knows replaced.

    A map is searched from its beginning for every string, so a row with many of both goes through a dictionary.
    """
    many = F.coalesce(F.size(strings).cast("bigint") * F.size(changes) > LOOKUPS, F.lit(False))
    few = F.transform(strings, lambda x: F.coalesce(F.element_at(changes, x), x))
    return F.when(many, _looked_up(F.when(many, strings), F.when(many, changes))).otherwise(few)


def row_strings(df: DataFrame, columns: list[str]) -> Column:
    """The strings of several columns of a row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(*[strings_of(kinds[c], F.col(c)) for c in columns])


def apply_changes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rewrite ``columns`` by the row's ``changes``, and drop those."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    new = {c: with_changes(kinds[c], F.col(c), F.col("changes")) for c in columns}
    return df.withColumns(new).drop("changes")


# --- JSON and XML whose shape is not known before: small per-text helpers ------


def _json_strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return [s for item in value for s in _json_strings(item)]
    return []


def _json_changed(value, changes: dict[str, str]):
    if isinstance(value, str):
        return changes.get(value, value)
    if isinstance(value, dict):
        return {k: _json_changed(v, changes) for k, v in value.items()}
    if isinstance(value, list):
        return [_json_changed(v, changes) for v in value]
    return value


def _read(parse, text, strings):
    """The strings of one text; null where it cannot be parsed."""
    try:
        return strings(parse(text)) if text else []
    except (ValueError, ElementTree.ParseError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _read(json.loads, t, _json_strings))


@F.pandas_udf(T.StringType())
def json_changed(text: pd.Series, changes: pd.Series) -> pd.Series:
    def one(t, c):
        if not t or not c:
            return t
        return json.dumps(_json_changed(json.loads(t), dict(c)), ensure_ascii=False)

    return pd.Series([one(t, c) for t, c in zip(text, changes)], dtype="object")


def _xml_places(root):
    """Readers and writers of every text, tail and attribute, in document order."""
    for node in root.iter():
        yield node.text, lambda v, n=node: setattr(n, "text", v)
        for name in node.attrib:
            yield node.attrib[name], lambda v, n=node, a=name: n.set(a, v)
        yield node.tail, lambda v, n=node: setattr(n, "tail", v)


@F.pandas_udf(T.ArrayType(T.StringType()))
def xml_strings(text: pd.Series) -> pd.Series:
    def strings(root):
        return [s for s, _ in _xml_places(root) if s and s.strip()]

    return text.map(lambda t: _read(ElementTree.fromstring, t, strings))


@F.pandas_udf(T.StringType())
def xml_changed(text: pd.Series, changes: pd.Series) -> pd.Series:
    def one(t, c):
        if not t or not c:
            return t
        known, root = dict(c), ElementTree.fromstring(t)
        for value, put in list(_xml_places(root)):
            if value in known:
                put(known[value])
        return ElementTree.tostring(root, encoding="unicode", xml_declaration=True)

    return pd.Series([one(t, c) for t, c in zip(text, changes)], dtype="object")
