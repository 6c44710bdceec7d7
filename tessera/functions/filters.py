"""The document filter language, compiled to one Catalyst predicate.

A filter is a JSON object whose entries are all required: a literal (equality without coercion; null also matches a
missing field) or an object of operators ``$gt``, ``$lt`` (numeric fields only; a non-numeric operand counts as 0) and
``$in``.  Operator names ignore case; an unknown operator matches nothing; ``{}`` as a term requires nothing; arrays
and objects never equal anything.  ``extended=True`` adds ``$gte $lte $ne $exists``.

Two modes: typed columns (predicates reach the Parquet scan) and one VARIANT column of schemaless documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class Field:
    """What a filter needs of a field: whether it is nil, and its value as one type or no match."""

    def nil(self) -> Column:
        raise NotImplementedError

    def text(self, value: str) -> Column:
        raise NotImplementedError

    def flag(self, value: bool) -> Column:
        raise NotImplementedError

    def number(self, compare: str, value: float) -> Column:
        raise NotImplementedError


_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


class TypedField(Field):
    def __init__(self, column: Column | None, kind: T.DataType | None):
        self.column, self.kind = column, kind

    def nil(self) -> Column:
        return F.lit(True) if self.column is None else self.column.isNull()

    def text(self, value: str) -> Column:
        if isinstance(self.kind, T.StringType):
            return self.column == value
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)):
            iso = F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss")
            part = F.date_format(self.column, "SSSSSS")
            return F.when(part == "000000", iso).otherwise(F.concat(iso, F.lit("."), part)) == value
        if isinstance(self.kind, T.DateType):
            return F.date_format(self.column, "yyyy-MM-dd") == value
        return F.lit(False)

    def flag(self, value: bool) -> Column:
        return self.column == value if isinstance(self.kind, T.BooleanType) else F.lit(False)

    def number(self, compare: str, value: float) -> Column:
        if not isinstance(self.kind, NUMBERS):
            return F.lit(False)
        bits = WHOLE.get(type(self.kind))
        if bits and float(value).is_integer() and -(2**bits) <= value < 2**bits:
            return _COMPARE[compare](self.column, F.lit(int(value)).cast(self.kind))  # no cast of the column: it is pushed down
        return _COMPARE[compare](self.column.cast("double") if bits or isinstance(self.kind, T.DecimalType) else self.column, float(value))


class VariantField(Field):
    def __init__(self, doc: Column, key: str):
        if '"' not in key:
            self.value = F.try_variant_get(doc, f'$["{key}"]', "variant")
        elif "'" not in key:
            self.value = F.try_variant_get(doc, f"$['{key}']", "variant")
        else:  # a path has no escapes
            self.value = F.try_element_at(doc.try_cast("map<string,variant>"), F.lit(key))
        self.kind = F.schema_of_variant(self.value)

    def nil(self) -> Column:
        return self.value.isNull() | F.is_variant_null(self.value)

    def _as(self, kind: str, when: Column) -> Column:
        return F.when(when, F.try_variant_get(self.value, "$", kind))

    def text(self, value: str) -> Column:
        return self._as("string", self.kind == "STRING") == value

    def flag(self, value: bool) -> Column:
        return self._as("boolean", self.kind == "BOOLEAN") == value

    def number(self, compare: str, value: float) -> Column:
        return _COMPARE[compare](self._as("double", self.kind.isin("BIGINT", "DOUBLE") | self.kind.startswith("DECIMAL")), float(value))


def _equals(field: Field, value: Any) -> Column:
    if value is None:
        return field.nil()
    if isinstance(value, bool):
        return field.flag(value)
    if is_number(value):
        return field.number("eq", value)
    return field.text(value) if isinstance(value, str) else F.lit(False)


def _operator(field: Field, name: str, operand: Any, extended: bool) -> Column:
    name = name.lower()
    if name in ("$gt", "$lt"):
        return field.number(name[1:], operand if is_number(operand) else 0.0)
    if name == "$in":
        return _any([_equals(field, v) for v in operand]) if isinstance(operand, list) else F.lit(False)
    if extended and name in ("$gte", "$lte"):
        return field.number(name[1:], operand if is_number(operand) else 0.0)
    if extended and name == "$ne":
        return ~F.coalesce(_equals(field, operand), F.lit(False))
    if extended and name == "$exists":
        return ~field.nil() if operand else field.nil()
    return F.lit(False)


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False)) if terms else F.lit(False)


def compile_filter(filter_: dict[str, Any] | None, fields: Callable[[str], Field], extended: bool = False) -> Column:
    terms = []
    for key, want in (filter_ or {}).items():
        field = fields(key)
        terms += [_operator(field, n, v, extended) for n, v in want.items()] if isinstance(want, dict) else [_equals(field, want)]
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def typed(schema: T.StructType) -> Callable[[str], Field]:
    """Fields of a DataFrame's columns; keys are literal, a dot is part of a name."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return lambda key: TypedField(F.col("`" + key.replace("`", "``") + "`") if key in kinds else None, kinds.get(key))


def variant(doc: Column) -> Callable[[str], Field]:
    return lambda key: VariantField(doc, key)
