"""The condition language over frontmatter: ``field``, ``!field``, ``=``, ``!=``, ``<``, ``<=``, ``>``, ``>=``.

Conditions compile to native Columns over a Variant. The logic has two values: a missing field makes ``!=`` and ``!field``
true and everything else false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z")
_INTEGER = re.compile(r"^[-+]?[0-9]+\Z")
OPERATORS = ("!=", "<=", ">=", "=", "<", ">")


class FieldError(ValueError):
    pass


def parse_field(text: str) -> list[tuple[str, bool]]:
    """Steps (key, each element) of a dotted field path."""
    steps = []
    for part in text.split("."):
        each = part.endswith("[]")
        key = part[:-2] if each else part
        if not key or "[" in key or "]" in key:
            raise FieldError(f"'{text}' is not a field path")
        steps.append((key, each))
    return steps


@dataclass(frozen=True)
class Condition:
    field: str
    op: str  # present, missing or one of OPERATORS
    literal: str | None = None
    other: str | None = None


def parse_condition(text: str) -> Condition:
    if text.startswith("!") and not re.search(r"[=<>]", text):
        parse_field(text[1:])
        return Condition(text[1:], "missing")
    at = re.search(r"[=<>!]", text)
    if not at:
        parse_field(text)
        return Condition(text, "present")
    field, rest = text[: at.start()], text[at.start() :]
    op = next((o for o in OPERATORS if rest.startswith(o)), None)
    if op is None:
        raise FieldError(f"'{text}' has no operator")
    parse_field(field)
    value = rest[len(op) :]
    if value.startswith("@@"):
        return Condition(field, op, literal=value[1:])
    if value.startswith("@"):
        parse_field(value[1:])
        return Condition(field, op, other=value[1:])
    return Condition(field, op, literal=value)


def _step(reached: Column, key: str) -> Column:
    path = '$["' + key.replace('"', '\\"') + '"]'
    return F.transform(reached, lambda v: F.try_variant_get(v, path, "variant"))


def values(frontmatter: Column, field: str) -> Column:
    """array<variant> of the 0..n values that a field path reaches."""
    reached = F.filter(F.array(frontmatter), lambda v: v.isNotNull())
    for key, each in parse_field(field):
        reached = F.filter(_step(reached, key), lambda v: v.isNotNull())
        if each:
            reached = F.flatten(F.transform(reached, lambda v: F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>"))))
    return reached


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _operand(v: Column) -> Column:
    kind = _kind(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.struct(
        F.when(kind == "VOID", "null").otherwise(v.try_cast("string")).alias("text"),
        F.when(number, v.try_cast("double")).alias("dbl"),
        F.when(kind == "BIGINT", v.try_cast("bigint")).alias("lng"),
        (number | (kind == "STRING")).alias("ordered"),
    )


def _operands(vals: Column) -> Column:
    """The scalars among the values, with a list standing for its scalar elements."""
    spread = F.flatten(F.transform(vals, lambda v: F.coalesce(v.try_cast("array<variant>"), F.array(v))))
    scalar = F.filter(spread, lambda v: v.isNotNull() & ~_kind(v).startswith("OBJECT") & ~_kind(v).startswith("ARRAY"))
    return F.transform(scalar, _operand)


def _literal(text: str) -> Column:
    dbl = float(text) if _NUMBER.match(text) else None
    if dbl is not None and dbl in (float("inf"), float("-inf")):
        dbl = None
    lng = int(text) if dbl is not None and _INTEGER.match(text) and -(1 << 63) <= int(text) < 1 << 63 else None
    return F.array(F.struct(F.lit(text).alias("text"), F.lit(dbl).cast("double").alias("dbl"), F.lit(lng).cast("bigint").alias("lng"), F.lit(True).alias("ordered")))


def _compare(op: str, a: Column, b: Column) -> Column:
    def test(x: Column, y: Column) -> Column:
        return {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    whole = a["lng"].isNotNull() & b["lng"].isNotNull()
    numbers = a["dbl"].isNotNull() & b["dbl"].isNotNull()
    result = F.when(whole, test(a["lng"], b["lng"])).when(numbers, test(a["dbl"], b["dbl"])).otherwise(test(a["text"], b["text"]))
    return F.coalesce(result if op == "=" else result & a["ordered"] & b["ordered"], F.lit(False))


def compile_condition(frontmatter: Column, condition: Condition) -> Column:
    reached = values(frontmatter, condition.field)
    if condition.op in ("present", "missing"):
        there = F.coalesce(F.exists(reached, lambda v: ~F.is_variant_null(v)), F.lit(False))
        return there if condition.op == "present" else ~there
    left = _operands(reached)
    right = _literal(condition.literal) if condition.other is None else _operands(values(frontmatter, condition.other))
    op = "=" if condition.op == "!=" else condition.op
    met = F.coalesce(F.exists(left, lambda a: F.exists(right, lambda b: _compare(op, a, b))), F.lit(False))
    return ~met if condition.op == "!=" else met


def where(conditions: list[str], frontmatter: Column, kind: Column, parse_error: Column) -> Column:
    """All conditions hold, on pages whose frontmatter parsed; no condition keeps everything.

    ``frontmatter`` is the JSON text; a page without one is an empty mapping here.
    """
    if not conditions:
        return F.lit(True)
    parsed = F.try_parse_json(F.coalesce(frontmatter, F.lit("{}")))
    met = reduce(lambda x, y: x & y, (compile_condition(parsed, parse_condition(c)) for c in conditions))
    return (kind == "markdown") & parse_error.isNull() & met


def project_field(frontmatter: Column, field: str) -> Column:
    """A field as JSON text: the value, or the list of reached values through ``[]``; null if nothing is reached."""
    reached = values(F.try_parse_json(F.coalesce(frontmatter, F.lit("{}"))), field)
    if any(each for _, each in parse_field(field)):
        return F.when(F.size(reached) > 0, F.to_json(reached))
    return F.when(F.size(reached) > 0, F.to_json(F.element_at(reached, 1)))
