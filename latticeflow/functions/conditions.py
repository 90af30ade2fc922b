"""Attribute conditions and path patterns as Spark columns.

Entities keep free-form attributes as JSON text in ``attrs``.  A name that is a column of its own is
read from there; any other is a dotted path into the attributes.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The condition operators of the scenario language.
OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "contains", "not_contains", "in", "not_in", "exists", "not_exists")


def json_path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.replace("'", "").split("."))


def attribute(df: DataFrame, path: str, attrs: str = "attrs", dotted: bool = True) -> tuple[Column, str]:
    """The value as a column, and its kind: a Spark type, or 'variant' inside the attributes."""
    if path in df.columns and path != attrs:
        return F.col(path), df.schema[path].dataType.simpleString()
    where = json_path(path) if dotted else f"$['{path}']"
    return F.try_variant_get(F.try_parse_json(F.col(attrs)), where, "variant"), "variant"


def _typed(value: Column, kind: str, operand) -> Column:
    """value == operand with the operand's own type, null where the types differ."""
    if kind == "variant":
        if operand is None:
            return F.lit(None).cast("boolean")
        shape = F.schema_of_variant(value)
        if isinstance(operand, bool):
            return F.when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean") == F.lit(operand)).when(shape.isNotNull(), F.lit(False))
        if isinstance(operand, (int, float)):
            number = shape.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)")
            return F.when(number, F.try_variant_get(value, "$", "double") == F.lit(float(operand))).when(shape.isNotNull(), F.lit(False))
        if isinstance(operand, str):
            return F.when(shape == "STRING", F.try_variant_get(value, "$", "string") == F.lit(operand)).when(shape.isNotNull(), F.lit(False))
        return F.to_json(value) == F.lit(json.dumps(operand, separators=(",", ":")))
    if operand is None:
        return F.lit(None).cast("boolean")
    if kind == "string":
        return value == F.lit(operand) if isinstance(operand, str) else F.when(value.isNotNull(), F.lit(False))
    if kind == "boolean":
        return value == F.lit(operand) if isinstance(operand, bool) else F.when(value.isNotNull(), F.lit(False))
    if kind.startswith("array"):
        return F.to_json(value) == F.lit(json.dumps(operand, separators=(",", ":")))
    if isinstance(operand, str):
        return F.when(value.isNotNull(), F.lit(False))
    return value.cast("double") == F.lit(float(operand))


def _number(value: Column, kind: str) -> Column:
    if kind == "variant":
        text = F.try_variant_get(value, "$", "string")
        return F.coalesce(F.try_variant_get(value, "$", "double"), text.try_cast("double"))
    if kind.startswith("array"):
        return F.lit(None).cast("double")
    return value.try_cast("double")


def condition(df: DataFrame, attr: str, op: str, operand=None, attrs: str = "attrs") -> Column:
    """One condition; a missing or null attribute meets only not_exists and not_contains."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    value, kind = attribute(df, attr, attrs)
    present = value.isNotNull() & (~F.is_variant_null(value) if kind == "variant" else F.lit(True))
    if op == "exists":
        return present
    if op == "not_exists":
        return ~present
    if op in ("==", "!="):
        same = _typed(value, kind, operand)
        return present & F.coalesce(same if op == "==" else ~same, F.lit(op == "!=" and operand is not None))
    if op in ("<", "<=", ">", ">="):
        try:
            x = float(operand)
        except (TypeError, ValueError):
            return F.lit(False)
        v = _number(value, kind)
        test = {"<": v < x, "<=": v <= x, ">": v > x, ">=": v >= x}[op]
        return present & F.coalesce(test, F.lit(False))
    if op in ("contains", "not_contains"):
        if kind == "variant":
            text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
            items = F.try_variant_get(value, "$", "array<string>")
            found = F.coalesce(F.contains(text, F.lit(str(operand))) if isinstance(operand, str) else None, F.lit(None).cast("boolean")) if isinstance(operand, str) else F.lit(None).cast("boolean")
            found = F.coalesce(found, F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_contains(items, _text(operand))), F.lit(False))
        elif kind.startswith("array"):
            found = F.coalesce(F.array_contains(value.cast("array<string>"), _text(operand)), F.lit(False))
        elif kind == "string":
            found = F.coalesce(F.contains(value, F.lit(str(operand))), F.lit(False))
        else:
            found = F.lit(False)
        return (present & found) if op == "contains" else ~(present & found)
    if not isinstance(operand, (list, tuple, set)):
        raise ValueError(f"{op} needs a list")
    hits = [F.coalesce(_typed(value, kind, x), F.lit(False)) for x in operand]
    inside = functools.reduce(lambda a, b: a | b, hits, F.lit(False))
    return present & (inside if op == "in" else ~inside)


def _text(x) -> str:
    return json.dumps(x) if isinstance(x, (bool, int, float)) else str(x)


def conditions(df: DataFrame, items: Sequence[Mapping], logic: str = "and", attrs: str = "attrs") -> Column:
    """All (and) or any (or) of the conditions; none at all is true."""
    if logic not in ("and", "or"):
        raise ValueError(f"unknown logic {logic!r}")
    if not items:
        return F.lit(True)
    cols = [condition(df, c["attr"], c["op"], c.get("value"), attrs) for c in items]
    return functools.reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), cols)


def java_pattern(pattern: str) -> str | None:
    """The pattern for Spark's engine; None where only Python's gives the same result."""
    if re.search(r"\(\?P=|\(\?\(|\(\?<[=!]|\\Z|\\A", pattern):
        return None
    return pattern.replace("(?P<", "(?<")


def label(pattern: str, name: str = "name") -> Column:
    """Null where the pattern does not match at the start; else its groups joined by '|', or the
    pattern itself if it has none."""
    groups, text = re.compile(pattern).groups, java_pattern(pattern)
    optional = groups and re.search(r"\)[?*{]|\|", pattern)
    if text is None or optional:
        return _python_label(pattern)(F.col(name))
    matches = F.col(name).rlike(f"^(?:{text})")
    if not groups:
        return F.when(matches, F.lit(pattern))
    return F.when(matches, F.concat_ws("|", *(F.regexp_extract(F.col(name), f"^(?:{text})", k) for k in range(1, groups + 1))))


def _python_label(pattern: str):
    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        rx = re.compile(pattern)

        def one(x):
            m = rx.match(x) if x is not None else None
            if m is None:
                return None
            return "|".join(g for g in m.groups() if g is not None) if rx.groups else pattern

        return names.map(one)

    return of


def python_text(value: Column, kind: str) -> Column:
    """str(value) as Python writes it, for labels."""
    if kind == "boolean":
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if kind == "variant":
        text, shape = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value)
        number = F.try_variant_get(value, "$", "double")
        whole = F.concat(number.cast("bigint").cast("string"), F.lit(".0"))
        return F.when(shape == "BOOLEAN", F.initcap(text)).when(shape.rlike("^(DOUBLE|DECIMAL)") & (number == F.floor(number)), whole).when(~F.is_variant_null(value), text)
    return value.cast("string")
