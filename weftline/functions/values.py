"""Typed scalar values: parsing, inference, equality and rendering, as Python literals have them.

A value is a struct (tag, s, n, i, b): tag is bool, int, float or str, and the field of that kind holds it. Integers are
exact to 38 digits; a longer one has the tag wide and its digits in s.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.lines import strip

VALUE = "struct<tag:string,s:string,n:double,i:decimal(38,0),b:boolean>"
#: Numbers as Python's int() and float() read them, and a strict JSON string.
_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_FLOAT = r"^[+-]?(([0-9]+(_[0-9]+)*)?\.?[0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
_NAMED = r"^[+-]?(inf|infinity|nan)$"
_JSON = r'^"([^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"$'


def _value(tag: str, **fields: Column) -> Column:
    kinds = {"s": "string", "n": "double", "i": "decimal(38,0)", "b": "boolean"}
    return F.struct(F.lit(tag).alias("tag"), *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def boolean_value(c: Column, trimmed: bool = False) -> Column:
    """true and false in any case; null for anything else."""
    low = F.lower(c if trimmed else strip(c))
    return F.when(low.isin("true", "false"), _value("bool", b=low == "true"))




def string_text(c: Column, trimmed: bool = False) -> Column:
    """A string's text: decoded if it is a JSON string, without outer quotes if only quoted, else as it is."""
    v = c if trimmed else strip(c)
    quoted = (F.char_length(v) >= 2) & v.startswith('"') & v.endswith('"')
    plain = F.when(v.contains("\\"), F.try_parse_json(v).cast("string")).otherwise(F.substring(v, F.lit(2), F.char_length(v) - 2))
    return F.when(quoted & v.rlike(_JSON), plain).when(quoted, F.regexp_replace(v, '^"+|"+$', "")).otherwise(v)


def string_value(c: Column, trimmed: bool = False) -> Column:
    return F.when(c.isNotNull(), _value("str", s=string_text(c, trimmed)))


def int_value(c: Column, trimmed: bool = False) -> Column:
    own = c if trimmed else strip(c)
    v = F.replace(own, F.lit("_"), F.lit(""))
    number = v.try_cast("decimal(38,0)")
    return F.when(own.rlike(_INT), F.when(number.isNotNull(), _value("int", i=number)).otherwise(_value("wide", s=v)))


def float_value(c: Column, trimmed: bool = False) -> Column:
    v = F.lower(c if trimmed else strip(c))
    named = F.when(v.contains("nan"), F.lit(float("nan"))).when(v.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(v.rlike(_NAMED), _value("float", n=named)).when(v.rlike(_FLOAT), _value("float", n=F.replace(v, F.lit("_"), F.lit("")).try_cast("double")))


def number_value(c: Column, trimmed: bool = False) -> Column:
    """An integer, else a float, else null."""
    return F.coalesce(int_value(c, trimmed), float_value(c, trimmed))


def inferred_value(c: Column, trimmed: bool = False) -> Column:
    """The value of an existing literal: boolean, quoted string, integer, float, or else the text itself.

    The text stands in the expression many times; give it as a trimmed column of its own, so that it is computed once.
    """
    v = c if trimmed else strip(c)
    quoted = F.when((F.char_length(v) >= 2) & v.startswith('"') & v.endswith('"'), string_value(v, True))
    return F.coalesce(boolean_value(v, True), quoted, int_value(v, True), float_value(v, True), _value("str", s=v))


def _number(v: Column) -> Column:
    return F.when(v["tag"] == "bool", v["b"].cast("double")).when(v["tag"] == "int", v["i"].cast("double")).when(v["tag"] == "float", v["n"]).when(v["tag"] == "wide", v["s"].try_cast("double"))


def values_equal(a: Column, b: Column) -> Column:
    """Booleans, integers and floats by their numbers as doubles, NaN never equal; texts by themselves; mixed kinds never."""
    x, y = _number(a), _number(b)
    return F.when(x.isNotNull() & y.isNotNull(), (x == y) & ~F.isnan(x)).when((a["tag"] == "str") & (b["tag"] == "str"), a["s"] == b["s"]).otherwise(F.lit(False))


@F.pandas_udf(T.StringType())
def _render(tag: pd.Series, s: pd.Series, n: pd.Series, i: pd.Series, b: pd.Series) -> pd.Series:
    def one(tag, s, n, i, b):  # noqa: ANN001, ANN202
        if tag is None:
            return None
        return {"bool": lambda: "true" if b else "false", "int": lambda: str(int(i)), "wide": lambda: str(int(s)), "float": lambda: str(float(n))}.get(tag, lambda: json.dumps(s))()

    return pd.Series([one(*x) for x in zip(tag, s, n, i, b, strict=True)], dtype=object)


def render_value(v: Column) -> Column:
    """Literal text: booleans in lower case, numbers as Python prints them, texts as JSON strings in ASCII."""
    simple = (v["tag"] == "str") & v["s"].rlike(r'^[\x20-\x21\x23-\x5b\x5d-\x7e]*$')
    return F.when(v["tag"] == "bool", v["b"].cast("string")).when(v["tag"] == "int", v["i"].cast("string")).when(simple, F.concat(F.lit('"'), v["s"], F.lit('"'))).otherwise(_render(v["tag"], v["s"], v["n"], v["i"], v["b"]))


def trim_or(c: Column, default: Column) -> Column:
    """The trimmed text, or the default if it is null or blank."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), default)


def split_list(c: Column, delimiter: str = ",") -> Column:
    """The trimmed, non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(c, "\\Q" + delimiter + "\\E", -1), strip), lambda x: x != "")


def version_of_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[vV]", "")


def style_of_repo(name: Column) -> Column:
    """A repository's name without one final -vale, unless nothing else is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "-vale$", ""), F.lit("")), name)


def repo_reference(ref: Column) -> Column:
    """struct(owner, repo, style), or null unless the text is two non-blank parts around one slash."""
    parts = F.split(ref, "/", -1)
    owner, repo = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    ok = (F.size(parts) == 2) & (owner != "") & (repo != "")
    return F.when(ok, F.struct(owner.alias("owner"), repo.alias("repo"), style_of_repo(repo).alias("style")))


def destination(dest: Column, default_map: str = "allow") -> Column:
    """struct(path, map_name) of path::name; null if there is no path."""
    path = F.substring_index(dest, "::", 1)
    name = F.when(F.instr(dest, "::") > 0, F.regexp_replace(dest, "^(?s).*?::", ""))
    return F.when(path != "", F.struct(path.alias("path"), F.coalesce(F.nullif(name, F.lit("")), F.lit(default_map)).alias("map_name")))
