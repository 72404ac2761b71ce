"""Checks of what crosses a boundary: ingested protocols and payloads given out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from procurespark.operators.protocols import served

#: The licenses that a stored protocol may carry.
LICENSES = ["CC0", "CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND", "all-rights-reserved", "unknown"]
#: Fixed patterns: keys and values of the commerce service that may not be given out.
FOREIGN_KEYS = "^(admin_graphql_api_id|shopify_.*|myshopify_domain)$"
FOREIGN_VALUES = "gid://shopify/"
#: What stands for an escaped backslash and an escaped quote while strings are cut out; neither may stand in JSON as it is.
_BACKSLASH, _QUOTE = "\x02", "\x01"


def violations(protocols: DataFrame) -> DataFrame:
    """``rule, source, source_id`` of stored rows that break a rule of ingestion."""
    content = (F.size(F.coalesce("steps", F.array())) > 0) | (F.size(F.coalesce("materials", F.array())) > 0)
    broken = {
        "license": ~F.coalesce(F.col("license").isin(*LICENSES), F.lit(False)),
        "content": content & ~served(F.col("license"), F.col("serving_basis")),
        "identity": F.col("source").isNull() | F.coalesce(F.col("source_id") == "", F.lit(True)),
        "title": F.col("title").isNull(),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in broken.items())))
    return protocols.select(F.explode(found).alias("rule"), "source", "source_id")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as often as it has them more than the other, with ``change``: added or lost.

    None after a repeated run. One pass: rows are counted by their values, with a sign for their table.
    """
    shown = F.to_json(F.struct(*(F.col(f"`{c}`") for c in before.columns)), {"ignoreNullFields": "false"})
    sided = lambda df, sign: df.select(*(F.col(f"`{c}`") for c in before.columns)).withColumns({"_row": shown, "_sign": F.lit(sign)})
    counted = sided(before, -1).unionByName(sided(after, 1)).groupBy("_row").agg(F.sum("_sign").alias("_n"), *(F.any_value(F.col(f"`{c}`")).alias(c) for c in before.columns)).filter("_n <> 0")
    change = F.when(F.col("_n") > 0, "added").otherwise("lost").alias("change")
    return counted.select(*(F.col(f"`{c}`") for c in before.columns), change, F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))).alias("_k")).drop("_k")


def _strings(payload: Column) -> Column:
    """``text, key`` of all strings of a JSON text, at any depth and of any length: what they say, and whether they are keys.

    Once escaped backslashes and quotes stand aside, quotes only begin and end strings, so the text is cut there.
    """
    pieces = F.split(F.replace(F.replace(payload, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"', -1)
    texts, rest = F.filter(pieces, lambda _, i: i % 2 == 1), F.filter(pieces, lambda _, i: i % 2 == 0)
    written = lambda t: F.replace(F.replace(t, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    said = lambda t: F.when(F.rlike(t, F.lit(f"[\\\\{_BACKSLASH}{_QUOTE}]")), F.coalesce(F.get_json_object(F.concat(F.lit('["'), written(t), F.lit('"]')), "$[0]"), written(t))).otherwise(t)
    pairs = F.arrays_zip(texts.alias("text"), F.slice(rest, 2, F.size(rest)).alias("after"))
    return F.transform(F.filter(pairs, lambda p: p["text"].isNotNull()), lambda p: F.struct(said(p["text"]).alias("text"), F.coalesce(F.rlike(p["after"], F.lit(r"^\s*:")), F.lit(False)).alias("key")))


def json_keys(payload: Column) -> Column:
    """All object keys in a JSON text, at any depth, without escapes."""
    return F.array_distinct(F.transform(F.filter(_strings(payload), lambda s: s["key"]), lambda s: s["text"]))


def json_values(payload: Column) -> Column:
    """All strings in a JSON text that aren't keys, without escapes."""
    return F.transform(F.filter(_strings(payload), lambda s: ~s["key"]), lambda s: s["text"])


#: A string of a JSON text, and what makes it a key; an escape outside of strings begins none. As ``_strings``, in one pass.
_STRING = re.compile(r'\\(?:.|\Z)|"((?:[^"\\]++|\\(?:.|\Z))*+)(?:"([ \t\n\x0b\f\r]*:)?|\Z)', re.DOTALL)


def _said(text: str) -> str:
    if "\\" not in text:
        return text
    try:
        return json.loads(f'"{text}"', strict=False)
    except ValueError:
        return text


def _scanned(judge: Callable[[list[tuple[str, bool]]], object], kind: str) -> Callable[[Column], Column]:
    """A column function that judges the strings of each JSON text, each with whether it is a key; null for null."""

    def run(payloads: pa.Array) -> pa.Array:
        strings = lambda p: [(_said(m[1]), m[2] is not None) for m in _STRING.finditer(p) if m[1] is not None]
        made = [None if p is None else judge(strings(p)) for p in (x.as_py() for x in payloads)]
        return pa.array(made, pa.bool_() if kind == "boolean" else pa.list_(pa.string()))

    return F.arrow_udf(run, kind, PythonEvalType.SQL_SCALAR_ARROW_UDF)


def leaked_keys(payload: Column, forbidden: list[str]) -> Column:
    """Which forbidden keys a JSON text holds, at any depth, in order."""
    named = set(forbidden)
    return _scanned(lambda strings: sorted({text for text, key in strings if key and text in named}), "array<string>")(payload)


def is_foreign(payload: Column) -> Column:
    """Whether a JSON text has a key or value of the commerce service."""
    of_keys = re.compile(FOREIGN_KEYS)
    return _scanned(lambda strings: any(of_keys.search(text) if key else FOREIGN_VALUES in text for text, key in strings), "boolean")(payload)


def unmapped_keys(payload: Column, mapped: list[str]) -> Column:
    """Top-level keys of a JSON object that a mapping doesn't use, in order."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, mapped))))
