"""Shapes of JSON responses: a table of rules by path, read from VARIANT values; one row for each rule that a body breaks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a field may say.
OUTCOMES = ("ok", "abstained", "safety", "fatwa", "invalid")
MODES = ("model", "deterministic")


class Shape(NamedTuple):
    path: str  # from the body, or from an element of each
    kinds: tuple[str, ...]  # OBJECT, ARRAY, STRING, VOID (a JSON null); a missing field is none of them
    values: tuple[str, ...] = ()  # what a string may be
    each: str = ""  # the array whose elements are looked at


RESPONSE = (
    Shape("$", ("OBJECT",)),
    Shape("$.outcome", ("STRING",), OUTCOMES),
    Shape("$.query", ("STRING",)),
    Shape("$.disclaimer", ("STRING",)),
    Shape("$.message", ("STRING", "VOID")),
    *(Shape(f"$.{c}", ("ARRAY",)) for c in ("topics", "keywords", "passages", "suggestions")),
    Shape("$", ("STRING",), each="$.keywords"),
    Shape("$.ai", ("OBJECT",)),
    Shape("$.ai.mode", ("STRING", "VOID"), MODES),
    Shape("$.ai.text", ("STRING", "VOID")),
    Shape("$.safety", ("OBJECT", "VOID")),
    Shape("$.fatwa", ("OBJECT", "VOID")),
    Shape("$", ("OBJECT",), each="$.topics"),
    Shape("$.topic", ("OBJECT",), each="$.topics"),
    *(Shape(f"$.topic.{c}", ("STRING",), each="$.topics") for c in ("id", "title")),
    Shape("$", ("OBJECT",), each="$.suggestions"),
    *(Shape(f"$.{c}", ("STRING",), each="$.suggestions") for c in ("slug", "title")),
    Shape("$", ("OBJECT",), each="$.passages"),
    *(Shape(f"$.{c}", ("STRING",), each="$.passages") for c in ("chunkId", "text", "chapter")),
    Shape("$.source", ("OBJECT",), each="$.passages"),
    *(Shape(f"$.source.{c}", ("STRING",), each="$.passages") for c in ("sourceId", "title", "author", "originalUrl")),
)


def name(rule: Shape) -> str:
    return f"{rule.each}[*]{rule.path[1:]}" if rule.each else rule.path


def _broken(value: Column, rule: Shape) -> Column:
    at = F.try_variant_get(value, rule.path, "variant")
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0), F.lit("MISSING"))
    fine = kind.isin(*rule.kinds)
    if rule.values:
        fine = fine & ((kind != "STRING") | F.coalesce(F.try_variant_get(value, rule.path, "string").isin(*rule.values), F.lit(False)))
    return ~fine


def violations(bodies: DataFrame, key: list[str], body: str, rules: tuple[Shape, ...] = RESPONSE) -> DataFrame:
    """(key..., path) of each rule that a JSON body breaks; an element's rule once, however many elements break it.

    A null body, and one that isn't JSON, is no object and has no fields. What stands in an array's place but is none breaks the array's own rule
    only. Repeated bodies: each has its rows.
    """
    x = bodies.select(*key, F.try_parse_json(F.col(body)).alias("_v"))

    def test(rule: Shape) -> Column:
        if not rule.each:
            return _broken(F.col("_v"), rule)
        items = F.try_variant_get("_v", rule.each, "array<variant>")
        return F.coalesce(F.exists(items, lambda e: _broken(e, rule)), F.lit(False))

    found = F.array_compact(F.array(*(F.when(test(r), F.lit(name(r))) for r in rules)))
    return x.select(*key, F.explode(found).alias("path"))
