"""JSON as VARIANT: a text is parsed, not searched, and its shape decides what its records are.

A list brings its items, an object with a ``@graph`` list the items of that, any other value is a record itself, and a text that is no JSON
is none.  Records and their fields are rows of lateral joins, made in generated code; ``schema_of_variant_agg`` tells the shape of all
records together without bringing one to the driver.

Defined cases: null texts and texts that are no JSON have no records (``shapes`` counts them as ``none``); an empty list has no
records, and an object without fields no field; repeated rows are read each; a null within a list is a record of the type ``VOID``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.html import is_json

#: What ``schema_of_variant`` calls a list, and an object.
LIST, OBJECT = "ARRAY<", "OBJECT<"


def parsed(text: Column) -> Column:
    """A text as a variant; null where it is not one JSON value, as a parser alone stops at the end of the first."""
    return F.when(is_json(text), F.try_parse_json(text))


def shape(value: Column) -> Column:
    """``list``, ``graph``, ``object``, ``scalar`` or ``none``."""
    kind = F.schema_of_variant(value)
    graph = F.schema_of_variant(F.try_variant_get(value, '$["@graph"]', "variant"))
    return F.when(value.isNull(), "none").when(kind.startswith(LIST), "list").when(graph.startswith(LIST), "graph").when(kind.startswith(OBJECT), "object").otherwise("scalar")


def _listed(value: Column, kind: Column) -> Column:
    """The list whose items are the records."""
    graph = F.try_variant_get(value, '$["@graph"]', "variant")
    return F.when(kind == "list", value).when(kind == "graph", graph).when(kind != "none", F.parse_json(F.concat(F.lit("["), F.to_json(value), F.lit("]"))))


def records(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """``keep``, ``shape``, ``position`` (from 0) and ``record`` (a variant), a row for each record."""
    names = [f"_k{i}" for i in range(len(keep))]
    value = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), parsed(F.col(f"`{json_col}`")).alias("_v")).withColumn("_s", shape(F.col("_v")))
    listed = value.select(*names, "_s", _listed(F.col("_v"), F.col("_s")).alias("_l"))
    out = _sql(listed, f"SELECT {''.join(n + ', ' for n in names)}_s, e.pos, e.value FROM {{t}} AS t, LATERAL variant_explode(t._l) AS e")
    return out.toDF(*keep, "shape", "position", "record")


def fields(found: DataFrame, keep: list[str], record_col: str = "record") -> DataFrame:
    """``keep``, ``name``, ``type`` and ``value`` (as text) of each field of records that are objects."""
    names = [f"_k{i}" for i in range(len(keep))]
    plain = found.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(record_col).alias("_r")).where(F.schema_of_variant("_r").startswith(OBJECT))
    out = _sql(plain, f"SELECT {''.join(n + ', ' for n in names)}e.key, schema_of_variant(e.value) AS type, coalesce(try_variant_get(e.value, '$', 'string'), to_json(e.value)) AS value FROM {{t}} AS t, LATERAL variant_explode(t._r) AS e")
    return out.toDF(*keep, "name", "type", "value")


def _sql(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.sql(text, t=df)


def shapes(df: DataFrame, json_col: str) -> DataFrame:
    """``shape, n_texts, merged_type``: how many texts have each shape, and the type that holds all of them."""
    value = df.select(parsed(F.col(f"`{json_col}`")).alias("_v")).withColumn("shape", shape(F.col("_v")))
    return value.groupBy("shape").agg(F.count("*").alias("n_texts"), F.schema_of_variant_agg("_v").alias("merged_type"))
